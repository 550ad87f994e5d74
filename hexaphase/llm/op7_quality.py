"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A word shows three features: its letters, the marks around them, and its shape. Each feature falls in one of 2**15
buckets, and each bucket has a sparse random index vector. Its context vector is the mean of the index vectors of
the words at most WINDOW places away, summed over the training sample (random indexing). A document is the mean of both
vectors over all features of all words of its whole text. A network with one hidden layer, in numpy, gives a logit;
dividing it by a temperature, fitted on labelled rows that the weights have not seen, makes the score a probability.

Only the fit reads labels, and only of rows whose crc32(doc_id as text) mod 4 is not 2; it takes SAMPLE labelled rows at
most in expectation, chosen by a hash of doc_id. Scores read texts alone. The fit is one task over that bounded sample;
the model (a few MB, whatever the input) is broadcast.

Defined cases: a null or empty text gets the score of the zero vector; a very long one is read whole. Several labels of a
doc_id count by majority, and a tie as 1; null labels and labels without a document do not count. With no labels, or labels of one kind only, the score of every text
is their share of ones, drawn towards a half. Repeated rows are each scored. An empty table gives no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import lean, table

SAMPLE = 6000
BITS, DIM, ONES, WINDOW, HIDDEN = 15, 64, 4, 2, 32
EPOCHS, RATE, DECAY, BATCH = 40, 2e-3, 1e-3, 128
_SIZE = 1 << BITS
_CACHE = 400_000
_EDGE = re.compile(r"^([\W_]*)(.*?)([\W_]*)$", re.S)


def index_vectors() -> np.ndarray:
    """Per bucket a vector with ONES entries of +1 and of -1."""
    rng = np.random.Generator(np.random.PCG64(7))
    out = np.zeros((_SIZE, DIM), np.float32)
    at = np.argsort(rng.random((_SIZE, DIM)), axis=1)[:, : 2 * ONES]
    np.put_along_axis(out, at[:, :ONES], 1, axis=1)
    np.put_along_axis(out, at[:, ONES:], -1, axis=1)
    return out


def features(word: str) -> tuple[int, int, int]:
    before, core, after = _EDGE.match(word).groups()
    kind = "d" if core.isdigit() else "u" if core.isupper() else "l" if core.islower() else "t" if core.istitle() else "m" if core else "n"
    names = (f"w{core.lower()}", f"e{before}_{after}", f"s{kind}{min(len(core), 24) // 4}")
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) & (_SIZE - 1) for x in names)


class Words:
    """Feature buckets of the words of texts; remembers words, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int, int]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, words = self.known, (text or "").split()
        if len(known) > _CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = features(w)
        return np.array([known[w] for w in words], np.int64).reshape(-1, 3)


def pooled(buckets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    if not len(buckets):
        return np.zeros(vectors.shape[1], np.float32)
    seen, n = np.unique(buckets, return_counts=True)
    return (n.astype(np.float32) @ vectors[seen]) / np.float32(n.sum())


def context_vectors(docs: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    sums, n = np.zeros_like(index), np.zeros(_SIZE, np.float32)
    for b in docs:
        own = index[b].sum(axis=1)
        near = np.zeros_like(own)
        for k in range(1, WINDOW + 1):
            near[k:] += own[:-k]
            near[:-k] += own[k:]
        for j in range(3):
            order = np.argsort(b[:, j], kind="stable")
            at, first, count = np.unique(b[order, j], return_index=True, return_counts=True)
            if len(at):
                sums[at] += np.add.reduceat(near[order], first, axis=0)
                n[at] += count
    return sums / np.maximum(n, 1)[:, None] / (2 * WINDOW * 3)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Network:
    """mean, scale: of the inputs; one hidden layer of tanh; a logit, divided by the temperature."""

    NAMES = ("mean", "scale", "w1", "b1", "w2", "b2", "temperature")

    def __init__(self, **parts: np.ndarray) -> None:
        self.parts = parts

    def logit(self, x: np.ndarray) -> np.ndarray:
        p = self.parts
        return np.tanh((x - p["mean"]) / p["scale"] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.parts["temperature"])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
        x, y, rng = x.astype(np.float64), y.astype(np.float64), np.random.Generator(np.random.PCG64(seed))
        apart = np.arange(len(y)) % 5 == 4
        rest = ~apart
        if len(set(y[rest])) < 2:
            share = (y.sum() + 1) / (len(y) + 2)
            zero = np.zeros
            return cls(mean=zero(x.shape[1]), scale=np.ones(x.shape[1]), w1=zero((x.shape[1], HIDDEN)), b1=zero(HIDDEN), w2=zero(HIDDEN), b2=np.array(np.log(share / (1 - share))), temperature=np.array(1.0))
        mean, scale = x[rest].mean(0), x[rest].std(0) + 1e-4
        p = {"w1": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.zeros(())}
        m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        z, t = (x[rest] - mean) / scale, y[rest]
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(t)), max(1, len(t) // BATCH)):
                h = np.tanh(z[at] @ p["w1"] + p["b1"])
                d = (_sigmoid(h @ p["w2"] + p["b2"]) - t[at]) / len(at)
                back = np.outer(d, p["w2"]) * (1 - h * h)
                g = {"w1": z[at].T @ back + DECAY * p["w1"], "b1": back.sum(0), "w2": h.T @ d + DECAY * p["w2"], "b2": d.sum()}
                step += 1
                for k in p:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        net = cls(mean=mean, scale=scale, temperature=np.array(1.0), **p)
        logit, grid = net.logit(x[apart]), np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.mean(np.logaddexp(0, logit / s) - y[apart] * logit / s) for s in grid]
        net.parts["temperature"] = np.array(grid[int(np.argmin(loss))])
        return net


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, ids, docs, labels = Words(), [], [], []
    for batch in batches:
        for i, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(i)
            docs.append(words(text).astype(np.uint16 if BITS <= 16 else np.int32))
            labels.append(label)
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i], len(docs[i])))
    docs, y = [docs[i] for i in order], np.array([labels[i] for i in order], np.float64)
    index = index_vectors()
    context = context_vectors(docs, index).astype(np.float32)
    vectors = np.hstack([index, context])
    x = np.array([pooled(d, vectors) for d in docs]).reshape(len(docs), 2 * DIM)
    net = Network.fit(x, y)
    parts = {"context": context.astype(np.float16)} | net.parts
    out = [(k, str(a.dtype), list(a.shape), a.tobytes()) for k, a in parts.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["name", "kind", "shape", "data"])


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The model: of sample labelled rows at most in expectation."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    known = known.groupBy("_id").agg(F.avg("_y").alias("_y")).withColumn("_y", F.round("_y").cast("int"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(known), texts["_i"] == known["_id"]).select("_id", "_text", "_y")
    model = rows.repartition(1).mapInArrow(_fit, "name string, kind string, shape array<long>, data binary").collect()
    if not model:  # no labelled row has a document
        return {"context": np.zeros((_SIZE, DIM), np.float16)} | Network.fit(np.zeros((0, 2 * DIM)), np.zeros(0)).parts
    return {r["name"]: np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"]) for r in model}


def score(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", to: str = "score") -> DataFrame:
    """docs with a column more, or in place of one of that name: the probability of label 1."""
    docs = docs.drop(to) if to in docs.columns and to != text_col else docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text_col), [*(f"c{i}" for i in range(len(docs.columns))), "made"]  # names that no dot or case can upset
    out = StructType([*(StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields, strict=False)), StructField("made", DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Words(), dict(shared.value)
        vectors = np.hstack([index_vectors(), model.pop("context").astype(np.float32)])
        net = Network(**model)
        for batch in batches:
            x = [pooled(words(t.as_py()), vectors) for t in batch.column(at)]
            s = net.score(np.array(x, np.float64).reshape(len(x), 2 * DIM))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=names)

    return docs.toDF(*names[:-1]).mapInArrow(lean(run), out).toDF(*docs.columns, to)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
