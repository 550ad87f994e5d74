"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its five-word shingles (lower case; with fewer words, the whole sequence), each weighing as
often as it occurs. For each of SAMPLES independent draws, a term of weight S gets from its own gamma variables r and c
and uniform b the values t = floor(ln S / r + b) and a = c / exp(r (t - b) + r); the term of least a, with its t, is the
draw's sample. Two documents draw the same sample with the probability that is their generalised Jaccard similarity, so
the share of equal draws estimates it. A term's variables come from a table of 2**ROWS_BITS rows by a hash of the term;
terms of a row share them, and the one of least hash stands for the row, which keeps samples consistent. The
fingerprint is the samples' 16-bit digests in hex.

The table's neighbours (the next document in descending doc_id, and the first after the last) are found by one range
partitioning of the texts: within a task rows follow each other; a task's last row, whose next one lies in another task,
is completed after the tasks' results have been written, from the few boundary rows alone.

Defined cases: a null or empty text has no terms; its fingerprint is all zeros, and it is like another empty text only.
Null doc_ids come after all others. Rows of equal doc_id follow in ascending order of text. A lone row is its own next.
A very long text is sampled whole, in pieces; of equal draws (ties) the smaller term hash wins. Repeated rows are each reported;
an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, RangeHash, mix, saved, shards, table, word_bounds

SAMPLES, ROWS_BITS, SHINGLE, SEED = 64, 15, 5, 20240917
CHUNK_TERMS = 1 << 14


class Sampler:
    """The table of variables, drawn from a fixed seed."""

    def __init__(self, samples: int = SAMPLES, rows_bits: int = ROWS_BITS, seed: int = SEED) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        shape = (1 << rows_bits, samples)
        self.samples, self.mask = samples, np.uint64(shape[0] - 1)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.c = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.b = rng.random(shape, np.float32)
        self.one = self.c * np.exp(self.r * self.b - self.r)  # a for S = 1, where t is 0
        self.salt = mix(np.arange(1, samples + 1, dtype=np.uint64))

    def terms(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct shingles, ascending, and how often each occurs."""
        buf = np.frombuffer(text.translate(LOWER), np.uint8)
        start, end = word_bounds(buf)
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        word = RangeHash(buf)(start, end)
        width = min(SHINGLE, len(word))
        h = np.zeros(len(word) - width + 1, np.uint64)
        for k in range(width):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + word[k : len(word) - width + 1 + k] + np.uint64(k))
        return np.unique(h, return_counts=True)

    def __call__(self, text: bytes) -> np.ndarray:
        """The samples, 16 bits each."""
        h, weight = self.terms(text)
        if not len(h):
            return np.zeros(self.samples, np.uint16)
        row = (mix(h ^ np.uint64(0xA5A5A5A5)) & self.mask).astype(np.int64)
        best, who, level = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.int64), np.zeros(self.samples, np.float32)
        single = np.flatnonzero(weight == 1)
        for i in range(0, len(single), CHUNK_TERMS):
            at = single[i : i + CHUNK_TERMS]
            a = self.one[row[at]]
            k = a.argmin(axis=0)
            least = a[k, np.arange(self.samples)]
            won = (least < best) | (least == best) & (at[k] < who)
            best, who = np.where(won, least, best), np.where(won, at[k], who)
        heavy = np.flatnonzero(weight > 1)
        for i in range(0, len(heavy), CHUNK_TERMS):
            at = heavy[i : i + CHUNK_TERMS]
            r, b = self.r[row[at]], self.b[row[at]]
            t = np.floor(np.log(weight[at].astype(np.float32))[:, None] / r + b)
            a = self.c[row[at]] * np.exp(-r * (t - b) - r)
            k = a.argmin(axis=0)
            least = a[k, np.arange(self.samples)]
            won = (least < best) | (least == best) & (at[k] < who)
            best, who, level = np.where(won, least, best), np.where(won, at[k], who), np.where(won, t[k, np.arange(self.samples)], level)
        out = (mix(h[who] ^ self.salt + level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
        return np.maximum(out, 1)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(x == y))


def hexed(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


def unhexed(x: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(x), ">u2")


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


_OUT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _complete(draw: Sampler, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    new = edited(text, following).encode()
    sample = draw(new)
    return len(text), hashlib.sha256(new).hexdigest(), hexed(own), hexed(sample), likeness(own, sample), likeness(own, its)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    order = [F.desc_nulls_last("doc_id"), F.asc("text")]
    # a task emits its rows but for the last; that one and the first it keeps as texts, under its own number
    staged = f"{schema}, part int, at string, text string"
    part = rows.repartitionByRange(shards(docs.sparkSession), order[0]).sortWithinPartitions(*order)
    arrow = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("at", pa.string()), ("text", pa.string())])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, draw, before = TaskContext.get().partitionId(), Sampler(), None

        def made(ids: list, out: list) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)]
            return pa.RecordBatch.from_arrays([pa.array(ids, type_), *columns], names=["doc_id", *arrow.names])

        type_ = None
        for batch in batches:
            type_, ids, out = batch.schema.field(0).type, [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = draw(text.encode())
                if before is None:
                    ids.append(i)
                    out.append((len(text), None, hexed(own), None, None, None, number, "first", text))
                else:
                    ids.append(before[0])
                    out.append((*_complete(draw, before[1], before[2], text, own), number, None, None))
                before = i, text, own
            yield made(ids, out)
        if before is not None:
            yield made([before[0]], [(len(before[1]), None, hexed(before[2]), None, None, None, number, "last", before[1])])

    staged_rows = saved(part.mapInArrow(follow, staged))
    inner = staged_rows.where(F.col("at").isNull()).select("doc_id", *_OUT)
    edges = staged_rows.where(F.col("at").isNotNull())
    # the next task with rows, by a window over one number per task; texts meet by equality of those numbers
    numbers = edges.where("at = 'last'").select("part")
    one = Window.partitionBy(F.lit(0)).orderBy("part")
    numbers = numbers.select("part", F.coalesce(F.lead("part").over(one), F.first("part").over(one)).alias("next"))
    firsts = edges.where("at = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    lasts = edges.where("at = 'last'").select("doc_id", "part", "text", "fingerprint").join(numbers, "part").join(firsts, "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = None
        for batch in batches:
            draw = draw or Sampler()
            out = [_complete(draw, t, unhexed(fp), nt, unhexed(nfp)) for t, fp, nt, nfp in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)]
            columns = [pa.array([r[i] for r in out], arrow.field(i).type) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_OUT])

    ends = lasts.select("doc_id", "text", "fingerprint", "next_text", "next_fp").mapInArrow(finish, schema)
    return inner.unionByName(ends)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
