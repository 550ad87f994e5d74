"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

Each batch has a frame of tokens per side (document, first byte). pandas.merge_asof, keyed by document, finds for each token's start
the other side's token that covers it; both directions together are the overlaps, and overlapping tokens of equal ends close a
group. Tokens of a group are linked, all with all; how many documents hold a pair of ids linked is counted over the corpus, and
each document gets its links weighed by these counts.

Encoding: a text is cut where neither tokenizer can join anything: before a blank between two visible characters, and around a
single line feed between such. A worker encodes each different unit once and keeps it; texts are gathered from units.

At scale: a task's documents form blocks. A block names its different pairs in order of appearance; documents keep numbers of
names. Pairs are counted within a block, then summed by pair, and each block gets back one number a pair, so that what moves is
blocks times their different pairs, not documents times links, and a pair that every document holds is one row a block. The highest
count of an A id is a table of at most as many rows as A has ids, and is broadcast. Groups with very many links are counted by
different ids and how often they occur, never link by link.

Defined cases: null and empty texts, and texts whose bytes are not what either side's tokens join to (U+2581, which B writes for a
blank), have no tokens: zeros, and an empty string for the hash. Very long texts, units and groups are read whole. Ties for an A
id's highest count all count. Repeated rows are each aligned and each counted as a document. An empty table gives no rows. Other
columns, whatever their names, are not read. No tokenizer is trained.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, pieces, saved, table

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CHUNK_CHARS = 1 << 20
#: Beyond so many units, or so many tokens of them, a worker forgets all but those used most; a block closes beyond so many pairs or bytes.
UNITS, UNIT_TOKENS = 400_000, 4_000_000
BLOCK_PAIRS, BLOCK_BYTES = 1_000_000, 1 << 26
#: Links made at once; groups of more than HEAVY links are counted by different ids.
LINKS_AT_ONCE, HEAVY = 1 << 21, 64
_ID_BITS = 20
_MASK = (1 << _ID_BITS) - 1
_SEEN = r"[!-~\w]"
_CUT = re.compile(rf"(?<={_SEEN})(?=[ \n]{_SEEN})|(?<={_SEEN}\n)(?={_SEEN})")


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, end to end."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def byte_characters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: visible Latin-1 characters are themselves, the rest follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """One tokenizer: the bytes of its ids, and the ids of units."""

    def __init__(self, raw: list[bytes], encode: Callable[[list[str]], list[list[int]]]) -> None:
        self.raw, self.encode = raw, encode
        self.sizes = np.array([len(r) for r in raw], np.int32)
        text = [str(i) for i in range(len(raw))]
        self.text = np.array([[t + end for t in text] for end in ",|;"], object)


def side_a(model: str) -> Side:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_str(model)
    t.encode_special_tokens = True
    of = byte_characters()
    raw = [b""] * t.get_vocab_size()
    for piece, i in t.get_vocab().items():
        raw[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
    return Side(raw, lambda units: [e.ids for e in t.encode_batch_fast(units, add_special_tokens=False)])


def side_b(model: bytes) -> Side:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(len(names))]
    if any(n and (BLANK in p.lstrip(BLANK) or "\n" in p) for n, p in zip(normal, names, strict=True)):
        raise ValueError("a piece goes on after a blank or holds a line feed")
    raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(BLANK, " ").encode() if normal[i] else b"" for i, p in enumerate(names)]

    def encode(units: list[str]) -> list[list[int]]:
        # the library puts a blank in front: for units without one, a line feed guards them, and both go
        found = sp.encode([u[1:] if u[0] == " " else u if u[0] == "\n" else "\n" + u for u in units], num_threads=1)
        return [ids if u[0] == " " else ids[1:] if u[0] == "\n" else ids[2:] for u, ids in zip(units, found, strict=True)]

    return Side(raw, encode)


class Units:
    """Units that a worker has met, with both sides' ids."""

    def __init__(self, a: Side, b: Side) -> None:
        self.sides = a, b
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.good, self.used = np.zeros(0, bool), np.zeros(0, np.int64)
        self.start, self.size, self.pool = ([np.zeros(0, np.int64) for _ in range(2)] for _ in range(3))

    def _shrink(self) -> None:
        """Forgets all units but those used most often, half of UNITS and of UNIT_TOKENS at most."""
        keep = np.argsort(-self.used, kind="stable")[: UNITS // 2]
        keep = keep[self.used[keep] > 1]
        for size in self.size:
            keep = keep[np.cumsum(size[keep]) <= UNIT_TOKENS // 2]
        keep = np.sort(keep)
        names = list(self.at)
        self.at = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.good, self.used = self.good[keep], self.used[keep] // 2
        for k in range(2):
            size = self.size[k][keep]
            self.pool[k] = self.pool[k][spread(self.start[k][keep], size)]
            self.start[k], self.size[k] = np.cumsum(size) - size, size

    def _learn(self, units: list[str]) -> None:
        good, long = np.ones(len(units), bool), np.fromiter((len(u) if u.isascii() else len(u.encode()) for u in units), np.int64, len(units))
        joined = "".join(units).encode()
        for k, side in enumerate(self.sides):
            ids = side.encode(units)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            pool = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(side.sizes[pool], dtype=np.int64)])[np.cumsum(size)]
            if not np.array_equal(ends, np.cumsum(long)) or b"".join(map(side.raw.__getitem__, pool.tolist())) != joined:  # some unit is not what its tokens join to
                good &= np.array([b"".join([side.raw[i] for i in x]) == u.encode() for x, u in zip(ids, units, strict=True)], bool)
            self.start[k] = np.concatenate([self.start[k], len(self.pool[k]) + np.cumsum(size) - size])
            self.size[k] = np.concatenate([self.size[k], size])
            self.pool[k] = np.concatenate([self.pool[k], pool])
        self.good = np.concatenate([self.good, good])
        self.used = np.concatenate([self.used, np.zeros(len(units), np.int64)])
        self.at.update(zip(units, range(len(self.at), len(self.at) + len(units)), strict=True))

    def numbers(self, units: list[str]) -> np.ndarray:
        new = list(set(units).difference(self.at))
        if len(self.at) + len(new) > UNITS or max(map(len, self.pool)) > UNIT_TOKENS:
            self._shrink()
            new = list(set(units).difference(self.at))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))
        self.used += np.bincount(at, minlength=len(self.used))
        return at


def kept_units(held: dict) -> Units:
    """The units of a broadcast {"a": ..., "b": ...} of models. They stay there, so that a worker's later tasks find what it has met."""
    if "units" not in held:
        held["units"] = Units(side_a(held["a"]), side_b(held["b"]))
    return held["units"]


@dataclass
class Aligned:
    """Tokens of both sides of some documents (0 to n_docs - 1): id, document, last byte + 1, group, and whether a group ends there."""

    n_docs: int
    ids: tuple[np.ndarray, np.ndarray]
    docs: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    groups: tuple[np.ndarray, np.ndarray]
    closes: tuple[np.ndarray, np.ndarray]

    def per_doc(self, docs: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(docs, weights, self.n_docs).astype(np.int64)


def align(texts: list[str | None], units: Units) -> Aligned:
    split = [_CUT.split(" " + t) if t else [] for t in texts]
    at = units.numbers([u for s in split for u in s])
    doc = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    kept = np.bincount(doc, ~units.good[at], len(texts))[doc] == 0
    at, doc = at[kept], doc[kept]
    ids, docs, ends, starts, frames = [], [], [], [], []
    for k, side in enumerate(units.sides):
        size = units.size[k][at]
        ids.append(units.pool[k][spread(units.start[k][at], size)])
        docs.append(np.repeat(doc, size))
        long = side.sizes[ids[k]]
        ends.append(np.cumsum(long, dtype=np.int64))
        starts.append(ends[k] - long)
        frames.append(pd.DataFrame({"start": starts[k], "doc": docs[k], f"t{k}": np.arange(len(long))}))
    overlaps = [pd.merge_asof(frames[k], frames[1 - k], on="start", by="doc")[["t0", "t1"]] for k in (0, 1)]
    t0, t1 = (np.concatenate([o[c].to_numpy(np.int64) for o in overlaps]) for c in ("t0", "t1"))
    equal = ends[0][t0] == ends[1][t1]
    closes, groups = [], []
    for k, t in enumerate((t0, t1)):
        closes.append(np.zeros(len(ids[k]), bool))
        closes[k][t[equal]] = True
        groups.append(np.cumsum(closes[k]) - closes[k])
    return Aligned(len(texts), *(tuple(x) for x in (ids, docs, ends, groups, closes)))


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, times = np.unique((group << _ID_BITS) | ids, return_counts=True)
    return key >> _ID_BITS, key & _MASK, times


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def linked(al: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """Each document's different linked pairs, as document << 40 | A id << 20 | B id, ascending, and how many links each is."""
    n = len(al.groups[0]) and int(al.groups[0][-1]) + 1
    sizes = [np.bincount(g, minlength=n) for g in al.groups]
    heavy = sizes[0] * sizes[1] > HEAVY
    doc_of = np.zeros(n, np.int64)
    doc_of[al.groups[0]] = al.docs[0]
    keys, weights = [], []
    for dense in (False, True):
        tokens = []
        for k in (0, 1):
            own = heavy[al.groups[k]] == dense
            group, ids = al.groups[k][own], al.ids[k][own]
            tokens.append(_counted(group, ids) if dense else (group, ids, np.ones(len(ids), np.int64)))
        (ga, a, wa), (gb, b, wb) = tokens
        many = np.bincount(gb, minlength=n)[ga]
        start = np.searchsorted(gb, ga)
        cuts = np.cumsum(many)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(cuts, (cuts[i - 1] if i else 0) + LINKS_AT_ONCE, side="right")))
            left, right = np.repeat(np.arange(i, j), many[i:j]), spread(start[i:j], many[i:j])
            k, w = _summed((doc_of[ga[left]] << 2 * _ID_BITS) | (a[left] << _ID_BITS) | b[right], wa[left] * wb[right])
            keys.append(k)
            weights.append(w)
            i = j
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _summed(np.concatenate(keys), np.concatenate(weights)) if len(keys) > 1 else (keys[0], weights[0])


def spelled(al: Aligned, sides: tuple[Side, Side]) -> list[str]:
    """a1,a2|b1;a3|b2,b3 of each document."""
    n = [len(i) for i in al.ids]
    sizes = [np.bincount(g, minlength=1) for g in al.groups]
    out = np.empty(sum(n), object)
    if sum(n):
        out[np.arange(n[0]) + (np.cumsum(sizes[1]) - sizes[1])[al.groups[0]]] = sides[0].text[al.closes[0].astype(int), al.ids[0]]
        out[np.arange(n[1]) + np.cumsum(sizes[0])[al.groups[1]]] = sides[1].text[2 * al.closes[1], al.ids[1]]
    flat, at = out.tolist(), np.concatenate([[0], np.cumsum(al.per_doc(al.docs[0]) + al.per_doc(al.docs[1]))]).tolist()
    return ["".join(flat[x:y])[:-1] for x, y in zip(at[:-1], at[1:], strict=True)]


class Names:
    """Numbers of a block's pairs in order of appearance, and how many documents hold each."""

    def __init__(self) -> None:
        self.sorted, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.docs = np.zeros(0, np.int64)

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        distinct, times = np.unique(pairs, return_counts=True)
        new = distinct[~np.isin(distinct, self.sorted, assume_unique=True)]
        names = np.concatenate([self.sorted, new])
        order = np.argsort(names, kind="stable")
        self.number = np.concatenate([self.number, np.arange(len(self.number), len(names))])[order]
        self.sorted = names[order]
        self.docs = np.concatenate([self.docs, np.zeros(len(new), np.int64)])
        self.docs[self.number[np.searchsorted(self.sorted, distinct)]] += times
        return self.number[np.searchsorted(self.sorted, pairs)]

    def in_order(self) -> np.ndarray:
        out = np.empty(len(self.sorted), np.int64)
        out[self.number] = self.sorted
        return out


def _packed(number: np.ndarray, times: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    order = np.argsort(number)
    steps = np.diff(number[order], prepend=0).astype(np.uint32)
    low = steps.view(np.uint8).reshape(-1, 4).T.tobytes()  # byte by byte of all numbers
    return press.compress(np.uint32(len(steps)).tobytes() + low + times[order].astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes, press: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(press.decompress(data), np.uint8)
    n = int(raw[:4].view(np.uint32)[0])
    number = np.ascontiguousarray(raw[4 : 4 + 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    times = np.ascontiguousarray(raw[4 + 4 * n :].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(number, dtype=np.int64), times.astype(np.int64)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _models(spark: SparkSession, model_a: str, model_b: str):
    return spark.sparkContext.broadcast({"a": Path(model_a).read_text(encoding="utf-8"), "b": Path(model_b).read_bytes()})


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """One row per row of docs: doc_id and groups, an array of start and end (bytes of the blank and the text) and ids a and b."""
    models = _models(docs.sparkSession, model_a, model_b)
    rows, kind = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = kept_units(models.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x, y in pieces([len(t or "") for t in texts], CHUNK_CHARS):
                al = align(texts[x:y], units)
                ends, doc = al.ends[0][al.closes[0]], al.docs[0][al.closes[0]]
                starts = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]])
                at = np.searchsorted(doc, np.arange(y - x + 1))
                base = np.concatenate([starts, [0]])[at[:-1]].repeat(np.diff(at))
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(g, np.arange(len(ends) + 1)), pa.int32()), pa.array(i, pa.int32())) for g, i in zip(al.groups, al.ids, strict=True)]
                found = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base), *lists], names=["start", "end", "a", "b"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.ListArray.from_arrays(pa.array(at, pa.int32()), found)], names=["doc_id", "groups"])

    return rows.mapInArrow(run, f"doc_id {kind}, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>")


def _first_pass(docs: DataFrame, id_col: str, text_col: str, model_a: str, model_b: str) -> DataFrame:
    """Rows of documents, with the numbers of their pairs; and rows of blocks, with the pairs that the numbers from base on name."""
    models = _models(docs.sparkSession, model_a, model_b)
    rows, kind = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, names, press = kept_units(models.value), Names(), zstandard.ZstdCompressor(level=1)
        block, held, id_type = TaskContext.get().partitionId() << 24, 0, None

        def closed() -> Iterator[pa.RecordBatch]:
            pairs, step = names.in_order(), 50_000
            for i in range(0, len(pairs), step):
                none = [pa.nulls(1, t) for t in (id_type, *[pa.int64()] * 4, pa.string(), pa.binary())]
                own = [pa.array([i], pa.int64()), pa.array([pairs[i : i + step]]), pa.array([names.docs[i : i + step]])]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *none, *own], names=columns)

        columns = ["block", "doc_id", *_COUNTS, "groups_sha256", "packed", "base", "pairs", "docs"]
        for batch in batches:
            texts, id_type = batch.column(1).to_pylist(), batch.schema.field(0).type
            for x, y in pieces([len(t or "") for t in texts], CHUNK_CHARS):
                al = align(texts[x:y], units)
                key, times = linked(al)
                number, cuts = names(key & ((1 << 2 * _ID_BITS) - 1)), np.searchsorted(key >> 2 * _ID_BITS, np.arange(y - x + 1))
                doc_of = key >> 2 * _ID_BITS
                counts = [al.per_doc(al.docs[0]), al.per_doc(al.docs[1]), al.per_doc(al.docs[0][al.closes[0]]), np.zeros(y - x, np.int64)]
                np.add.at(counts[3], doc_of, times)
                shas = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled(al, units.sides)]
                data = [_packed(number[i:j], times[i:j], press) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                none = [pa.nulls(y - x, t) for t in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(y - x, block)), batch.column(0).slice(x, y - x), *map(pa.array, counts), pa.array(shas), pa.array(data, pa.binary()), *none], names=columns)
                held += sum(len(t or "") for t in texts[x:y])
                if len(names.sorted) > BLOCK_PAIRS or held > BLOCK_BYTES:
                    yield from closed()
                    block, held, names = block + 1, 0, Names()
        if id_type:
            yield from closed()

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return rows.mapInArrow(run, f"block long, doc_id {kind}, {counts}, groups_sha256 string, packed binary, base long, pairs array<long>, docs array<long>")


def _by_block(passed: DataFrame) -> DataFrame:
    """block, number, pair, docs: the pairs of each block."""
    rows = passed.where("base is not null").select("block", "base", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "p"))
    return rows.select("block", (F.col("base") + F.col("at")).alias("number"), F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))


def _counts(named: DataFrame) -> DataFrame:
    """pair, n (how many documents hold it), best (whether no other pair of its A id has more)."""
    counts = saved(named.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", _ID_BITS)))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """a, b, n, best: linked ids, how many documents hold them linked, and whether b is (one of) a's most frequent."""
    with arrow_batches(docs.sparkSession):
        passed = saved(_first_pass(docs, id_col, text_col, model_a, model_b))
    return _counts(_by_block(passed)).select(F.shiftright("pair", _ID_BITS).cast("int").alias("a"), F.col("pair").bitwiseAND(_MASK).cast("int").alias("b"), "n", "best")


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    with arrow_batches(docs.sparkSession):
        passed = saved(_first_pass(docs, id_col, text_col, model_a, model_b))
    named = _by_block(passed)
    value = (F.col("n") * 2 + F.col("best").cast("long")).alias("value")
    answers = named.select("block", "number", "pair").join(_counts(named).hint("merge"), "pair").select("block", "number", value)
    kind = passed.schema["doc_id"].dataType.simpleString()
    own = ["doc_id", *_COUNTS, "groups_sha256", "packed"]
    both = answers.select("block", "number", "value", *(F.lit(None).cast(passed.schema[c].dataType).alias(c) for c in own))
    both = both.unionByName(passed.where("base is null").select("block", F.lit(None).cast("long").alias("number"), F.lit(None).cast("long").alias("value"), *own))
    ordered = both.repartition("block").sortWithinPartitions("block", F.col("number").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, held, at, press = np.zeros(0, np.int64), [], None, zstandard.ZstdDecompressor()
        for batch in batches:
            block, start = batch.column(0).to_numpy(), 0
            is_doc = np.asarray(batch.column(1).is_null())
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1
            for end in [*cuts.tolist(), len(block)]:
                if start == end:
                    continue
                if block[start] != at:
                    at, held, values = block[start], [], np.zeros(0, np.int64)
                if not is_doc[start]:
                    held.append(batch.column(2).slice(start, end - start).to_numpy())
                else:
                    if held:
                        values, held = np.concatenate(held), []
                    best, total = [], []
                    for data in batch.column(9).slice(start, end - start):
                        number, times = _unpacked(data.as_py(), press)
                        v = values[number] if len(number) else number
                        best.append(int(times[(v & 1) == 1].sum()) if len(v) else 0)
                        total.append(int((times * (v >> 1)).sum()))
                    kept = [batch.column(i).slice(start, end - start) for i in range(3, 9)]
                    yield pa.RecordBatch.from_arrays([*kept[:5], pa.array(best, pa.int64()), pa.array(total, pa.int64()), kept[5]], names=["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])
                start = end

    counts = ", ".join(f"{c} long" for c in (*_COUNTS, "n_best", "count_sum"))
    return ordered.mapInArrow(run, f"doc_id {kind}, {counts}, groups_sha256 string")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
