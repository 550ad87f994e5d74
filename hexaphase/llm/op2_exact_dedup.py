"""Exact dedup by counting quotient filters.

A fingerprint of 64 bits splits into block (its leading bits), quotient and remainder. Each task builds one filter per
block over its own rows: which quotients occur, how long each one's run is, the sorted remainders of the runs and their
counts. The filters of a block merge without loss: runs of sorted remainders are merged and equal ones add their
counts. Fingerprints with a count above one route their rows to byte verification, which groups by the text itself, so
that a collision of fingerprints cannot join two texts.

Defined cases: a null text counts as empty, and all empty or blank texts are one group. Rows with equal text, equal
length and equal doc_id are alike: each is reported, and each is kept if that id is kept; drop_exact_duplicates() leaves one
of them. Of equally long texts the smallest doc_id stays; null doc_ids sort last. Very long texts are handled whole, by the
JVM. An empty table gives no rows. Columns other than the id and the text, whatever their names, are not read, and
drop_exact_duplicates() returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, columns, fresh, join_keyed, saved, shards, table


class CountingQuotientFilter:
    """A multiset of the fingerprints of one block, without the leading bits that all of them share."""

    def __init__(self, bits: int, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> None:
        self.bits, self.quotients, self.runs, self.remainders, self.counts = bits, quotients, runs, remainders, counts

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """keys: sorted and distinct, below 2**bits."""
        quotient_bits = cls.quotient_bits(len(keys), bits)
        q = keys >> np.uint64(bits - quotient_bits)
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        occupied = np.zeros(1 << quotient_bits, np.uint8)
        occupied[q[first].astype(np.int64)] = 1
        rest = keys & np.uint64((1 << (bits - quotient_bits)) - 1)
        return cls(bits, np.packbits(occupied), np.diff(np.append(first, len(q))).astype(np.uint32), rest, counts.astype(np.uint64))

    @staticmethod
    def quotient_bits(n: int, bits: int) -> int:
        """For a filter of n distinct fingerprints: about one quotient for each."""
        return min(bits, max(1, n.bit_length()))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        width = self.quotient_bits(len(self.remainders), self.bits)
        q = np.repeat(np.flatnonzero(np.unpackbits(self.quotients)[: 1 << width]).astype(np.uint64), self.runs.astype(np.int64))
        return (q << np.uint64(self.bits - width)) | self.remainders, self.counts

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter], bits: int) -> CountingQuotientFilter:
        keys, counts = (np.concatenate(x) for x in zip(*(f.items() for f in filters), strict=True))
        # each filter's items ascend: a stable sort of them end to end merges those runs, without ordering any anew
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return cls.build(keys[first], np.add.reduceat(counts, first), bits)

    def dump(self) -> dict[str, bytes]:
        """Numbers take as many bytes as the largest of their kind needs."""
        return {"quotients": self.quotients.tobytes()} | {k: _narrow(getattr(self, k)) for k in ("runs", "remainders", "counts")}

    @classmethod
    def load(cls, bits: int, quotients: bytes, runs: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        return cls(bits, np.frombuffer(quotients, np.uint8), *map(_wide, (runs, remainders, counts)))


def _narrow(a: np.ndarray) -> bytes:
    size = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _wide(data: bytes) -> np.ndarray:
    size = data[0]
    out = np.zeros(((len(data) - 1) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, size)
    return out.view("<u8").reshape(-1)


_PARTS = ("quotients", "runs", "remainders", "counts")
_FILTERS = "block int, quotients binary, runs binary, remainders binary, counts binary"


def _filters(block_bits: int):
    bits = 64 - block_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def emit():
            block = (keys >> np.uint64(bits)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
            rows = []
            for a, b in zip(cut, [*cut[1:], len(keys)], strict=True):
                rows.append({"block": int(block[a])} | CountingQuotientFilter.build(keys[a:b] & np.uint64((1 << bits) - 1), counts[a:b], bits).dump())
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("block", pa.int32()), *((k, pa.binary()) for k in _PARTS)]))

        for batch in batches:
            new = np.sort(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]])) if len(new) else np.zeros(0, np.int64)
            keys = np.concatenate([keys, new[first]])
            counts = np.concatenate([counts, np.diff(np.append(first, len(new))).astype(np.uint64)])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            if len(keys):
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                keys, counts = keys[first], np.add.reduceat(counts, first)
            if len(keys) > 1 << 21:  # bounded memory: a task may give several filters of a block
                yield emit()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield emit()

    return build


def _repeated(block_bits: int):
    bits = 64 - block_bits

    def merge(rows: pa.Table) -> pa.Table:
        cols = [rows.column(k).to_pylist() for k in _PARTS]
        keys, counts = CountingQuotientFilter.merge([CountingQuotientFilter.load(bits, *x) for x in zip(*cols, strict=True)], bits).items()
        keys = keys[counts > 1] | np.uint64(rows.column("block")[0].as_py() << bits)
        return pa.table({"fp": keys.view(np.int64)})

    return merge


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bits: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    block_bits: the leading bits that name a filter's block; by default the blocks are as many as shuffle partitions.
    """
    spark = docs.sparkSession
    block_bits = block_bits or max(1, (shards(spark) - 1).bit_length())
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(text, SPACE + "+", "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n"), norm.alias("norm")).withColumn("fp", F.xxhash64("norm"))
    light = saved(rows.select("doc_id", "n", "fp", F.sha2("norm", 256).alias("sha")))
    filters = light.select("fp").mapInArrow(_filters(block_bits), _FILTERS)
    repeated = saved(filters.groupBy("block").applyInArrow(_repeated(block_bits), "fp long"))
    # byte verification: equal only if the bytes are; copies meet in the map-side aggregate first
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best")
    classes = rows.join(repeated, "fp", "left_semi").groupBy("fp", "norm").agg(best, F.count("*").alias("group_size"))
    classes = saved(classes.select("fp", F.sha2("norm", 256).alias("sha"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.m")).alias("keep_n"), "group_size"))
    out = join_keyed(light, classes.withColumn("rows", F.col("group_size")), ["fp", "sha"], "rows", "left")
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("n").alias("n_chars"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows alike in id and text, one stays: the first by its other columns."""
    i, n, sha, place, rows, stay = fresh("i", "n", "sha", "place", "rows", "stay")
    found = saved(exact_duplicates(docs, id_col, text_col).select(F.col("doc_id").alias(i), F.col("n_chars").alias(n), F.col("text_sha256").alias(sha), "kept"))
    ids = found.groupBy(i).agg(F.count("*").alias(rows), F.count_if("kept").alias(stay))
    gone = saved(ids.where(F.col(stay) == 0).select(i))  # saved, so that its size is known when the join is planned
    care = saved(ids.where((F.col(stay) > 0) & (F.col(rows) > 1)).select(i))  # ids of several rows: as good as none where doc_id names a row
    by_id = docs[id_col].eqNullSafe(F.col(i))
    single = docs.join(gone.union(care), by_id, "left_anti")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own_i, own_n, own_sha, care_i = fresh("own_i", "own_n", "own_sha", "care_i")
    named = docs.join(care, by_id, "left_semi")
    named = named.withColumns({own_i: F.col(id_col), own_n: F.length(text).cast("long"), own_sha: F.sha2(F.regexp_replace(text, SPACE + "+", ""), 256)})
    kept = found.where("kept").select(i, n, sha).join(care.withColumnRenamed(i, care_i), F.col(i).eqNullSafe(F.col(care_i)), "left_semi").distinct()
    named = named.join(kept, F.col(own_i).eqNullSafe(F.col(i)) & (F.col(own_n) == F.col(n)) & (F.col(own_sha) == F.col(sha)), "left_semi")
    first = F.row_number().over(Window.partitionBy(own_i, own_n, own_sha).orderBy(*columns(docs)))
    return single.unionByName(named.withColumn(place, first).where(F.col(place) == 1).select(*columns(docs)))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256, n.n AS n_chars
FROM n JOIN g ON n.norm = g.norm
"""
