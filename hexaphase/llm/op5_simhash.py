"""SimHash near-dedup by segment popcounts on a grid.

Fingerprints: three-word shingles of the whole text, hashed by XXH64 with seed 42; a bit is set if it is set in over half of
the hashes. Documents of one fingerprint are one class, so copies never meet as pairs.

Search: each of a fingerprint's 32 segments of two bits has a bit count of 0, 1 or 2; the vector of counts embeds the
fingerprint, and the Manhattan distance of two vectors never exceeds the fingerprints' Hamming distance. The vectors are
points of a grid. Of two points at most 3 apart, the first halves (16 segments) or the second ones are at most 1 apart.
So every class lies in the two cells that its halves name, and looks into each half's own cell and those one step up in
one coordinate; of two cells one step apart, one is up from the other. Pairs that meet are held against the Manhattan
bound over the whole vector first, and those that remain against the Hamming distance itself: no link is missed, and none
is false. Counts are kept in unary (00, 01, 11), so that the Manhattan distance is the bit count of an exclusive or.

Components: the smallest id spreads along links by alternating large-star and small-star rounds, each written to the shared
folder, until nothing changes.

Defined cases: a null or empty text has the fingerprint zero and links like any other; with one or two words the whole
sequence is hashed. Very long texts are hashed whole, in pieces. A bit set in just half of the hashes is 0. Repeated rows are
each reported. Null doc_ids are reported, and count as the largest ids. An empty table gives no rows. Other columns, whatever
their names, are not read, and drop_near_duplicates() returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BLANK, fresh, join_keyed, saved, table

SHINGLE, MAX_BITS = 3, 3
HALF = 16
_LOW = 0x5555555555555555


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: bytes, width: int = SHINGLE) -> int:
    words = text.translate(LOWER_BLANK).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    else:
        starts = np.concatenate([[0], ends[: len(words) - width] + 1]).tolist()
        view = memoryview(line)
        hashes = np.array(list(map(xxhash.xxh64_intdigest, [view[a:b] for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], repeat(42))), np.uint64)
    return majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed bigint."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py() or b"") for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _embedded(fp: str) -> str:
    """SQL: the segments' bit counts of fp in unary, two bits each."""
    half = f"shiftrightunsigned({fp}, 1)"
    return f"((({fp} | {half}) & {_LOW}L) | shiftleft(({fp} & {half}) & {_LOW}L, 1))"


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """a < b: the pairs of the distinct fingerprints in column fp that differ in bits bits or fewer, 3 at most."""
    if bits > MAX_BITS:
        raise ValueError("two halves of the grid hold for 3 bits at most")
    points = fps.select("fp", F.expr(_embedded("fp")).alias("_t"))
    halves = points.select("fp", F.explode(F.expr("array(_t & 4294967295L, shiftrightunsigned(_t, 32) | 4294967296L)")).alias("cell"))
    # up from 00 is 01, up from 01 is 11
    up = f"transform(sequence(0, {HALF - 1}), j -> case cast(shiftright(cell, 2 * j) & 3 as int) when 0 then cell + shiftleft(1L, 2 * j) when 1 then cell + shiftleft(2L, 2 * j) end)"
    probes = halves.select(F.col("fp").alias("_p"), "cell", F.explode(F.expr(f"concat(array(cell), filter({up}, x -> x is not null))")).alias("_at"))
    met = halves.hint("merge").join(probes.withColumnRenamed("cell", "_own").withColumnRenamed("_at", "cell").hint("merge"), "cell")
    met = met.where("fp != _p and (cell != _own or fp > _p)")
    met = met.where(f"bit_count({_embedded('fp')} ^ {_embedded('_p')}) <= {bits}").where(f"bit_count(fp ^ _p) <= {bits}")
    return met.select(F.least("fp", "_p").alias("a"), F.greatest("fp", "_p").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that it reaches: of all nodes in columns a and b."""
    edges, before = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()), None
    while True:
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.union(least).distinct())
    roots = edges.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id."""
    fps = saved(fingerprints(docs, id_col, text_col))
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")))
    roots = saved(components(links(classes)).withColumnRenamed("node", "fp"))
    linked = roots.join(classes, "fp").select("fp", "root", "id")
    least = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "component_id")
    classes = saved(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "id").alias("component_id"), "rows"))
    return join_keyed(fps, classes, ["fp"], "rows").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns. doc_id names a document: an id goes with all its rows."""
    (name,) = fresh("gone")
    gone = near_duplicates(docs, id_col, text_col).where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    gone = saved(gone)  # so that its size is known when the join is planned
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
