"""Hops and windows with their samples, cut from blocks of any size.

A hop that lies inside a block is a slice of its array and stays in the block's row. Only what a block's ends leave over moves:
pieces of hops at block borders meet by (session, epoch, hop) and are put together in order. Nothing is exploded into samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CHANNELS, CONTEXT, HOP
from .acoustics import CHUNK_HOPS, chunked

KEYS = ["session", "epoch"]


def hops(blocks: DataFrame, channels: int = CHANNELS, hop: int = HOP) -> DataFrame:
    """session, epoch, hop, start_sample, end_sample, sequence_ids, samples: the full hops of blocks (session, epoch, seq, start_sample, samples), in which an epoch's sample axis starts at 0."""
    b = blocks.withColumn("_end", F.col("start_sample") + F.size("samples") / channels).where(F.size("samples") > 0).withColumn("_end", F.col("_end").cast("long"))
    b = b.withColumn("hop", F.explode(F.expr(f"sequence(start_sample div {hop}, (_end - 1) div {hop})")))
    b = b.withColumn("_from", F.greatest("start_sample", F.col("hop") * hop)).withColumn("_n", F.least("_end", (F.col("hop") + 1) * hop) - F.col("_from"))
    first = ((F.col("_from") - F.col("start_sample")) * channels + 1).cast("int")
    b = b.select(*KEYS, "hop", "seq", "_from", "_n", F.slice("samples", first, (F.col("_n") * channels).cast("int")).alias("samples"))
    whole = b.where(F.col("_n") == hop).select(*KEYS, "hop", F.array("seq").alias("sequence_ids"), "samples")
    pieces = b.where(F.col("_n") < hop).groupBy(*KEYS, "hop").agg(F.sum("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_from", "seq", "samples"))).alias("_p"))
    joined = pieces.where(F.col("_n") == hop).select(*KEYS, "hop", F.col("_p.seq").alias("sequence_ids"), F.flatten("_p.samples").alias("samples"))
    start = F.col("hop") * hop
    return whole.unionByName(joined).select(*KEYS, "hop", start.alias("start_sample"), (start + hop).alias("end_sample"), "sequence_ids", "samples")


def windows(cut: DataFrame, context: int = CONTEXT, hop: int = HOP, chunk: int = CHUNK_HOPS) -> DataFrame:
    """session, epoch, window_id, decision_sample, sequence_ids, samples of the full windows of hops(). A long epoch goes in chunks over many tasks; only the numbers of windows are made over whole sessions."""
    n = context // hop
    inner = Window.partitionBy(*KEYS, "chunk").orderBy("hop").rowsBetween(1 - n, 0)
    rows = chunked(cut, chunk, n - 1).withColumn("_first", F.min("hop").over(inner)).withColumn("_n", F.count("*").over(inner))
    rows = rows.withColumns({"_s": F.collect_list("samples").over(inner), "_q": F.collect_list("sequence_ids").over(inner)})
    full = rows.where("own").where(F.col("_n") == n).where(F.col("_first") == F.col("hop") - n + 1)
    full = full.select(*KEYS, F.col("end_sample").alias("decision_sample"), F.array_distinct(F.flatten("_q")).alias("sequence_ids"), F.flatten("_s").alias("samples"))
    before = cut.groupBy(*KEYS).agg(F.greatest(F.lit(0), F.max("hop") - n + 2).alias("_w"))
    earlier = Window.partitionBy("session").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*KEYS, F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_base"))
    number = (F.col("_base") + (F.col("decision_sample") - context) / hop).cast("long")
    return full.join(before, KEYS).select(*KEYS, number.alias("window_id"), "decision_sample", "sequence_ids", "samples")
