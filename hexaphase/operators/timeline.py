"""The sample axis: continuity, epochs, hops, windows and frames, all as window functions.

Rows are in arrival order within a session, given by order columns. An epoch's sample axis starts at 0; window ids run on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CONTEXT, HOP, SAMPLE_RATE


def continuity(df: DataFrame, session: list[str], order: list[str], seq: str, ts: str, tolerance, health: Column, rate: str | None = None, calibration: str | None = None, expected: Column | None = None) -> DataFrame:
    """Adds reason: the first of a pending health event, changed sample rate, changed calibration, gap in the sequence, gap in time. expected: the step of ts."""
    w = Window.partitionBy(*session).orderBy(*order)
    reason = F.when(health, F.lit("health_event"))
    started = F.lag(seq).over(w).isNotNull()
    if rate:
        reason = reason.when(started & (F.col(rate) != F.lag(rate).over(w)), "sample_rate_change")
    if calibration:
        reason = reason.when(started & (F.col(calibration) != F.lag(calibration).over(w)), "calibration_change")
    reason = reason.when(started & (F.col(seq) != F.lag(seq).over(w) + 1), "sequence_gap")
    step = F.lit(0) if expected is None else expected
    return df.withColumn("reason", reason.when(started & (F.abs(F.col(ts) - F.lag(ts).over(w) - step) > tolerance), "timestamp_gap"))


def numbered(df: DataFrame, session: list[str], order: list[str], seq: str, ts: str, frames: Column, origin: float = 0.0, rate: int = SAMPLE_RATE) -> DataFrame:
    """Gives blocks without a number their place in the session, and those without a time that of the samples before them."""
    w = Window.partitionBy(*session).orderBy(*order)
    place = F.row_number().over(w) - 1
    before = F.coalesce(F.sum(frames).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumns({seq: F.coalesce(F.col(seq), place), ts: F.coalesce(F.col(ts), F.lit(origin) + before / rate)})


def run_ids(df: DataFrame, session: list[str], order: list[str], reason: str = "reason") -> DataFrame:
    """Adds run: it grows with every reset that the calibration's delay line sees, which knows health events and gaps only."""
    w = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("run", F.count(F.when(F.col(reason).isin("health_event", "sequence_gap", "timestamp_gap"), 1)).over(w))


def epochs(df: DataFrame, session: list[str], order: list[str], frames: Column) -> DataFrame:
    """Adds epoch, start_sample and end_sample to rows with a reason."""
    w = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("epoch", F.count("reason").over(w)).withColumn("_n", frames)
    inner = Window.partitionBy(*session, "epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("end_sample", F.sum("_n").over(inner)).withColumn("start_sample", F.col("end_sample") - F.col("_n")).drop("_n")


def discontinuities(df: DataFrame, session: list[str], order: list[str], last: int = 256) -> DataFrame:
    """The last resets of each session."""
    w = Window.partitionBy(*session).orderBy(*(F.desc(c) for c in order))
    resets = df.where(F.col("reason").isNotNull()).withColumn("_r", F.row_number().over(w))
    return resets.where(F.col("_r") <= last).select(*session, *order, (F.col("epoch") - 1).alias("old_epoch"), F.col("epoch").alias("new_epoch"), "reason")


def coalesce_bursts(df: DataFrame, session: list[str], order: str, is_drop: Column, lost: Column) -> DataFrame:
    """One row per burst of consecutive drops: its first and last place, its events and its lost samples."""
    w = Window.partitionBy(*session).orderBy(order)
    island = df.withColumn("_drop", is_drop).withColumn("_island", F.sum(F.when(F.col("_drop"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.where("_drop").groupBy(*session, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("events"), F.sum(lost).alias("lost")).drop("_island")


def release(events: DataFrame, blocks: DataFrame, session: str, after: str, seq: str, at: str) -> DataFrame:
    """Adds released_at: the first block not before the event's first sequence after the gap; an event without one at once; null: held."""
    e = events.select(session, F.col(after).alias("_k"), F.lit(0).alias("_o"), F.lit(None).cast("long").alias("_b"), F.struct(*events.columns).alias("_e"))
    b = blocks.select(session, F.col(seq).alias("_k"), F.lit(1).alias("_o"), F.col(seq).alias("_b"), F.lit(None).cast(e.schema["_e"].dataType).alias("_e"))
    w = Window.partitionBy(session).orderBy("_k", "_o").rowsBetween(0, Window.unboundedFollowing)
    out = e.unionByName(b).withColumn("_at", F.first("_b", ignorenulls=True).over(w)).where("_o = 0")
    return out.select("_e.*", F.when(F.col("_k").isNull(), F.col(f"_e.{at}")).otherwise(F.col("_at")).alias("released_at"))


def rechunk(df: DataFrame, session: list[str], order: str, frames: Column, hop: int = HOP) -> DataFrame:
    """Complete hops made of blocks of any size: session, hop, first and last block."""
    w = Window.partitionBy(*session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    b = df.withColumn("_n", frames).withColumn("_e", F.sum("_n").over(w)).withColumn("_s", F.col("_e") - F.col("_n"))
    parts = b.withColumn("hop", F.explode(F.expr(f"sequence(_s div {hop}, (_e - 1) div {hop})")))
    inside = F.expr(f"least(_e, (hop + 1) * {hop}) - greatest(_s, hop * {hop})")
    return parts.groupBy(*session, "hop").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.sum(inside).alias("_n")).where(F.col("_n") == hop).drop("_n")


def sliding(df: DataFrame, session: list[str], value: str | None = None, context: int = CONTEXT, hop: int = HOP) -> DataFrame:
    """Full windows of context samples, one per hop, within an epoch; window_id runs on over epochs."""
    rows = context // hop
    w = Window.partitionBy(*session, "epoch").orderBy("end_sample").rowsBetween(1 - rows, 0)
    df = df.withColumn("_k", F.count("*").over(w))
    if value:
        df = df.withColumn("context_mean", F.avg(value).over(w))
    full = df.where(F.col("_k") == rows).drop("_k").withColumn("context_start", F.col("end_sample") - context).withColumnRenamed("end_sample", "decision_sample")
    ids = Window.partitionBy(*session).orderBy("epoch", "decision_sample")
    return full.withColumn("window_id", (F.row_number().over(ids) - 1).cast("long"))


def frame_grid(df: DataFrame, session: list[str], size: int = 960, step: int = 480) -> DataFrame:
    """Starts of the overlapping frames of each epoch."""
    total = df.groupBy(*session, "epoch").agg(F.max("end_sample").alias("_n")).where(F.col("_n") >= size)
    return total.select(*session, "epoch", F.explode(F.expr(f"sequence(0L, (_n - {size}) div {step} * {step}, {step}L)")).alias("frame_start"))


def dedup_events(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first arrival of each event id."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("_r"))
    return first.select(key, "_r.*")
