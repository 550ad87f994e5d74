"""Track histories: sparse trajectories of the tracks seen last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequential import sampled

SUBMIT_SAMPLES, POINT_SAMPLES, MAX_TRACKS, MAX_POINTS = 48_000, 240_000, 64, 240


def histories(tracks: DataFrame, keys: list[str], max_tracks: int = MAX_TRACKS, max_points: int = MAX_POINTS, gap: int = POINT_SAMPLES) -> DataFrame:
    """tracks: keys, track_id, decision_sample, first_seen, last_observed, theta. One row per kept track: duration_s and trajectory (sample, degrees to one place)."""
    points = sampled(tracks.select(*keys, "track_id", "decision_sample", "theta"), [*keys, "track_id"], ["decision_sample"], "decision_sample", gap)
    last = Window.partitionBy(*keys, "track_id").orderBy(F.desc("decision_sample"))
    points = points.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= max_points)
    lines = points.groupBy(*keys, "track_id").agg(F.array_sort(F.collect_list(F.struct("decision_sample", F.bround("theta", 1).alias("theta")))).alias("trajectory"))
    ends = tracks.groupBy(*keys, "track_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_observed").alias("last_observed"), F.max("decision_sample").alias("_touched"))
    recent = Window.partitionBy(*keys).orderBy(F.desc("_touched"), F.desc("track_id"))
    ends = ends.withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= max_tracks)
    return ends.join(lines, [*keys, "track_id"]).select(*keys, "track_id", ((F.col("last_observed") - F.col("first_seen")) / 48_000.0).alias("duration_s"), "trajectory")
