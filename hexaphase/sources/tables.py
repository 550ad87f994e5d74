"""The driver's tables in the engine's data model.

embeddings: one row is a block of 8 samples of 8 channels; label is the session and vec_id the sequence number.
events: the rows of a user_id, by (ts, event_id), are a stream of hops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, samples: array of 64 doubles, row by row."""
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("session"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("samples"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, i (sample in the block), c (channel), x."""
    long = blocks(spark, sf_dir).select("session", "seq", F.posexplode("samples").alias("k", "x"))
    return long.select("session", "seq", F.expr("cast(k div 8 as long)").alias("i"), F.expr("cast(k % 8 as long)").alias("c"), "x")


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, us, event_type, value, h (place in the stream), p (probability), angle."""
    ev = read(spark, sf_dir, "events").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"), "event_type", "value")
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    return ev.withColumn("h", (F.row_number().over(order) - 1).cast("long")).withColumns({"p": F.least(F.col("value") / 100, F.lit(1.0)), "angle": F.pmod(F.col("value") * 3.6, F.lit(360.0))})
