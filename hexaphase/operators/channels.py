"""Blocks of interleaved samples: decoding, channel maps, calibration, meters. Samples come as (session, seq, i, c, x)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import level_db, mean_db
from ..model import CHANNEL_MAP, DELAYS, GAINS, MICS, POLARITY


def _by_channel(values, default=0) -> Column:
    """A constant per channel, as a lookup that stays in generated code."""
    return F.coalesce(F.element_at(F.array(*map(F.lit, values)), (F.col("c") + 1).cast("int")) if len(values) == 8 else F.when(F.col("c") < len(values), F.try_element_at(F.array(*map(F.lit, values)), (F.col("c") + 1).cast("int"))), F.lit(default))


def encode_pcm16(blocks: DataFrame, col: str = "samples", to: str = "payload") -> DataFrame:
    """Little-endian 16-bit words: clipped, rounded half to even."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.clip(np.rint(np.array(x) * 32768.0), -32768, 32767).astype("<i2").tobytes() for x in b.column(b.schema.get_field_index(col)).to_pylist()]
            keep = [i for i, n in enumerate(b.schema.names) if n != col]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(raw, pa.binary())], names=[*(b.schema.names[i] for i in keep), to])

    fields = [f for f in blocks.schema.fields if f.name != col]
    return blocks.mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + [f"{to} binary"]))


def pcm16(payload: bytes, channels: int) -> np.ndarray:
    """Samples in [-1, 1), row by row; a payload that is no whole number of rows is an error."""
    if len(payload) % (2 * channels):
        raise ValueError(f"a payload is no whole number of rows of {channels} channels")
    return np.frombuffer(payload, "<i2").astype(np.float32) / np.float32(32768)


def decode(blocks: DataFrame, decoder: Callable[[bytes, int], np.ndarray] = pcm16, channels: int = 8, col: str = "payload", to: str = "samples") -> DataFrame:
    """blocks with their samples in place of the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.asarray(decoder(x.as_py(), channels), np.float32).ravel() for x in b.column(b.schema.get_field_index(col))]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            samples = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.float32), *rows])))
            keep = [i for i, n in enumerate(b.schema.names) if n != col]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), samples], names=[*(b.schema.names[i] for i in keep), to])

    fields = [f for f in blocks.schema.fields if f.name != col]
    return blocks.mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + [f"{to} array<float>"]))


def decode_pcm16(blocks: DataFrame, channels: int = 8, col: str = "payload", to: str = "samples") -> DataFrame:
    return decode(blocks, pcm16, channels, col, to)


def permute(blocks: DataFrame, mapping: tuple[int, ...] = CHANNEL_MAP, col: str = "samples") -> DataFrame:
    """Logical channel j of each sample is native channel mapping[j]."""
    if sorted(mapping) != list(range(len(mapping))):
        raise ValueError("the channel map is no permutation")
    n, at = len(mapping), ", ".join(map(str, mapping))
    return blocks.withColumn(col, F.expr(f"transform({col}, (x, k) -> {col}[cast((k div {n}) * {n} + element_at(array({at}), cast(k % {n} + 1 as int)) as int)])"))


def select_channel(blocks: DataFrame, channel: int, channels: int = 8, col: str = "samples") -> DataFrame:
    return blocks.withColumn(col, F.expr(f"filter({col}, (x, k) -> k % {channels} = {channel})"))


def physical(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("c") < MICS)


def calibrate_gain(samples: DataFrame, gains=GAINS, polarity=POLARITY) -> DataFrame:
    """Gain and sign of the microphones; the mixed channel stays."""
    return samples.withColumn("x", F.col("x") * _by_channel([g * p for g, p in zip(gains, polarity, strict=True)] + [1.0], 1.0))


def calibrate_delay(samples: DataFrame, delays=DELAYS, run: tuple[str, ...] = ("session",)) -> DataFrame:
    """Integer delays by channel, zeros before the start of each run."""
    w = Window.partitionBy(*run, "c").orderBy("seq", "i")
    shifted = [F.coalesce(F.lag("x", d).over(w) if d else F.col("x"), F.lit(0.0)) for d in range(max(delays) + 1)]
    d = _by_channel([*delays, 0])
    out = shifted[0]
    for k, s in enumerate(shifted[1:], 1):
        out = F.when(d == k, s).otherwise(out)
    return samples.withColumn("x", out)


def meter(samples: DataFrame) -> DataFrame:
    """Per block and channel: RMS, peak, their levels, and whether it clips."""
    m = samples.groupBy("session", "seq", "c").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))
    return m.select("session", "seq", "c", "rms", "peak", level_db("rms").alias("rms_db"), level_db("peak").alias("peak_db"), (F.col("peak") >= 0.999).alias("clipped"))


def smoothed_meter(metered: DataFrame, rows: int = 10) -> DataFrame:
    """The level's mean over the last rows blocks, in the power domain."""
    w = Window.partitionBy("session", "c").orderBy("seq").rowsBetween(1 - rows, 0)
    return metered.withColumn("mean_db", mean_db("rms_db", w))


def lag_correlation(samples: DataFrame, reference: int = 6, reach: int = 3) -> DataFrame:
    """Per session and channel the lag at which it is most like the reference channel, and the normalised correlation there."""
    w = Window.partitionBy("session", "c").orderBy("seq", "i")
    ref = samples.where(F.col("c") == reference).select("session", "seq", "i", F.col("x").alias("r"))
    both = samples.where((F.col("c") < MICS) & (F.col("c") != reference)).join(ref, ["session", "seq", "i"])
    long = both.select("session", "c", "x", "r", *(F.lag("r", k).over(w).alias(f"k{k + reach}") if k >= 0 else F.lead("r", -k).over(w).alias(f"k{k + reach}") for k in range(-reach, reach + 1)))
    sums = long.groupBy("session", "c").agg(*(F.sum(F.col("x") * F.col(f"k{k}")).alias(f"s{k}") for k in range(2 * reach + 1)), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("r") * F.col("r"))).alias("norm"))
    best = F.array_max(F.array(*(F.struct(F.abs(F.col(f"s{k}")).alias("a"), F.lit(-k).alias("k"), F.col(f"s{k}").alias("s")) for k in range(2 * reach + 1))))
    return sums.withColumn("b", best).select("session", "c", (-F.col("b.k") - reach).cast("long").alias("lag"), (F.col("b.s") / F.col("norm")).alias("correlation"))
