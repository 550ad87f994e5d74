"""Spectra, pair and covariance features of eight-sample blocks in relational form; the kernels of full size are in kernels/.

A block is one row, and its spectrum stays in that row as an array by channel and bin, so nothing here moves between tasks but
the means over a session's blocks, which are aggregated before they move.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import power_db, robust_z
from ..model import MICS

N_FFT = 8
_BINS = N_FFT // 2 + 1


def _turns(f) -> str:
    return "array(" + ", ".join(f"{f(2 * math.pi * n / N_FFT)!r}D" for n in range(N_FFT)) + ")"


def spectrum(blocks: DataFrame) -> DataFrame:
    """session, seq, and spec: by channel and bin the real and imaginary part of the mean-free block's transform, and its power. blocks: samples row by row."""
    sums = lambda turns: f"aggregate(sequence(0, 7), 0D, (acc, i) -> acc + get(x, i) * get({turns}, (k * i) % {N_FFT}))"
    rows = blocks.select("session", "seq", F.expr(f"transform(sequence(0, 7), c -> transform(sequence(0, {N_FFT - 1}), i -> get(samples, 8 * i + c)))").alias("x"))
    free = rows.withColumn("x", F.expr(f"transform(x, v -> transform(v, y -> y - aggregate(v, 0D, (acc, z) -> acc + z) / {N_FFT}))"))
    parts = f"transform(x, x -> transform(sequence(0, {_BINS - 1}), k -> named_struct('re', {sums(_turns(math.cos))}, 'im', -{sums(_turns(math.sin))})))"
    power = f"transform({parts}, v -> transform(v, z -> named_struct('re', z.re, 'im', z.im, 'power', (z.re * z.re + z.im * z.im) / {N_FFT})))"
    return free.select("session", "seq", F.expr(power).alias("spec"))


def _channels(spectra: DataFrame, mics: int = 8) -> DataFrame:
    """session, seq, c, v: the bins of a channel."""
    return spectra.select("session", "seq", F.posexplode(F.slice("spec", 1, mics)).alias("c", "v")).withColumn("c", F.col("c").cast("long"))


def dft(spectra: DataFrame) -> DataFrame:
    """session, seq, c, k, re, im, power."""
    return _channels(spectra).select("session", "seq", "c", F.posexplode("v").alias("k", "z")).select("session", "seq", "c", F.col("k").cast("long").alias("k"), "z.*")


def smooth3(spectra: DataFrame) -> DataFrame:
    """1/4, 1/2, 1/4 of the power over neighbouring bins; the edges repeat."""
    last = _BINS - 1
    smooth = f"transform(sequence(0, {last}), k -> named_struct('k', cast(k as long), 'smooth', 0.25D * get(v, greatest(k - 1, 0)).power + 0.5D * get(v, k).power + 0.25D * get(v, least(k + 1, {last})).power))"
    return _channels(spectra).select("session", "seq", "c", F.inline(F.expr(smooth)))


def band_mean(spectra: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    total = sum((F.get("v", F.lit(k))["power"] for k in range(low, high + 1)), F.lit(0.0))
    return _channels(spectra).select("session", "seq", "c", power_db(total / (high - low + 1)).alias("band_db"))


#: Presence weights of bins 1 to 3, which sum to one.
BIN_WEIGHTS = (0.30, 0.30, 0.40)
_P1 = f"greatest(0D, least(1D, ({' + '.join(f'{w}D * get(v, {k}).power' for k, w in enumerate(BIN_WEIGHTS, 1))}) / greatest(aggregate(v, 0D, (acc, z) -> acc + z.power), 1e-12D)))"


def presence(spectra: DataFrame) -> DataFrame:
    """Per block and microphone: the weighted sum of each bin's share of the block's power, p1 in [0, 1]."""
    return _channels(spectra, MICS).select("session", "seq", "c", F.expr(_P1).alias("p1"))


def p2(spectra: DataFrame) -> DataFrame:
    """The exact median of p1 over the microphones."""
    return spectra.select("session", "seq", F.expr(f"get(array_sort(transform(slice(spec, 1, {MICS}), v -> {_P1})), {MICS // 2})").alias("p2"))


_PAIRS = "array(" + ", ".join(f"named_struct('a', {a}L, 'b', {b}L)" for a in range(MICS) for b in range(a + 1, MICS)) + ")"


def pair_bins(spectra: DataFrame) -> DataFrame:
    """session, seq, a, b, x: PHAT cross-spectra of microphone pairs a < b, by bin. The floor follows the block's greatest magnitude."""
    size = lambda z: f"sqrt({z}.re * {z}.re + {z}.im * {z}.im)"
    top = f"aggregate(slice(spec, 1, {MICS}), 0D, (acc, v) -> greatest(acc, aggregate(v, 0D, (m, z) -> greatest(m, {size('z')}))))"
    x = spectra.withColumn("floor", F.expr(f"1e-12D * greatest({top}, 1D)"))
    x = x.select("session", "seq", "spec", "floor", F.inline(F.expr(_PAIRS)))
    x = x.select("session", "seq", "a", "b", "floor", F.expr("zip_with(get(spec, cast(a as int)), get(spec, cast(b as int)), (p, q) -> named_struct('p', p, 'q', q))").alias("z"))
    d = f"greatest({size('z.p')} * {size('z.q')}, floor)"
    return x.select("session", "seq", "a", "b", F.expr(f"transform(z, z -> named_struct('re', (z.p.re * z.q.re + z.p.im * z.q.im) / {d}, 'im', (z.p.im * z.q.re - z.p.re * z.q.im) / {d}))").alias("x"))


def pairs(spectra: DataFrame) -> DataFrame:
    """session, seq, k, a, b, re, im of the cross-spectra."""
    return pair_bins(spectra).select("session", "seq", "a", "b", F.posexplode("x").alias("k", "x")).select("session", "seq", F.col("k").cast("long").alias("k"), "a", "b", "x.*")


def gcc(spectra: DataFrame, lags: tuple[int, ...] = (-2, -1, 0, 1, 2)) -> DataFrame:
    """Per pair and lag: the mean over bins 1 to 3 of Re C exp(2 pi j k lag / 8)."""
    parts = []
    for lag in lags:
        turns = [2 * math.pi * ((k * lag) % N_FFT) / N_FFT for k in range(4)]
        mean = sum((F.get("x", F.lit(k))["re"] * math.cos(turns[k]) - F.get("x", F.lit(k))["im"] * math.sin(turns[k]) for k in (1, 2, 3)), F.lit(0.0)) / 3
        parts.append(F.struct(F.lit(lag).cast("long").alias("lag"), mean.alias("gcc")))
    return pair_bins(spectra).select("session", "seq", "a", "b", F.inline(F.array(*parts)))


def peak_z(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the greatest value and its robust z: two medians."""
    w = Window.partitionBy(*keys)
    m = values.withColumn("_m", F.median(value).over(w))
    out = m.groupBy(*keys).agg(F.max(value).alias("peak"), F.first("_m").alias("median"), F.median(F.abs(F.col(value) - F.col("_m"))).alias("mad"))
    return out.withColumn("z", robust_z("peak", "median", "mad"))


def covariance(spectra: DataFrame, bins: tuple[int, int] = (1, 3)) -> DataFrame:
    """Per session and bin the mean of x x^H over blocks, entries (a, b) of the upper triangle."""
    upper = "array(" + ", ".join(f"named_struct('a', {a}L, 'b', {b}L)" for a in range(MICS) for b in range(a, MICS)) + ")"
    x = spectra.select("session", "spec", F.explode(F.sequence(F.lit(bins[0]), F.lit(bins[1]))).alias("k"))
    x = x.select("session", F.col("k").cast("long").alias("k"), F.expr("transform(spec, v -> get(v, k))").alias("z")).select("session", "k", "z", F.inline(F.expr(upper)))
    p, q = (F.get("z", F.col(c).cast("int")) for c in ("a", "b"))
    return x.groupBy("session", "k", "a", "b").agg(F.avg(p["re"] * q["re"] + p["im"] * q["im"]).alias("re"), F.avg(p["im"] * q["re"] - p["re"] * q["im"]).alias("im"))


def regularized(cov: DataFrame, shrinkage: float = 0.05, loading: float = 1e-3, floor: float = 1e-10) -> DataFrame:
    """Shrunk towards its mean power, and loaded on the diagonal."""
    diagonal = F.col("a") == F.col("b")
    power = F.sum(F.when(diagonal, F.col("re"))).over(Window.partitionBy("session", "k")) / MICS
    extra = F.when(diagonal, shrinkage * power + loading * F.greatest(power, F.lit(floor))).otherwise(0.0)
    return cov.withColumns({"re": (1 - shrinkage) * F.col("re") + extra, "im": (1 - shrinkage) * F.col("im")})


def fused(spectra: DataFrame, weights: tuple[float, ...] = (0.35, 0.90, 1.0)) -> DataFrame:
    """Per block and channel: bins 1 to 3, each divided by its maximum over the channels, in a weighted mean."""
    top = "transform(sequence(1, 3), k -> greatest(array_max(transform(spec, v -> get(v, k).power)), 1e-12D))"
    x = spectra.withColumn("top", F.expr(top)).select("session", "seq", "top", F.posexplode("spec").alias("c", "v"))
    mean = sum((w * F.get("v", F.lit(k))["power"] / F.get("top", F.lit(k - 1)) for k, w in enumerate(weights, 1)), F.lit(0.0)) / sum(weights)
    return x.select("session", "seq", F.col("c").cast("long").alias("c"), mean.alias("fused"))


def minmax(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return values.withColumn("normalized", F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0))


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant table."""
    return spark.createDataFrame(rows, schema)
