"""Queries over signal blocks (embeddings), each with its oracle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import circular_distance, normalize_deg
from ..model import CHANNEL_MAP, DELAYS, GAINS, SPEED_OF_SOUND, gate_weights, mic_positions
from ..operators import channels as ch
from ..operators import spectra as sp
from ..sources import tables as t
from .registry import query

S = """s AS (SELECT label::BIGINT AS session, vec_id AS seq, ((k - 1) // 8)::BIGINT AS i, ((k - 1) % 8)::BIGINT AS c, embedding[k]::DOUBLE AS x
 FROM embeddings, (SELECT unnest(range(1, 65)) AS k))"""
_TURN = "2 * pi() * ((k * i) % 8) / 8"
D = f"""{S}, m AS (SELECT session, seq, i, c, x - avg(x) OVER (PARTITION BY session, seq, c) AS x FROM s),
 d0 AS (SELECT session, seq, c, k, sum(x * cos({_TURN})) AS re, -sum(x * sin({_TURN})) AS im FROM m, (SELECT unnest(range(0, 5)) AS k) GROUP BY ALL),
 d AS (SELECT *, (re * re + im * im) / 8 AS power FROM d0)"""
P = f"""{D}, mag AS (SELECT *, sqrt(re * re + im * im) AS mag FROM d WHERE c < 7),
 fl AS (SELECT *, 1e-12 * greatest(max(mag) OVER (PARTITION BY session, seq), 1.0) AS floor FROM mag),
 p AS (SELECT a.session, a.seq, a.k, a.c AS a, b.c AS b, (a.re * b.re + a.im * b.im) / greatest(a.mag * b.mag, a.floor) AS re,
  (a.im * b.re - a.re * b.im) / greatest(a.mag * b.mag, a.floor) AS im FROM fl a JOIN fl b ON a.session = b.session AND a.seq = b.seq AND a.k = b.k AND a.c < b.c)"""
V = f"""{D}, v AS (SELECT a.session, a.k, a.c AS a, b.c AS b, avg(a.re * b.re + a.im * b.im) AS re, avg(a.im * b.re - a.re * b.im) AS im
  FROM d a JOIN d b ON a.session = b.session AND a.seq = b.seq AND a.k = b.k AND a.c <= b.c WHERE a.c < 7 AND b.c < 7 AND a.k BETWEEN 1 AND 3 GROUP BY ALL)"""
_list = lambda values: "[" + ", ".join(map(str, values)) + "]"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def _spectra(spark, sf):
    return sp.spectrum(t.blocks(spark, sf))


@query("decode_interleave", f"WITH {S} SELECT seq, c, sum(greatest(-32768, least(32767, round_even(x * 32768, 0))) / 32768) AS total, max(abs(greatest(-32768, least(32767, round_even(x * 32768, 0))))) / 32768 AS top FROM s GROUP BY ALL")
def decode_interleave(spark, sf):
    decoded = ch.decode_pcm16(ch.encode_pcm16(t.blocks(spark, sf)))
    long = decoded.select("seq", F.posexplode(F.col("samples").cast("array<double>")).alias("k", "x"))
    return long.groupBy("seq", (F.col("k") % 8).cast("long").alias("c")).agg(F.sum("x").alias("total"), F.max(F.abs("x")).alias("top"))


@query("channel_permute", f"SELECT vec_id AS seq, k::BIGINT AS k, embedding[((k // 8) * 8 + {_list(CHANNEL_MAP)}[(k % 8) + 1] + 1)::INT]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS k)")
def channel_permute(spark, sf):
    return ch.permute(t.blocks(spark, sf)).select("seq", F.posexplode("samples").alias("k", "x")).withColumn("k", F.col("k").cast("long"))


@query("channel_select", f"WITH {S} SELECT seq, i, x FROM s WHERE c = 3")
def channel_select(spark, sf):
    return ch.select_channel(t.blocks(spark, sf), 3).select("seq", F.posexplode("samples").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query("physical_slice", f"WITH {S} SELECT seq, count(*) AS n, round(sum(x), 6) AS total, max(c) AS last FROM s WHERE c < 7 GROUP BY seq")
def physical_slice(spark, sf):
    return rounded(ch.physical(t.samples(spark, sf)).groupBy("seq").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.max("c").alias("last")), "total")


@query("calibrate_gain_polarity", f"WITH {S} SELECT session, seq, i, c, round(x * {_list([*GAINS, 1.0])}[c + 1]::DOUBLE, 6) + 0.0 AS x FROM s")
def calibrate_gain_polarity(spark, sf):
    return rounded(ch.calibrate_gain(t.samples(spark, sf)), "x")


@query("calibrate_integer_delay", f"""WITH {S}, l AS (SELECT *, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM s WINDOW w AS (PARTITION BY session, c ORDER BY seq, i))
 SELECT session, seq, i, c, coalesce(CASE {_list([*DELAYS, 0])}[c + 1] WHEN 0 THEN x WHEN 1 THEN x1 ELSE x2 END, 0.0) AS x FROM l""")
def calibrate_integer_delay(spark, sf):
    return ch.calibrate_delay(t.samples(spark, sf))


_METER = f"{S}, r AS (SELECT session, seq, c, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM s GROUP BY ALL), l AS (SELECT *, greatest(-120.0, 20 * log10(greatest(rms, 1e-6))) AS rms_db FROM r)"


@query("meter_rms_peak_clip", f"WITH {_METER} SELECT session, seq, c, round(rms, 6) AS rms, round(peak, 6) AS peak, round(rms_db, 6) AS rms_db, round(greatest(-120.0, 20 * log10(greatest(peak, 1e-6))), 6) AS peak_db, peak >= 0.999 AS clipped FROM l")
def meter_rms_peak_clip(spark, sf):
    return rounded(ch.meter(t.samples(spark, sf)), "rms", "peak", "rms_db", "peak_db")


@query("db_power_mean", f"WITH {_METER} SELECT session, seq, c, round(10 * log10(avg(pow(10, rms_db / 10)) OVER (PARTITION BY session, c ORDER BY seq ROWS 9 PRECEDING)), 6) AS mean_db FROM l")
def db_power_mean(spark, sf):
    return rounded(ch.smoothed_meter(ch.meter(t.samples(spark, sf))), "mean_db").select("session", "seq", "c", "mean_db")


@query("dft_power", f"WITH {D} SELECT session, seq, c, k, round(power, 6) + 0.0 AS power FROM d")
def dft_power(spark, sf):
    return rounded(sp.dft(_spectra(spark, sf)).select("session", "seq", "c", "k", "power"), "power")


@query("freq_smooth3", f"WITH {D} SELECT session, seq, c, k, round(0.25 * coalesce(lag(power) OVER w, power) + 0.5 * power + 0.25 * coalesce(lead(power) OVER w, power), 6) + 0.0 AS smooth FROM d WINDOW w AS (PARTITION BY session, seq, c ORDER BY k)")
def freq_smooth3(spark, sf):
    return rounded(sp.smooth3(_spectra(spark, sf)), "smooth").select("session", "seq", "c", "k", "smooth")


@query("band_mean_db", f"WITH {D} SELECT session, seq, c, round(10 * log10(greatest(avg(power), 1e-12)), 6) AS band_db FROM d WHERE k BETWEEN 1 AND 3 GROUP BY ALL")
def band_mean_db(spark, sf):
    return rounded(sp.band_mean(_spectra(spark, sf)), "band_db")


_P1 = f"{D}, q AS (SELECT *, power / greatest(sum(power) OVER (PARTITION BY session, seq, c), 1e-12) AS spp FROM d), p1 AS (SELECT session, seq, c, greatest(0.0, least(1.0, sum(CASE k WHEN 1 THEN 0.3 WHEN 2 THEN 0.3 WHEN 3 THEN 0.4 ELSE 0 END * spp))) AS p1 FROM q WHERE c < 7 GROUP BY ALL)"


@query("gate_weighted_p1", f"WITH {_P1} SELECT session, seq, c, round(p1, 6) AS p1 FROM p1")
def gate_weighted_p1(spark, sf):
    return rounded(sp.presence(_spectra(spark, sf)), "p1")


@query("p2_median", f"WITH {_P1} SELECT session, seq, round(median(p1), 6) AS p2 FROM p1 GROUP BY ALL")
def p2_median(spark, sf):
    return rounded(sp.p2(_spectra(spark, sf)), "p2")


@query("pair_cross_spectrum", f"WITH {P} SELECT session, k, a, b, round(avg(re), 6) + 0.0 AS re, round(avg(im), 6) + 0.0 AS im FROM p WHERE k BETWEEN 1 AND 3 GROUP BY ALL")
def pair_cross_spectrum(spark, sf):
    x = sp.pairs(_spectra(spark, sf)).where(F.col("k").between(1, 3))
    return rounded(x.groupBy("session", "k", "a", "b").agg(F.avg("re").alias("re"), F.avg("im").alias("im")), "re", "im")


_GCC = f"{P}, g AS (SELECT session, seq, a, b, lag, avg(re * cos(2 * pi() * k * lag / 8) - im * sin(2 * pi() * k * lag / 8)) AS gcc FROM p, (SELECT unnest([-2, -1, 0, 1, 2]) AS lag) WHERE k BETWEEN 1 AND 3 GROUP BY ALL)"


@query("gcc_lag", f"WITH {_GCC} SELECT session, a, b, lag::BIGINT AS lag, round(avg(gcc), 6) + 0.0 AS gcc FROM g GROUP BY ALL")
def gcc_lag(spark, sf):
    g = sp.gcc(_spectra(spark, sf))
    return rounded(g.groupBy("session", "a", "b", "lag").agg(F.avg("gcc").alias("gcc")), "gcc")


@query("robust_z", f"WITH {D}, w AS (SELECT session, seq, power, median(power) OVER (PARTITION BY session, seq) AS m FROM d WHERE c < 7 AND k > 0) SELECT session, seq, round(max(power), 6) AS peak, round((max(power) - any_value(m)) / greatest(1.4826 * median(abs(power - m)), 1e-6), 4) AS z FROM w GROUP BY ALL")
def robust_z(spark, sf):
    d = sp.dft(_spectra(spark, sf)).where("c < 7 and k > 0")
    out = sp.peak_z(d, ["session", "seq"], "power").select("session", "seq", "peak", "z")
    return rounded(rounded(out, "peak"), "z", digits=4)


@query("cov_outer", f"WITH {V} SELECT session, k, a, b, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM v")
def cov_outer(spark, sf):
    return rounded(sp.covariance(_spectra(spark, sf)), "re", "im")


@query("cov_regularize", f"WITH {V}, w AS (SELECT *, sum(CASE WHEN a = b THEN re END) OVER (PARTITION BY session, k) / 7 AS p FROM v) SELECT session, k, a, b, round(0.95 * re + CASE WHEN a = b THEN 0.05 * p + 1e-3 * greatest(p, 1e-10) ELSE 0 END, 6) + 0.0 AS re, round(0.95 * im, 6) + 0.0 AS im FROM w")
def cov_regularize(spark, sf):
    return rounded(sp.regularized(sp.covariance(_spectra(spark, sf))), "re", "im")


_FUSE = f"{D}, n AS (SELECT *, power / greatest(max(power) OVER (PARTITION BY session, seq, k), 1e-12) AS n FROM d WHERE k BETWEEN 1 AND 3), f AS (SELECT session, seq, c, sum([0.35, 0.9, 1.0][k]::DOUBLE * n) / 2.25 AS fused FROM n GROUP BY ALL)"


@query("freq_weighted_fuse", f"WITH {_FUSE} SELECT session, seq, c, round(fused, 6) AS fused FROM f")
def freq_weighted_fuse(spark, sf):
    return rounded(sp.fused(_spectra(spark, sf)), "fused")


@query("minmax_norm", f"WITH {_FUSE}, w AS (SELECT *, min(fused) OVER (PARTITION BY session, seq) AS lo, max(fused) OVER (PARTITION BY session, seq) AS hi FROM f) SELECT session, seq, c, round(CASE WHEN hi > lo THEN (fused - lo) / (hi - lo) ELSE 0 END, 6) AS normalized FROM w")
def minmax_norm(spark, sf):
    return rounded(sp.minmax(sp.fused(_spectra(spark, sf)), ["session", "seq"], "fused"), "normalized").select("session", "seq", "c", "normalized")


@query("lag_correlation", f"""WITH {S}, j AS (SELECT a.session, a.c, a.seq, a.i, a.x, b.x AS r FROM s a JOIN s b ON a.session = b.session AND a.seq = b.seq AND a.i = b.i AND b.c = 6 WHERE a.c < 6),
 k AS (SELECT session, c, x, r, lag(r, 3) OVER w AS p3, lag(r, 2) OVER w AS p2, lag(r, 1) OVER w AS p1, lead(r, 1) OVER w AS n1, lead(r, 2) OVER w AS n2, lead(r, 3) OVER w AS n3 FROM j WINDOW w AS (PARTITION BY session, c ORDER BY seq, i)),
 g AS (SELECT session, c, sqrt(sum(x * x) * sum(r * r)) AS norm, [sum(x * n3), sum(x * n2), sum(x * n1), sum(x * r), sum(x * p1), sum(x * p2), sum(x * p3)] AS v FROM k GROUP BY ALL),
 u AS (SELECT session, c, norm, unnest(v) AS s, unnest([-3, -2, -1, 0, 1, 2, 3]) AS lag FROM g)
 SELECT session, c, arg_max(lag, abs(s))::BIGINT AS lag, round(arg_max(s, abs(s)) / any_value(norm), 6) AS correlation FROM u GROUP BY ALL""")
def lag_correlation(spark, sf):
    return rounded(ch.lag_correlation(t.samples(spark, sf)), "correlation")


_MICS = "m AS (SELECT unnest(range(0, 7)) AS mic, unnest([0.04, 0.02, -0.02, -0.04, -0.02, 0.02, 0.0]) AS x, unnest([0.0, -0.034641016151, -0.034641016151, 0.0, 0.034641016151, 0.034641016151, 0.0]) AS y)"


@query("geometry_delays", f"WITH {_MICS} SELECT mic, theta, round(-(x * cos(radians(theta)) + y * sin(radians(theta))) / 343.0 * 48000, 6) + 0.0 AS delay FROM m, (SELECT unnest(range(0, 360)) AS theta)")
def geometry_delays(spark, sf):
    """Far-field delays in samples: 7 microphones by 360 degrees, all constants."""
    mics = sp.dimension(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(mic_positions())], "mic long, x double, y double")
    grid = mics.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(359).cast("long"))).alias("theta"))
    turn = F.radians("theta")
    return rounded(grid.select("mic", "theta", (-(F.col("x") * F.cos(turn) + F.col("y") * F.sin(turn)) / SPEED_OF_SOUND * 48000).alias("delay")), "delay")


@query("gate_weights_dim", """SELECT f::BIGINT AS hz, round(CASE WHEN f <= 600 THEN 0.3 * [0.161502, 0.18, 0.18, 0.18, 0.163814, 0.088159, 0.041165, 0.00536][((f - 250) // 50 + 1)::INT] WHEN f < 1600 THEN 0.3 / 19 ELSE 0.4 / 37 END::DOUBLE, 9) AS weight FROM (SELECT unnest(range(250, 3401, 50)) AS f)""")
def gate_weights_dim(spark, sf):
    freqs = np.arange(201) * 50.0
    w = gate_weights(freqs)
    return rounded(sp.dimension(spark, [(int(f), float(x)) for f, x in zip(freqs, w, strict=True) if x], "hz long, weight double"), "weight", digits=9)


@query("lag_lut", f"""WITH {_MICS}, p AS (SELECT a.mic AS a, b.mic AS b, theta, -((a.x - b.x) * cos(radians(theta)) + (a.y - b.y) * sin(radians(theta))) / 343.0 * 48000 * 4 AS lag FROM m a JOIN m b ON a.mic < b.mic, (SELECT unnest(range(0, 360)) AS theta))
 SELECT a, b, theta, least(111, greatest(0, floor(round(lag, 6) + 56)))::BIGINT AS lower, round(round(lag, 6) + 56 - least(111, greatest(0, floor(round(lag, 6) + 56))), 6) + 0.0 AS fraction FROM p""")
def lag_lut(spark, sf):
    """Per pair and angle: place and fraction of the pair's delay on the lag grid of 113 quarter samples."""
    from ..kernels.scan import lag_table

    return rounded(sp.dimension(spark, lag_table(), "a long, b long, theta long, lower long, fraction double"), "fraction")


@query("normalize_angles", "SELECT vec_id AS seq, round(fmod(fmod(embedding[1] * 3600, 360) + 360, 360), 4) + 0.0 AS theta, round(least(abs(fmod(fmod(embedding[1]::DOUBLE * 3600, 360) + 360, 360) - 180), 360 - abs(fmod(fmod(embedding[1]::DOUBLE * 3600, 360) + 360, 360) - 180)), 4) AS from_180 FROM embeddings".replace("fmod(embedding[1] *", "fmod(embedding[1]::DOUBLE *"))
def normalize_angles(spark, sf):
    x = t.blocks(spark, sf).select("seq", normalize_deg(F.col("samples")[0] * 3600).alias("theta"))
    return rounded(x.withColumn("from_180", circular_distance("theta", 180.0)), "theta", "from_180", digits=4)
