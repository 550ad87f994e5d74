"""Scans and greedy anchors against plain loops."""

import random

import pytest

from hexaphase.operators import control as ct
from hexaphase.operators import recurrences as rc


def loop(rows, keep):
    out, state = {}, {}
    for k, h, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if x is not None:
            state[k] = x if state.get(k) is None else keep * state[k] + (1 - keep) * x
        out[k, h] = state.get(k)
    return out


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_smoothing_over_chunks_equals_a_walk(spark, chunk):
    rng = random.Random(chunk)
    rows = [(k, h, rng.gauss(0, 1)) for k in (1, 2, None) for h in sorted(rng.sample(range(400), 150))] + [(3, 5, 1.5), (4, 0, 1.0), (4, 1, None), (4, 2, 3.0)]
    df = spark.createDataFrame(rows, "k long, h long, x double").selectExpr("*", "'other' as text")
    got = {(r.k, r.h): r.smoothed for r in rc.smoothed(df, ["k"], "h", "x", 0.77, chunk=chunk).collect()}
    want = loop(rows, 0.77)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_an_hour_of_one_stream_goes_in_chunks(spark):
    n = 180_000
    df = spark.range(n).selectExpr("0 as k", "id as h", "cast(id % 97 as double) as x")
    out = rc.smoothed(df, ["k"], "h", "x", 0.9)
    assert "_chunk" in out._jdf.queryExecution().executedPlan().toString()
    last = out.where(f"h = {n - 1}").first().smoothed
    state = None
    for h in range(n):
        state = h % 97 if state is None else 0.9 * state + 0.1 * (h % 97)
    assert last == pytest.approx(state, abs=1e-9)


def test_factors_that_change_from_row_to_row(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(0, h, rng.random(), rng.gauss(0, 1)) for h in range(300)]
    got = rc.affine(spark.createDataFrame(rows, "k long, h long, a double, b double"), ["k"], "h", F.col("a"), F.col("b"), F.col("b"), "y", chunk=16)
    state, want = None, {}
    for _, h, a, b in rows:
        state = b if state is None else a * state + b
        want[h] = state
    assert all(r.y == pytest.approx(want[r.h], abs=1e-12) for r in got.collect())


def greedy(times, gap):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


def test_anchors_are_greedy(spark):
    df = spark.createDataFrame([(0, t) for t in (0, 1900, 2000, 2100, 2950)], "s long, t long")
    assert sorted(r.t for r in rc.anchors(df, ["s"], "t", 1000).collect()) == [0, 1900, 2950]


@pytest.mark.parametrize("seed", range(4))
def test_anchors_against_a_walk(spark, seed):
    rng, gap = random.Random(seed), 100
    spread = [150, 3000, 40_000, 900][seed]
    rows = [(s, rng.randrange(-spread, spread), i) for s in (1, 2, None) for i in range(300)] + [(3, 7, 0), (3, 7, 1), (4, None, 0)]
    got = [(r.s, r.t, r.i) for r in rc.anchors(spark.createDataFrame(rows, "s long, t long, i long"), ["s"], "t", gap, ["i"]).collect()]
    want = []
    for s in (1, 2, None, 3):
        own = [r for r in rows if r[0] == s]
        want += [(s, t, min(i for _, x, i in own if x == t)) for t in greedy([t for _, t, _ in own], gap)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_submissions_start_anew_with_an_epoch(spark):
    rows = [(0, 0, 0), (0, 0, 500), (0, 1, 600), (0, 1, 1500), (0, 1, 1600), (0, 2, 100)]
    got = ct.submissions(spark.createDataFrame(rows, "s long, e long, t long"), ["s"], "t", 1000, "e")
    assert sorted((r.e, r.t) for r in got.collect()) == [(0, 0), (1, 600), (1, 1600), (2, 100)]
