"""Calibration in pieces against the whole recording in one array."""

import numpy as np
import pytest

from hexaphase.kernels import calibrate
from hexaphase.kernels.special import bandpass, filtered
from hexaphase.model import HOP
from hexaphase.operators import calibration as cb
from hexaphase.plans import catalog, kernel_queries
from hexaphase.sources import synthetic as sy


def recording(chirps, lead=0.4, seed=1, noise=1e-4):
    rng, one = np.random.default_rng(seed), calibrate.chirp()
    gap = np.zeros(round(0.35 * 48_000))
    line = np.concatenate([np.zeros(round(lead * 48_000)), np.tile(np.concatenate([0.5 * one, gap]), chirps), gap])
    x = np.column_stack([np.roll(line, (2 * c) % 3) * (1 - 0.05 * c) * (-1 if c == 3 else 1) for c in range(7)]) + noise * rng.normal(size=(len(line), 7))
    x = np.column_stack([x, np.zeros(len(x))])
    return np.concatenate([x, np.zeros((-len(x) % HOP, 8))]).astype(np.float32)


def frame(spark, *parts):
    import pandas as pd

    rows = pd.concat([sy.blocks_of(a, s) for s, a in parts])
    return spark.createDataFrame(rows.assign(samples=[x.tolist() for x in rows["samples"]]), sy.BLOCKS).repartition(4)


@pytest.mark.parametrize("lead", [0.4, 0.9])
def test_pieces_find_what_the_whole_finds(spark, lead):
    x, template = recording(6, lead), calibrate.chirp()
    sections = bandpass(200.0, 10_000.0, 48_000)
    want = calibrate.chirp_starts(filtered(sections, x[:, 6].astype(np.float64)), filtered(sections, template))
    for piece in (17, 40, 1000):
        got = cb.chirp_starts(frame(spark, (1, x)), template, piece)
        assert sorted(r.place for r in got.collect()) == sorted(want) and len(want) == 6
    whole, parts = (sorted((r.place, r.height) for r in cb.peaks(frame(spark, (1, x)), template, piece=p).collect()) for p in (1000, 17))
    assert [p for p, _ in whole] == [p for p, _ in parts] and np.allclose([h for _, h in whole], [h for _, h in parts], atol=1e-9)


def test_report_equals_the_analysis_of_one_array(spark):
    template = calibrate.chirp()
    made = {1: recording(4), 2: recording(4, 0.7, seed=2), 3: recording(3, seed=3), 4: recording(4, seed=4, noise=0.3)}
    rows = cb.report(frame(spark, *made.items()), template, chirps=4).collect()
    for s in (1, 2):
        want = calibrate.analyze(made[s][:, :7].astype(np.float64), template, chirps=4)
        own = sorted((r for r in rows if r.session == s), key=lambda r: r.c)
        assert [r.polarity for r in own] == want["polarity"] and [r.delay for r in own] == want["delay"] and all(r.fault is None for r in own)
        assert np.allclose([r.gain for r in own], want["gain"], atol=1e-9) and np.allclose([r.snr_db for r in own], want["snr_db"], atol=1e-6)
    assert {r.fault for r in rows if r.session == 3} == {"expected 4 chirps, found 3"} and all(r.gain is None for r in rows if r.session == 3)
    assert all("found" in r.fault or "signal-to-noise" in r.fault for r in rows if r.session == 4)


def test_thinning_is_greedy_by_height(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(p), float(h)) for s in (1, 2) for p, h in zip(rng.choice(4000, 300, replace=False), rng.integers(0, 60, 300) / 60)]
    got = {(r.session, r.place) for r in cb.thinned(spark.createDataFrame(rows, "session long, place long, height double"), 100).collect()}
    want = set()
    for s in (1, 2):
        kept = []
        for _, p, _ in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[1])):
            if all(abs(p - q) >= 100 for q in kept):
                kept.append(p)
        want |= {(s, p) for p in kept}
    assert got == want


def test_a_long_recording_goes_in_pieces(spark):
    one = recording(20, lead=0.4)  # 12 s, and then once more with a pause that breaks the run
    x = np.concatenate([one[: int(9.3 * 48_000)], one, one[: 5 * 48_000]])
    hops = frame(spark, (1, x))
    assert len(x) // HOP > 1000
    got = sorted(r.place for r in cb.chirp_starts(hops, calibrate.chirp(), 60).collect())
    assert len(got) == 20 and got[0] >= 9.3 * 48_000 and set(np.diff(got)) <= set(range(28_700, 28_900))


def test_registered_report_finds_the_known_values(spark, sf):
    rows = catalog.QUERIES["calibration_report"](spark, sf).collect()
    sessions = {r.session for r in rows}
    assert len(rows) == 7 * len(sessions) > 50 and sum(r.chirps for r in rows if r.c == 0) == spark.read.parquet(f"{sf}/supplier.parquet").count()
    for r in rows:
        gains, lags = kernel_queries._gains(r.session), kernel_queries._lags(r.session)
        # to one level, in dB
        want = np.exp(np.mean(np.log(gains))) / gains[r.c]
        assert r.fault is None and r.polarity == 1 and r.delay == lags.max() - lags[r.c] and abs(r.gain - want) < 2e-3
