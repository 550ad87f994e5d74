"""From audio to tracks, held against the kernels step by step."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hexaphase.kernels import noise, scan, track
from hexaphase.model import HOP, ProjectConfig, ScanConfig
from hexaphase.operators import acoustics as ac
from hexaphase.operators import control as ct
from hexaphase.operators import pipeline as pl
from hexaphase.sources import synthetic as sy

N = 60


def frame(*parts):
    """Blocks for createDataFrame, which takes plain lists only."""
    rows = pd.concat(parts)
    return rows.assign(samples=[x.tolist() for x in rows["samples"]])


@pytest.fixture(scope="module")
def audio():
    return {1: sy.directional((40.0,), seed=3, samples=N * HOP), 2: sy.directional((30.0, 210.0), (1.0, 0.8), seed=4, samples=N * HOP)}


@pytest.fixture(scope="module")
def blocks(spark, audio):
    return spark.createDataFrame(frame(*(sy.blocks_of(a, s) for s, a in audio.items())), sy.BLOCKS).repartition(3).cache()


def planned(spark, blocks, gate, order):
    """A plan by functions of the window's number."""
    wins = pl.windows(blocks).collect()
    rows = [(r.session, r.epoch, r.window_id, r.decision_sample, gate(r.window_id), order(r.window_id)) for r in wins]
    return spark.createDataFrame(rows, "session long, epoch long, window_id long, decision_sample long, gate string, scan_order long")


def by_kernels(audio, gate, order, cfg=ProjectConfig()):
    """(window, k, thetas, tracks) of one session, one step after the other."""
    spec, _ = scan.spectra(audio, cfg.scan)
    outer = np.einsum("tbi,tbj->tbij", spec, spec.conj())
    state, k, out = track.Stream(), 0, []
    for w in range(len(audio) // HOP - 7):
        on = gate(w) == "open" and (order(w) or 0) > 0
        k = k + 1 if on else 0
        found = []
        if on:
            last, n = 15 + 2 * w, min(19, 15 + 2 * (k - 1))
            raw = scan.music(outer[last - n : last].mean(axis=0)[None], order(w), cfg.scan)[0]
            y = scan.normalized(raw)
            found = [(float(p), float(raw[p]), float(y[p])) for p in scan.pick(y, order(w), cfg.scan)] if k >= pl.WARM else []
        live = track.update(state, 0, (w + 8) * HOP, found, k >= pl.WARM, HOP, cfg.tracker)
        out.append((w, k, [round(f[0]) for f in found], sorted((t["track_id"], t["state"], round(t["theta"], 4)) for t in live)))
    return out


CASES = {
    "open": (lambda w: "open", lambda w: 2),
    "closed in between": (lambda w: "closed" if 20 <= w < 23 else "open", lambda w: 1),
    "count of zero": (lambda w: "open", lambda w: 0 if 24 <= w < 27 else 2),
    "unknown count": (lambda w: "open", lambda w: None if w == 30 else 1),
    "never open": (lambda w: "warming_up", lambda w: None),
}


@pytest.mark.parametrize("case", CASES)
def test_process_is_the_kernels_step_by_step(spark, blocks, audio, case):
    gate, order = CASES[case]
    got = {}
    for r in pl.process(blocks, planned(spark, blocks, gate, order)).collect():
        got.setdefault(r.session, []).append((r.window_id, r.k, [round(x) for x in r.thetas], r.state, [(d.track_id, d.state, d.is_prediction) for d in r.directions], r.active))
    for s, a in audio.items():
        rows, want = sorted(got[s]), by_kernels(a, gate, order)
        assert [r[:3] for r in rows] == [w[:3] for w in want]
        assert [r[5] for r in rows] == [len(w[3]) for w in want]
        for r, w in zip(rows, want, strict=True):
            live = {t[0]: t[1] for t in w[3]}
            assert all(live[i] == state for i, state, _ in r[4]) and len(r[4]) <= 3
            on, skipped = gate(r[0]) == "open" and (order(r[0]) or 0) > 0, gate(r[0]) == "open" and not order(r[0])
            assert r[3] == ("music_skipped" if skipped else "processed" if on or r[4] else "blocked")
            assert on or all(p for _, _, p in r[4])  # without a scan nothing is observed


def test_a_closed_gate_coasts_and_a_new_run_warms_again(spark, blocks):
    out = pl.process(blocks, planned(spark, blocks, *CASES["closed in between"])).where("session = 1").orderBy("window_id").collect()
    before, during, after = out[19], out[21], out[23:32]
    assert before.directions and not before.directions[0].is_prediction and before.directions[0].state in ("confirmed", "tentative")
    assert during.state in ("processed", "blocked") and during.thetas == [] and all(d.is_prediction for d in during.directions)
    assert [r.k for r in out[23:33]] == list(range(1, 11)) and all(r.thetas == [] for r in after) and out[32].thetas


def test_another_window_s_plan_is_refused(spark, blocks):
    wrong = planned(spark, blocks, *CASES["open"]).withColumn("decision_sample", F.when(F.col("window_id") == 5, F.col("decision_sample") + HOP).otherwise(F.col("decision_sample")))
    with pytest.raises(Exception, match="unmatched window"):
        pl.process(blocks, wrong).collect()


def test_silence_is_a_fault_of_its_window_only(spark, audio):
    quiet = audio[1].copy()
    quiet[20 * HOP : 32 * HOP] = 0
    blocks = spark.createDataFrame(frame(sy.blocks_of(quiet, 1)), sy.BLOCKS)
    out = pl.process(blocks, planned(spark, blocks, *CASES["open"])).orderBy("window_id").collect()
    assert len(out) == N - 7 and any(r.fault for r in out) and any(r.thetas for r in out if r.window_id < 12) and all(r.thetas == [] for r in out if r.fault)
    assert ac.directions(blocks).count() > 0
    assert np.isnan(scan.music(np.zeros((1, len(scan.constants()["bins"]), 7, 7), complex), 1)).all() and scan.pick(np.full(360, np.nan), 2) == []


def test_plan_counts_and_orders(spark, blocks):
    hops = blocks.select("session", "epoch", "end_sample", F.when(F.col("hop") < 12, 0.2).otherwise(0.9).alias("p2"), F.lit("ready").alias("state"))
    rows = pl.plan(blocks, hops).collect()
    assert len(rows) == 2 * (N - 7) and all((r.scan_order is None) == (r.gate != "open") for r in rows)
    assert {r.scan_order for r in rows if r.session == 2 and r.window_id > 20} == {2} and {r.scan_order for r in rows if r.session == 1 and r.window_id > 20} == {1}
    lost = pl.plan(blocks, hops.where("end_sample != 9600")).where("decision_sample = 9600").collect()
    assert {r.gate for r in lost} == {"unavailable"}


def test_ids_off_publishes_angles_alone(spark, blocks):
    out = pl.process(blocks, planned(spark, blocks, *CASES["open"]), ids=False)
    assert "directions" not in out.columns and out.where("size(thetas) > 0").count() > 0


def test_scanner_and_tracker_are_arguments(spark, blocks):
    def scanner(covariances, order, cfg):
        out = np.zeros((len(covariances), 360))
        out[:, 100] = 1.0
        return out

    rows = pl.process(blocks, planned(spark, blocks, *CASES["open"]), scanner=scanner).where("k >= 10").collect()
    assert all(r.thetas == [100.0] for r in rows)


def test_sequential_operators_do_not_depend_on_batches(spark, audio):
    rows = frame(sy.blocks_of(audio[1][: 20 * HOP], 1), sy.blocks_of(audio[2][: 9 * HOP], 1, epoch=1), sy.blocks_of(audio[2][: 12 * HOP], 2))
    blocks = spark.createDataFrame(rows, sy.BLOCKS).repartition(5)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = [ac.presence(blocks).orderBy("session", "epoch", "end_sample").collect(), ac.denoised(blocks).orderBy("session", "epoch", "hop").collect()]
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 3)
        parts = [ac.presence(blocks).orderBy("session", "epoch", "end_sample").collect(), ac.denoised(blocks).orderBy("session", "epoch", "hop").collect()]
    finally:
        spark.conf.set(name, before)
    assert whole == parts and len(whole[0]) == len(whole[1]) == 41
    engine, tracker, want = noise.Denoiser(-18.0), noise.NoiseTracker(), []
    for i in range(20):
        x = audio[1][i * HOP : (i + 1) * HOP]
        ready = engine(x, tracker(x))
        want += [ready] if ready is not None else []
    want.append(engine.flush())
    got = [r.samples for r in whole[1] if r.session == 1 and r.epoch == 0]
    assert np.allclose(np.array(got), np.array([w.ravel() for w in want]))


def test_features_are_levels(spark, audio):
    e = noise.NoiseTracker()(audio[1][:HOP])
    assert e.features.shape == (7, 4) and np.allclose(e.features[:, 2], e.features[:, 1] - e.features[:, 0]) and np.allclose(e.features[:, 3], e.p1)


def test_denoiser_works_after_warm_up(spark):
    """After 50 hops of noise the gain falls where only noise is, up to 10 kHz."""
    rng = np.random.default_rng(1)
    quiet = (0.01 * rng.normal(size=(80 * HOP, 8))).astype(np.float32)
    out = ac.denoised(spark.createDataFrame(frame(sy.blocks_of(quiet, 1)), sy.BLOCKS)).orderBy("hop").collect()
    level = [np.sqrt(np.mean(np.asarray(r.samples).reshape(HOP, 8)[:, :7] ** 2)) for r in out]
    assert np.mean(level[70:]) < 0.85 * np.mean(level[5:40])


def test_ids_that_go_off_and_on_between_windows_are_reset(spark):
    rows = [(1, i, k, v) for i, (k, v) in enumerate([("tracking", 0.0), ("tracking", 1.0), ("count", 0.0), ("follow", 1.0), ("count", 1.0), ("follow", 1.0), ("gate", 1.5), ("gate", 0.5), ("gate", 0.5)])]
    out = ct.control_states(spark.createDataFrame(rows, "s long, i long, kind string, value double"), ["s"], ["i"]).orderBy("i").collect()
    assert [r.id_revision for r in out] == [1] * 9 and [r.refused for r in out] == [False, False, False, True, False, False, True, False, False]
    assert [r.following for r in out] == [True, True, False, False, False, True, True, True, True] and out[-1].gate_revision == 1 and out[-1].gate_threshold == 0.5


def test_scan_config_limits():
    y = np.zeros(360)
    y[[10, 100, 200]] = 1.0, 0.9, 0.8
    assert scan.eligible(y, ScanConfig()) == [10, 100, 200] and scan.pick(y, 2, ScanConfig()) == [10, 100]
