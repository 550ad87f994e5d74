"""Audio that opens the gate, from tables to tracks, against who really speaks; and settings that reach the windows."""

import pytest
from pyspark.sql import functions as F

from hexaphase.model import HOP
from hexaphase.operators import pipeline as pl
from hexaphase.plans import catalog, kernel_queries
from hexaphase.sources import synthetic as sy
from hexaphase.sources.shared import written


def apart(a, b):
    return abs((a - b + 180) % 360 - 180)


@pytest.fixture(scope="module")
def truth(spark, sf):
    rows = sy.speaking(kernel_queries._speakers(spark, sf), "speaker", "theta").collect()
    return lambda session, hop: next((r.theta for r in rows if r.session == session and r.from_hop <= hop < r.to_hop), None)


def test_heard_sessions_scan_and_track(spark, sf, truth):
    rows = catalog.QUERIES["session_pipeline_heard"](spark, sf).withColumn("d", F.from_json("directions", "array<struct<track_id: long, theta: double, state: string, is_prediction: boolean>>")).collect()
    shown = [r for r in rows if r.d]
    assert len(shown) * 3 >= len(rows) and sum(r.gate == "open" for r in rows) > len(rows) / 3
    held = [r for r in shown if r.k >= 10 and not any(d.is_prediction for d in r.d) and all(truth(r.session, r.decision_sample // HOP - n) is not None for n in (1, 10))]
    assert len(held) > len(shown) / 2
    for r in held:
        theta = truth(r.session, r.decision_sample // HOP - 1)
        if truth(r.session, r.decision_sample // HOP - 10) == theta:
            assert min(apart(d.theta, theta) for d in r.d) <= 3, r
    assert any(d.state == "confirmed" for r in held for d in r.d)


def test_scans_find_who_speaks(spark, sf, truth):
    for name in ("norm_music", "norm_music_two"):
        rows = catalog.QUERIES[name](spark, sf).where("rank = 1").collect()
        inside = [r for r in rows if truth(r.session, r.decision_sample // HOP - 1) is not None and truth(r.session, r.decision_sample // HOP - 12) == truth(r.session, r.decision_sample // HOP - 1)]
        assert len(inside) > 100 and all(apart(r.theta, truth(r.session, r.decision_sample // HOP - 1)) <= 3 for r in inside)


def test_one_speaker_counts_as_one(spark, sf, truth):
    rows = catalog.QUERIES["source_count"](spark, sf).collect()
    inside = [r.source_count for r in rows if truth(r.session, r.decision_sample // HOP - 1) is not None and truth(r.session, r.decision_sample // HOP - 12) is not None]
    assert len(inside) > 100 and sum(c == 1 for c in inside) >= 0.95 * len(inside)


def test_presence_follows_who_speaks(spark, sf, truth):
    rows = catalog.QUERIES["imcra_presence"](spark, sf).where("state = 'ready'").collect()
    spoken = [r.p2 for r in rows if truth(r.session, r.end_sample // HOP - 1) is not None and truth(r.session, r.end_sample // HOP - 3) is not None]
    assert len(spoken) > 100 and min(spoken) > 0.8


def test_denoiser_queries(spark, sf):
    assert all(r.same and r.blocks == 49 for r in catalog.QUERIES["wola_identity"](spark, sf).collect())
    rows = catalog.QUERIES["denoised_levels"](spark, sf).collect()
    assert all(abs(r.after - r.before) < 1e-5 for r in rows if r.hop < 40)
    energy = lambda c: sum(getattr(r, c) ** 2 for r in rows if r.hop > sy.LEAD)
    assert 0.5 * energy("before") < energy("after") < energy("before")


def test_audio_grows_with_the_table(spark):
    count = lambda sf: sy.speaking(kernel_queries._speakers(spark, f"/root/testdata/{sf}"), "speaker", "theta").count()
    assert count("sf0.01") == 10 * count("sf0.001")


EVENTS = "session long, epoch long, decision_sample long, nth long, kind string, value double"


@pytest.fixture(scope="module")
def blocks(spark):
    return written(sy.talks(spark.createDataFrame([(1, 1, 70.0, 0.3), (1, 2, 200.0, 0.3), (1, 3, 310.0, 0.3)], "session long, speaker long, theta double, level double"), "speaker", "theta", "level"))


@pytest.fixture(scope="module")
def hops(blocks):
    p = F.when(F.col("hop") < sy.LEAD, 0.1).otherwise(0.9)
    return blocks.select("session", "epoch", "end_sample", p.alias("p2"), F.lit("ready").alias("state"))


def run(spark, blocks, hops, events):
    settings = spark.createDataFrame([(1, 0, (w + 8) * HOP, i, kind, value) for i, (w, kind, value) in enumerate(events)], EVENTS)
    return pl.session_pipeline(blocks, hops, settings=settings).orderBy("window_id").collect()


def test_no_settings_change_nothing(spark, blocks, hops):
    got, want = run(spark, blocks, hops, []), pl.session_pipeline(blocks, hops).orderBy("window_id").collect()
    assert len(got) == len(want) > 100 and all(g.directions == w.directions and g.scan_order == w.scan_order and g.gate == w.gate for g, w in zip(got, want, strict=True))
    assert any(r.directions for r in got) and {r.id_revision for r in got} == {0}


def test_ids_off_and_on_between_windows_start_anew(spark, blocks, hops):
    before = {d.track_id for r in run(spark, blocks, hops, []) if r.window_id >= 100 for d in r.directions}
    rows = run(spark, blocks, hops, [(100, "tracking", 0.0), (100, "tracking", 1.0)])
    assert {r.id_revision for r in rows if r.window_id < 100} == {0} and {(r.id_revision, r.scan_revision) for r in rows if r.window_id >= 100} == {(1, 2)}
    after = [d for r in rows if r.window_id >= 100 for d in r.directions]
    assert (after[0].track_id, after[0].is_new) == (1, True) and max(d.track_id for d in after) < max(before)
    assert len({r.k for r in rows if r.window_id > 70}) > 1 and rows[101].k == rows[100].k + 1  # the scan goes on


def test_without_tracking_windows_publish_bare_directions(spark, blocks, hops):
    rows = run(spark, blocks, hops, [(70, "tracking", 0.0), (110, "tracking", 1.0)])
    off = [r for r in rows if 70 <= r.window_id < 110 and r.thetas]
    assert off and all([d.theta for d in r.directions] == r.thetas and all(d.track_id is None and d.state is None for d in r.directions) for r in off)
    assert all(r.active == 0 for r in off) and min(d.track_id for r in rows if r.window_id >= 110 for d in r.directions) == 1


def test_thresholds_and_counting_hold_from_their_window_on(spark, blocks, hops):
    rows = run(spark, blocks, hops, [(80, "gate", 0.95), (90, "gate", 0.5), (100, "direction", 1.0), (120, "count", 0.0), (130, "gate", 1.5)])
    by = {r.window_id: r for r in rows}
    assert by[79].gate == "open" and {by[w].gate for w in range(80, 90)} == {"closed"} and by[90].gate == "open" and by[90].k == 1
    assert by[85].skip_reason == "current_probability_below_threshold" and by[90].skip_reason is None and by[85].state == "processed"
    assert by[99].thetas and all(len(by[w].thetas) <= 1 for w in range(100, 120)) and {by[w].direction_threshold for w in range(100, 130)} == {1.0}
    assert {by[w].scan_order for w in range(120, 130)} == {2} and all(by[w].raw_count is None for w in range(120, 130)) and by[119].raw_count is not None
    assert by[140].gate_revision == 2 and by[140].gate_threshold == 0.5 and by[140].count_revision == 1
