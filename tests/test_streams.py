"""Operators on synthetic blocks, and streams against batch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hexaphase.operators import acoustics as ac
from hexaphase.operators import timeline as tl
from hexaphase.operators import tracklog
from hexaphase.plans import catalog
from hexaphase.sources import synthetic as sy
from hexaphase.streaming import stateful as st


@pytest.fixture(scope="module")
def blocks(spark):
    return sy.sessions(spark.createDataFrame([(0,), (1,), (2,)], "session long")).cache()


def test_counts_and_directions(blocks):
    counts = ac.source_counts(blocks).toPandas()
    assert len(counts) == 3 * 12 and counts[counts.session == 1].source_count.mode()[0] == 2 and counts[counts.session == 2].source_count.mode()[0] == 1
    d = ac.directions(blocks).toPandas()
    assert (d[d.session == 2].theta.sub(77).abs() <= 2).all()


def test_chunks_do_not_change_results(blocks, monkeypatch):
    few = ac.chunked(blocks, chunk=17)
    assert few.where("own").count() == blocks.count() and few.count() > blocks.count()
    whole = [sorted(map(tuple, f(blocks).collect())) for f in (ac.source_counts, ac.directions)]
    chunked = ac.chunked
    monkeypatch.setattr(ac, "chunked", lambda b: chunked(b, chunk=17))
    parts = [sorted(map(tuple, f(blocks).collect())) for f in (ac.source_counts, ac.directions)]
    assert whole[0] == parts[0] and len(whole[0]) == 36
    assert [r[:5] for r in whole[1]] == [r[:5] for r in parts[1]] and np.allclose([r[5:] for r in whole[1]], [r[5:] for r in parts[1]])


def test_presence_warms_up(spark):
    rng = np.random.default_rng(5)
    made = sy.blocks_of(rng.normal(0, 0.01, (960 * 60, 8)).astype(np.float32), 0)
    df = spark.createDataFrame(made.assign(samples=made.samples.map(lambda x: x.tolist())), sy.BLOCKS)
    p = ac.presence(df).toPandas()
    assert p.state.value_counts().to_dict() == {"warming_up": 49, "ready": 11} and p[p.state == "ready"].p2.between(0, 1).all()


def test_ten_minutes_make_one_epoch(spark):
    df = spark.range(30_000).select(F.lit(0).cast("long").alias("session"), F.col("id").alias("seq"), (F.col("id") * 0.02).alias("ts"))
    df = tl.continuity(df, ["session"], ["seq"], "seq", "ts", 0.005, F.lit(False), expected=F.lit(0.02))
    w = tl.sliding(tl.epochs(df, ["session"], ["seq"], F.lit(960)), ["session"])
    assert w.agg(F.max("window_id"), F.max("decision_sample"), F.max("epoch")).first() == (29_992, 28_800_000, 0)


def test_gap_starts_an_epoch(spark):
    df = spark.createDataFrame([(0, s, s * 0.02) for s in (0, 1, 2, 4, 5)], "session long, seq long, ts double")
    df = tl.epochs(tl.continuity(df, ["session"], ["seq"], "seq", "ts", 0.005, F.lit(False), expected=F.lit(0.02)), ["session"], ["seq"], F.lit(960))
    assert [(r.epoch, r.start_sample) for r in df.orderBy("seq").collect()] == [(0, 0), (0, 960), (0, 1920), (1, 0), (1, 960)]


def decisions(spark):
    rows = [(u, 0, 960 * (k + 1), [float((10 * u + k) % 360)], [0.9], True, 960) for u in range(3) for k in range(15)]
    return pd.DataFrame(rows, columns=["session", "epoch", "decision_sample", "thetas", "scores", "births", "period"])


SCHEMA = "session long, epoch long, decision_sample long, thetas array<double>, scores array<double>, births boolean, period long"


def test_stream_of_tracks_equals_batch(spark, tmp_path):
    rows = decisions(spark)
    want = ac.tracks(spark.createDataFrame(rows, SCHEMA)).toPandas()
    for i, part in enumerate((rows[rows.decision_sample <= 5_000], rows[rows.decision_sample > 5_000])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = st.read_blocks(spark, str(tmp_path / "in"), SCHEMA, 1)
    q = st.tracks(source).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    keys = ["session", "decision_sample", "track_id"]
    got = spark.table("tracked").toPandas().sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want.sort_values(keys).reset_index(drop=True), check_dtype=False)


def test_track_log(spark, tmp_path):
    t = ac.tracks(spark.createDataFrame(decisions(spark), SCHEMA))
    log = tracklog.histories(t, ["session"], max_tracks=1, gap=4_800)
    assert log.count() == 3 and all(len(r.trajectory) == 3 for r in log.collect())
    st.write_track_log(log.where("session = 1"), str(tmp_path / "log.tsv"))
    assert (tmp_path / "log.tsv").read_text().startswith("track_id\tduration_s")


@pytest.mark.parametrize("name", ["track_imm_jpda", "assignment", "wola_identity", "calibration_report"])
def test_kernel_queries_run(name, spark, sf):
    rows = catalog.QUERIES[name](spark, sf).toPandas()
    assert len(rows)
    if name == "wola_identity":
        assert rows.same.all()


def test_noise_minimum_at_every_hop(spark, sf, duck):
    got = {(r.user_id, r.event_id): r.minimum for r in catalog.QUERIES["noise_minimum_all"](spark, sf).collect()}
    want, longest = {}, 0
    for user, rows in duck.sql("SELECT user_id, event_id, value FROM events ORDER BY user_id, ts, event_id").df().groupby("user_id"):
        x = rows.value.to_numpy()
        longest = max(longest, len(x))
        # a closed sub-window holds its five values and the one before; ten of them count, and what came after the last one closed
        parts = [x[max(0, 5 * k - 1) : 5 * k + 5].min() for k in range(len(x) // 5)]
        for h, event in enumerate(rows.event_id):
            closed = (h + 1) // 5
            want[user, event] = round(min([*parts[max(0, closed - 10) : closed], *x[5 * closed : h + 1]]), 6)
    assert longest > 55 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
