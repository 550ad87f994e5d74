"""Streams with typed state against batch and against plain loops: windows, noise and presence, the denoiser, the last ids."""

import numpy as np
import pandas as pd
import pytest

from hexaphase.kernels.axis import Assembler, Block
from hexaphase.operators import acoustics as ac
from hexaphase.operators import recut
from hexaphase.operators import sequential as sq
from hexaphase.sources import synthetic as sy
from hexaphase.streaming import processors as pr
from hexaphase.streaming import stateful as st

BLOCKS = "session long, epoch long, seq long, start_sample long, calibration string, samples array<float>"


def cut(audio, sizes, session=0, epoch=0, seq=0, calibration="a"):
    rows, at = [], 0
    for i, n in enumerate(sizes):
        rows.append((session, epoch, seq + i, at, calibration, audio[at : at + n].ravel().tolist()))
        at += n
    return rows


@pytest.fixture(scope="module")
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    pr.use_state_store(spark)
    yield
    spark.conf.set(name, before)


class Feed:
    """A folder that parts of a stream arrive in, and a query over it that can be stopped and started."""

    def __init__(self, spark, path, schema, f):
        self.spark, self.path, self.schema, self.f, self.n = spark, path, schema, f, 0

    def __call__(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        return self

    def run(self, files=1):
        source = st.read_blocks(self.spark, f"{self.path}/in", self.schema, files)
        q = self.f(source).writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.spark.read.parquet(f"{self.path}/out").toPandas()


def plain_windows(audio):
    return [audio[d - 7680 : d] for d in range(7680, len(audio) + 1, 960)]


@pytest.mark.parametrize("sizes", [[960] * 12, [137, 2000, 1, 4022, 5360], [11520], [480] * 24])
def test_any_chunking_gives_the_same_windows(sizes, spark):
    audio = np.random.default_rng(1).normal(size=(11_520, 8)).astype(np.float32)
    a, out, at = Assembler(), [], 0
    for seq, n in enumerate(sizes):
        out += a.add(0, None, Block(at, seq, audio[at : at + n]))
        at += n
    assert [w.decision_sample for w in out] == list(range(7680, 11_521, 960)) and all(np.array_equal(w.samples, x) for w, x in zip(out, plain_windows(audio), strict=True))
    ends = np.cumsum(sizes)
    for w in out:
        assert w.sequence_ids == [i for i, (e, n) in enumerate(zip(ends, sizes)) if e > w.decision_sample - 7680 and e - n < w.decision_sample]
    assert sum(len(b.samples) for b in a.ring) <= 7680 + max(sizes)
    batch = recut.windows(recut.hops(spark.createDataFrame(cut(audio, sizes), BLOCKS)), chunk=9).orderBy("window_id").collect()
    assert [(r.window_id, r.decision_sample, r.sequence_ids) for r in batch] == [(w.window_id, w.decision_sample, w.sequence_ids) for w in out]
    assert all(np.array_equal(np.array(r.samples, np.float32), w.samples.ravel()) for r, w in zip(batch, out, strict=True))


def test_hops_are_cut_across_blocks(spark):
    audio = np.random.default_rng(7).normal(size=(2400, 8)).astype(np.float32)
    got = recut.hops(spark.createDataFrame(cut(audio, [137, 1100, 1163]), BLOCKS)).orderBy("hop").collect()
    assert [(r.start_sample, r.end_sample, r.sequence_ids) for r in got] == [(0, 960, [0, 1]), (960, 1920, [1, 2])]
    assert all(np.array_equal(np.array(r.samples, np.float32), audio[r.start_sample : r.end_sample].ravel()) for r in got)
    made = cut(audio, [1, 958, 2, 0, 1439]) + cut(audio, [959], session=1) + cut(audio, [2400], session=2)
    both = {(r.session, r.hop): r.sequence_ids for r in recut.hops(spark.createDataFrame(made, BLOCKS)).collect()}
    assert both == {(0, 0): [0, 1, 2], (0, 1): [2, 4], (2, 0): [0], (2, 1): [0]}


def test_stream_windows_over_restarts_epochs_and_sessions(spark, tmp_path, state_store):
    rng = np.random.default_rng(3)
    x, y, z = (rng.normal(size=(n, 8)).astype(np.float32) for n in (12_000, 9_000, 8_000))
    one = cut(x, [700, 5300, 960, 5040], 1) + cut(y, [4000, 5000], 1, epoch=1, seq=10, calibration="b")
    other = cut(z, [1000] * 8, 2)
    feed = Feed(spark, tmp_path, BLOCKS, pr.windows)
    first = feed(one[:2] + other[:5])(one[2:4]).run()
    assert set(first[first.session == 1].decision_sample) == {7680, 8640, 9600, 10_560, 11_520} and not (first.session == 2).any()
    got = feed(other[5:] + one[4:5])(one[5:]).run().sort_values(["session", "window_id"])
    assert got[got.session == 1].window_id.tolist() == list(range(7)) and got[got.session == 2].window_id.tolist() == [0]
    late = got[(got.session == 1) & (got.epoch == 1)]
    assert late.decision_sample.tolist() == [7680, 8640] and late.calibration.tolist() == ["b", "b"] and late.sequence_ids.map(list).tolist() == [[10, 11]] * 2
    assert set(late.discarded) == {12_000 - 11_520} and set(got[got.epoch == 0].discarded) == {0}
    batch = recut.windows(recut.hops(spark.createDataFrame(one + other, BLOCKS))).toPandas().sort_values(["session", "window_id"])
    for c in ("session", "epoch", "window_id", "decision_sample"):
        assert got[c].tolist() == batch[c].tolist()
    assert all(np.array_equal(a, b) for a, b in zip(got.samples, batch.samples))
    assert (got.doa_start_sample == got.decision_sample - 1920).all() and (got.context_start == got.decision_sample - 7680).all()


def test_breaks_within_an_epoch_are_errors():
    a = Assembler()
    a.add(0, "x", Block(0, 0, np.zeros((960, 8), np.float32)))
    with pytest.raises(ValueError, match="calibration"):
        a.add(0, "y", Block(960, 1, np.zeros((960, 8), np.float32)))
    with pytest.raises(ValueError, match="gaps start an epoch"):
        a.add(0, "x", Block(1000, 1, np.zeros((960, 8), np.float32)))


def test_ten_minutes_keep_a_ring_only():
    a, block, n = Assembler(), np.zeros((960, 8), np.float32), 0
    for i in range(30_000):
        found = a.add(0, None, Block(i * 960, i, block))
        n += len(found)
        assert len(found) == (i >= 7) and len(a.ring) <= 8
    assert (n, found[0].window_id, found[0].decision_sample) == (29_993, 29_992, 28_800_000)


HOPS = sy.BLOCKS + ", calibration string"


def noise_hops(n, session, seed, epoch=0, calibration="a"):
    x = np.random.default_rng(seed).normal(0, 0.01, (960 * n, 8)).astype(np.float32)
    x[960 * n // 2 :, :7] += 0.2 * np.sin(np.arange(960 * n - 960 * n // 2) * 0.3)[:, None].astype(np.float32)
    return sy.blocks_of(x, session, epoch).assign(calibration=calibration, samples=lambda d: d.samples.map(lambda v: v.tolist()))


def compare(got, want, *keys):
    got, want = (d.sort_values(list(keys)).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) > 0
    for c in want.columns:
        same = [np.array_equal(np.asarray(a), np.asarray(b)) if not isinstance(a, (float, type(None))) else a == b or (pd.isna(a) and pd.isna(b)) for a, b in zip(got[c], want[c])]
        assert all(same), c


@pytest.fixture(scope="module")
def noisy(spark):
    """A session that warms up and goes on in another epoch, one that changes its calibration, one that is short."""
    return pd.concat([noise_hops(60, 1, 1), noise_hops(6, 1, 2, epoch=1), noise_hops(55, 2, 3), noise_hops(55, 2, 4, epoch=1, calibration="b"), noise_hops(4, 3, 5)])


def test_stream_presence_equals_batch(spark, tmp_path, state_store, noisy):
    want = ac.presence(spark.createDataFrame(noisy, HOPS)).toPandas()
    states = want.sort_values(["session", "epoch", "end_sample"]).groupby(["session", "epoch"]).state.agg(list).to_dict()
    assert set(states[1, 1]) == {"ready"} and states[2, 1][:49] == ["warming_up"] * 49 and set(states[2, 1][49:]) == {"ready"} and set(states[3, 0]) == {"warming_up"}
    feed = Feed(spark, tmp_path, HOPS, pr.presence)
    cuts = np.array_split(np.arange(len(noisy)), [10, 62, 90, 150])
    for part in cuts[:2]:
        feed(noisy.iloc[part])
    feed.run()
    for part in cuts[2:]:
        feed(noisy.iloc[part])
    compare(feed.run(), want, "session", "epoch", "end_sample")


def test_stream_presence_goes_on_from_batch(spark, tmp_path, state_store, noisy):
    early, late = noisy[(noisy.epoch == 0)], noisy[noisy.epoch == 1]
    states = ac.tracker_states(spark.createDataFrame(early, HOPS))
    want = ac.presence(spark.createDataFrame(noisy, HOPS)).where("epoch = 1").toPandas()
    feed = Feed(spark, tmp_path, HOPS, lambda s: pr.presence(s, states))
    got = feed(late.iloc[:20])(late.iloc[20:]).run()
    compare(got, want, "session", "epoch", "end_sample")


def test_stream_denoiser_equals_batch(spark, tmp_path, state_store, noisy):
    want = ac.denoised(spark.createDataFrame(noisy, HOPS)).select(*[c.split()[0] for c in pr.DENOISED.split(", ")]).toPandas()
    last = want.groupby("session")[["epoch", "hop"]].apply(lambda d: tuple(d.sort_values(["epoch", "hop"]).iloc[-1]))
    want = want[[(e, h) != last[s] for s, e, h in zip(want.session, want.epoch, want.hop)]]  # the stream goes on
    feed = Feed(spark, tmp_path, HOPS, pr.denoised)
    feed(noisy.iloc[:37]).run()
    compare(feed(noisy.iloc[37:120])(noisy.iloc[120:]).run(), want, "session", "epoch", "hop")


def test_a_null_session_keeps_its_state_over_batches(spark):
    rows = noise_hops(60, 0, 9).assign(session=None)
    df = spark.createDataFrame(rows.astype({"session": "object"}), HOPS)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        assert ac.presence(df).where("state = 'ready'").count() == 11
    finally:
        spark.conf.set(name, before)


def plain_recent(ids, last):
    held, out = [], []
    for i in ids:
        out.append(i not in held)
        if out[-1]:
            held = [*held, i][-last:]
    return out


def test_the_last_ids_only(spark, tmp_path, state_store):
    rng = np.random.default_rng(4)
    rows = [(s, k, int(i)) for s in (1, 2) for k, i in enumerate([*range(1026), 0, 1, 1025, *rng.integers(0, 1500, 400)])]
    schema = "session long, at long, id long"
    want = {(s, k) for s in (1, 2) for (_, k, _), new in zip([r for r in rows if r[0] == s], plain_recent([r[2] for r in rows if r[0] == s], 1024)) if new}
    assert (1, 1026) in want and (1, 1028) not in want
    batch = sq.recent_ids(spark.createDataFrame(rows, schema), ["session"], ["at"], "id")
    assert {(r.session, r["at"]) for r in batch.collect()} == want
    feed = Feed(spark, tmp_path, schema, lambda s: pr.recent_ids(s, "session", "at", "id"))
    feed([r for r in rows if r[1] < 700]).run()
    got = feed([r for r in rows if 700 <= r[1] < 1027])([r for r in rows if r[1] >= 1027]).run()
    assert {(r.session, r.at) for r in got.itertuples()} == want and len(got) == len(want)
