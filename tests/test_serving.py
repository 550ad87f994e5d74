import numpy as np
import pytest
from pyspark.sql import functions as F

from hexaphase.kernels import voice
from hexaphase.operators import serving as sv
from hexaphase.sources import wav


def test_voice_weights():
    f = np.arange(1, 161) * 50.0
    w = voice.weights(f)
    assert w.sum() == pytest.approx(1) and 200 <= f[w.argmax()] <= 650
    with pytest.raises(ValueError):
        voice.weights(np.array([0.0]))


def test_wav_round_trip(spark, tmp_path):
    x = (np.random.default_rng(0).integers(-32768, 32768, (1_000, 8)) / 32768).astype(np.float32)
    wav.write(str(tmp_path / "a.wav"), x)
    rows = wav.read(spark, str(tmp_path / "*.wav"), hop=250).orderBy("hop").collect()
    assert len(rows) == 4 and rows[0].rate == 48_000 and np.allclose(np.concatenate([r.samples for r in rows]), x.ravel())


def test_views(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(100)], "session long, seq long, ts double")
    assert sv.recent(df, "session", "ts", 9.5).count() == 10
    c = sv.computed(df, ["session"], "seq", F.lit(4), F.col("seq") == 10)
    assert [r.seq for r in c.where("computed and seq < 20").orderBy("seq").collect()] == [0, 4, 8, 10, 14, 18]
    assert sv.confirmations(df, ["session"], "seq", 10, 24_000).where("confirmed").count() == 91
    t = spark.createDataFrame([(0, k, k + 1, 0.5, th, s) for k, (th, s) in enumerate([(10.0, "confirmed"), (355.0, "tentative"), (100.0, "coasting")])], "w long, track_id long, rank long, score double, theta double, state string")
    assert sv.clicked(t, 2.0).first().track_id == 1
    assert [r.colour for r in sv.colours(t, ["w"]).orderBy("track_id").collect()] == [0, None, 1]
    assert sv.switches(df.withColumn("o", F.col("seq") % 2), ["session"], "seq", "o").first().switches == 99


def test_rules_part_good_and_bad(spark):
    df = spark.createDataFrame([([0.0] * 16, 0, 2), ([0.0] * 15, 0, 2), ([float("nan")] * 8, 0, 1), (None, 0, 1)], "samples array<double>, start_sample long, end_sample long")
    good, bad = sv.checked(df, **sv.block_rules())
    assert good.count() == 1 and bad.count() == 3 and {x for r in bad.collect() for x in r.broken} == {"shape", "finite", "interval"}


def test_displays(spark):
    d = spark.createDataFrame([("Mic Array 8", "Windows WDM-KS", 8), ("mic array", "windows wdm-ks", 2), ("Webcam", "Windows WDM-KS", 8)], "name string, host_api string, channels long")
    assert [r.name for r in sv.devices(d, "mic array", "wdm-ks").collect()] == ["Mic Array 8"]
    hop = spark.createDataFrame([("abcdefghij", 3, 960)], "session string, epoch long, end_sample long")
    assert sv.hop_status(hop).first().status == "RUNNING | session abcdefgh | epoch 003 | sample 0000000960"
    t = spark.createDataFrame([(0, k, k, 1.0, th) for k, th in enumerate([0.0, 90.0, 180.0, 270.0], 1)], "w long, track_id long, rank long, score double, theta double")
    p = {r.track_id: (round(r.x, 3), round(r.y, 3)) for r in sv.polar(t).collect()}
    assert p[1] == (0.0, 0.965) and p[2] == (0.965, 0.0)
    assert [r.track_id for r in sv.top_tracks(t, ["w"]).orderBy("rank").collect()] == [1, 2, 3]
    m = spark.createDataFrame([(1.0,), (0.1,), (0.0,)], "rms double")
    assert [round(r.shown_db, 3) for r in sv.meter_levels(m).collect()] == [0.0, -20.0, -120.0]
    ages = spark.createDataFrame([(1.0,), (1.6,)], "published double")
    assert [r.published for r in sv.fresh(ages, F.lit(2.0), "published").collect()] == [1.6]
