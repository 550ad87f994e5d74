"""Configuration, interfaces, rules of records, and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import hexaphase
from hexaphase.config import Calibration, Settings
from hexaphase.operators import channels as ch
from hexaphase.operators import decisions as de
from hexaphase.operators import serving as sv
from hexaphase.operators import timeline as tl
from hexaphase.sources import wav
from hexaphase.streaming import stateful as st


def test_settings_round_trip(tmp_path):
    yaml = pytest.importorskip("yaml")
    path = tmp_path / "s.yaml"
    path.write_text(yaml.safe_dump({"device": {"name": "array", "serial_baud": 9600}, "calibration": {"delays": [0, 0, 0, 0, 0, 0, 1]}, "project": {"gate_threshold": 0.6}}))
    s = Settings.read(str(path))
    assert s.device.serial_baud == 9600 and s.calibration.delays[-1] == 1 and s.project.gate_threshold == 0.6
    assert s.identity() == Settings.read(str(path)).identity() != Settings().identity() and Calibration().identity() != s.calibration.identity()


@pytest.mark.parametrize(
    "values",
    [
        {"nonsense": {}},
        {"device": {"nonsense": 1}},
        {"device": {"sample_rate": 44_100}},
        {"device": {"channel_map": [0, 1, 2, 3, 4, 5, 6, 6]}},
        {"device": {"serial_required": True}},
        {"hardware": {"calibration_status": "verified"}},
        {"hardware": {"radius_m": -1.0}},
        {"calibration": {"gains": [1.0]}},
        {"calibration": {"polarity": [1, 1, 1, 1, 1, 1, 0]}},
        {"timing": {"hop": 480}},
        {"noise": {"enabled": False}, "denoise": {"enabled": True}},
        {"denoise": {"gain_smoothing": 1.0}},
        {"project": {"gate_threshold": 2.0}},
    ],
)
def test_settings_refuse(values):
    with pytest.raises(ValueError):
        Settings.load(values)


def test_public_names():
    assert all(hasattr(hexaphase, name) for name in hexaphase.__all__)


def test_decoder_is_an_argument(spark):
    df = spark.createDataFrame([(1, bytearray(range(16)))], "seq long, payload binary")
    assert ch.decode(df, lambda payload, channels: np.frombuffer(payload, np.uint8) / 256).first().samples[3] == pytest.approx(3 / 256)
    assert len(ch.decode_pcm16(df, channels=8).first().samples) == 8
    with pytest.raises(Exception, match="whole number of rows"):
        ch.decode_pcm16(spark.createDataFrame([(bytearray(3),)], "payload binary")).collect()


def test_side_input_may_be_required(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 7), (1, 3, None)], "s long, t long, x long")
    args = (["s"], ["t"], F.col("x").isNotNull(), ["x"])
    assert [(r.asof_x, r.degraded) for r in de.side_input(df, *args).orderBy("t").collect()] == [(None, True), (7, False), (7, False)]
    with pytest.raises(Exception, match="required and missing"):
        de.side_input(df, *args, required=True).collect()


def test_rules(spark):
    hops = spark.createDataFrame([(1, 0, 0, 960, 0.5, "ready"), (1, 0, 0, 960, None, "warming_up"), (1, 0, 0, 960, None, "ready"), (1, 0, 0, 959, 1.5, "ready"), (None, 0, 0, 960, None, "unavailable")], "session long, epoch long, start_sample long, end_sample long, p2 double, state string")
    good, bad = sv.checked(hops, **sv.hop_rules())
    assert good.count() == 2 and sorted(tuple(r.broken) for r in bad.collect()) == [("interval", "probability"), ("probability",), ("session",)]
    gates = de.gate(spark.createDataFrame([(0.9, "ready"), (0.1, "ready"), (None, "warming_up"), (None, "ready")], "p double, state string"), "p", "state")
    good, bad = sv.checked(gates, **sv.gate_rules())
    assert good.count() == 4 and bad.count() == 0 and {r.gate_reason for r in gates.collect()} == {de.GATE_REASONS[k] for k in ("open", "closed", "warming_up", "unavailable")}


def test_numbers_fall_back_to_places(spark):
    df = spark.createDataFrame([(1, 0, None, None), (1, 1, 9, 5.0), (1, 2, None, None)], "s long, i long, seq long, ts double")
    out = tl.numbered(df, ["s"], ["i"], "seq", "ts", F.lit(960), origin=1.0).orderBy("i").collect()
    assert [(r.seq, r.ts) for r in out] == [(0, 1.0), (9, 5.0), (2, pytest.approx(1.04))]


def test_short_recordings_and_manifest(tmp_path, spark):
    wav.write(str(tmp_path / "a.wav"), np.zeros((4_800, 8), np.float32))
    short = wav.checked_frames(wav.read(spark, str(tmp_path / "*.wav")), seconds=1.0).collect()
    assert [(r.hops, r.wanted) for r in short] == [(5, 50)]
    wav.write_manifest(str(tmp_path / "m.json"), {"a.wav": "00"}, gain=1.5)
    assert '"gain": 1.5' in (tmp_path / "m.json").read_text()


def test_fanout_and_latest(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(40).selectExpr("id % 4 as session", "id as at", "id * 2 as x").write.parquet(path)
    stream = lambda: st.read_blocks(spark, path, "session long, at long, x long")
    got = {"all": [], "few": []}
    st.fanout(stream(), {k: (lambda b, n, k=k: got[k].extend(r.at for r in b.collect())) for k in got}, str(tmp_path / "c1"), {"few": 3}, "at").awaitTermination()
    assert sorted(got["all"]) == list(range(40)) and len(got["few"]) >= 3 and 39 in got["few"]
    table = f"latest_{tmp_path.name.replace('-', '_')}"
    st.publish_latest(stream(), "session", "at", table, str(tmp_path / "c2")).awaitTermination()
    spark.range(40, 42).selectExpr("id % 4 as session", "id as at", "id * 2 as x").write.mode("append").parquet(path)
    st.publish_latest(stream(), "session", "at", table, str(tmp_path / "c2")).awaitTermination()
    assert sorted((r.session, r.at, r.x) for r in spark.table(table).collect()) == [(0, 40, 80), (1, 41, 82), (2, 38, 76), (3, 39, 78)]
