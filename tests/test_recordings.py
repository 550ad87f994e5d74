"""The data source of recordings: byte ranges, headers, growing files, restarts; and the exactly-once view of latest rows."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexaphase.sources import hotmap, recordings, wav
from hexaphase.streaming import stateful as st


@pytest.fixture(scope="module")
def source(spark):
    recordings.register(spark)
    return recordings


def audio(n, seed=0, channels=8):
    return (np.random.default_rng(seed).integers(-30_000, 30_000, (n, channels)) / 32768).astype(np.float32)


def joined(rows):
    return np.concatenate([np.array(r.samples, np.float32) for r in sorted(rows, key=lambda r: r.hop)]).reshape(-1, 8)


def test_files_read_in_ranges(spark, source, tmp_path):
    made = {"a.wav": audio(960 * 25 + 17, 1), "b.wav": audio(960 * 3, 2), "c.wav": audio(100, 3), "d.pcm": audio(960 * 7 + 1, 4)}
    for name, x in made.items():
        if name.endswith("wav"):
            wav.write(str(tmp_path / name), x)
        else:
            (tmp_path / name).write_bytes((x * 32768).astype("<i2").tobytes())
    df = spark.read.format("recordings").option("partition_bytes", 960 * 16 * 4).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 7 + 1 + 2
    rows = df.collect()
    for name, x in made.items():
        own = [r for r in rows if r.path.endswith(name)]
        n = len(x) // 960
        assert sorted(r.hop for r in own) == list(range(n)) and all(r.start_sample == r.hop * 960 and r.rate == 48_000 for r in own)
        assert not n or np.array_equal(joined(own), x[: n * 960])
    assert wav.read(spark, str(tmp_path / "b.wav")).count() == 3


def test_a_recording_of_ten_gigabytes_is_many_small_tasks(tmp_path):
    size = 10 * (1 << 30)
    path = tmp_path / "long.wav"
    with open(path, "wb") as f:
        f.write(b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + b"ds64" + struct.pack("<IQQQI", 28, size + 72, size, size // 16, 0))
        f.write(b"fmt " + struct.pack("<IHHIIHH", 16, 1, 8, 48_000, 768_000, 16, 16) + b"data" + struct.pack("<I", 0xFFFFFFFF))
        at = f.tell()
        f.seek(at + size - 16)
        f.write(struct.pack("<8h", *range(8)))
    reader = recordings.RecordingReader({"path": str(path)})
    parts = reader.partitions()
    assert parts[-1].end == size // (960 * 16) and len(parts) > 300 and os.stat(path).st_blocks < 1000
    last = list(reader.read(parts[-1]))
    assert sum(b.num_rows for b in last) == parts[-1].end - parts[-1].first
    assert all(b.nbytes <= 4 << 20 for b in last) and 960 * 8 * 4 < 1 << 20


@pytest.mark.parametrize("content", [b"", b"RIFFxxxxWAVE", b"RIFF" + b"\0" * 40, b"RIFFxxxxWAVEdata\0\0\0\0", b"RIFFxxxxWAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 3, 2, 48_000, 0, 8, 32) + b"data\0\0\0\0"])
def test_what_is_no_pcm16_is_an_error(content, tmp_path):
    (tmp_path / "x.wav").write_bytes(content)
    with pytest.raises(ValueError):
        recordings.found(str(tmp_path))


def test_stream_of_growing_files_over_restarts(spark, source, tmp_path):
    x = audio(960 * 12, 5)
    (tmp_path / "in").mkdir()
    raw = (x * 32768).astype("<i2").tobytes()

    def run():
        q = recordings.RecordingSource(str(tmp_path / "in"), partition_bytes=960 * 16 * 2).stream(spark).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    with open(tmp_path / "in" / "a.pcm", "ab") as f:
        f.write(raw[: 960 * 16 * 5 + 100])  # five hops and a part
    assert sorted(r.hop for r in run()) == list(range(5))
    with open(tmp_path / "in" / "a.pcm", "ab") as f:
        f.write(raw[960 * 16 * 5 + 100 :])
    wav.write(str(tmp_path / "in" / "b.wav"), x[:1920])
    rows = run()
    assert len(run()) == len(rows) == 14
    by = {}
    for r in rows:
        by.setdefault(r.session, []).append(r)
    assert sorted(map(len, by.values())) == [2, 12]
    assert np.array_equal(joined(max(by.values(), key=len)), x)


def test_latest_rows_survive_a_replay(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS replayed")
    schema, table = "session long, at long, text string", "replayed.latest_rows"
    spark.sql(f"DROP VIEW IF EXISTS {table}")

    def publish():
        st.publish_latest(st.read_blocks(spark, str(tmp_path / "in"), schema, 1), "session", "at", table, str(tmp_path / "c")).awaitTermination()
        return {(r.session, r["at"], r.text) for r in spark.table(table).collect()}

    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, 1, "a"), (2, 1, "b")])
    assert publish() == {(1, 1, "a"), (2, 1, "b")}
    put([(1, 3, "c"), (3, 2, "d")])
    put([(1, 2, "late")])
    want = {(1, 3, "c"), (2, 1, "b"), (3, 2, "d")}
    assert publish() == want
    commits = sorted((p for p in (tmp_path / "c" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    version = st._property(spark, table, "latest.version")
    for _ in range(2):  # as after a crash between the switch and the commit
        for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
            p.unlink(missing_ok=True)
        assert publish() == want and st._property(spark, table, "latest.version") == version
    put([(2, 9, "e")])
    assert publish() == (want - {(2, 1, "b")}) | {(2, 9, "e")}
    assert len(spark.catalog.listTables("replayed", "latest_rows_v*")) == 2


def test_hotmap_frames_over_batches(spark):
    frame = lambda k: b"\xff" * 16 + bytes([k] * 256)
    stream = b"junk" + b"".join(frame(k) for k in range(9)) + frame(9)[:100]
    rows = [(d, i, stream[a : a + 37]) for d in (1, 2) for i, a in enumerate(range(0, len(stream), 37))]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 5)
    try:
        got = hotmap.parse(spark.createDataFrame(rows, "device long, seq long, payload binary")).withColumn("k", F.col("matrix")[0]).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted((r.device, r.frame_no, r.k) for r in got) == [(d, k, k) for d in (1, 2) for k in range(9)]


def test_a_source_goes_from_files_to_tracks(spark, source, tmp_path):
    """A recording in which somebody speaks after noise, read in ranges, gated, scanned and tracked."""
    from hexaphase.operators import pipeline as pl
    from hexaphase.sources import synthetic as sy

    made = sy.talks(spark.createDataFrame([(1, 5, 120.0, 0.3)], "session long, speaker long, theta double, level double"), "speaker", "theta", "level").orderBy("hop").collect()
    wav.write(str(tmp_path / "talk.wav"), np.concatenate([np.array(r.samples, np.float32).reshape(-1, 8) for r in made]))
    rows = pl.from_source(spark, recordings.RecordingSource(str(tmp_path), partition_bytes=960 * 16 * 20)).collect()
    shown = [d for r in rows for d in r.directions if not d.is_prediction]
    assert len(rows) == len(made) - 7 and len({r.session for r in rows}) == 1
    assert len(shown) > 20 and all(abs(d.theta - 120) <= 3 for d in shown)
