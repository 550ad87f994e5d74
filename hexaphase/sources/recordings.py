"""Recordings as a Spark data source: PCM16 in WAV or raw files, in partitions of byte ranges.

    register(spark)
    spark.read.format("recordings").load(folder)         # one row a hop: path, rate, hop, start_sample, samples
    spark.readStream.format("recordings").load(folder)   # hops as files come, and as raw files grow

A partition reads its own bytes and no others, so a recording of any size spreads over tasks, and no row is larger than a hop.
Paths may be of any file system that pyarrow opens by its URI. Options: hop (samples, 960), partition_bytes (32 MB), and, for raw
files (any name but .wav), channels (8) and rate (48000). A last part of less than a hop is left out. A stream's offset is the
number of whole hops of each file, so a restart goes on where the last batch ended; files must not shrink.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..model import CHANNELS, HOP, SAMPLE_RATE

SCHEMA = "path string, rate long, hop long, start_sample long, samples array<float>"
PARTITION_BYTES, READ_BYTES = 1 << 25, 1 << 20
_UNKNOWN = 0xFFFFFFFF


@dataclass(frozen=True)
class Recording:
    """Where the samples of a file lie."""

    path: str
    at: int
    size: int
    channels: int
    rate: int

    def hops(self, hop: int) -> int:
        return self.size // (2 * self.channels * hop)


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def wav_header(f, size: int, path: str = "") -> Recording:
    """Walks the chunks of a RIFF or RF64 file of size bytes up to its samples."""
    head = f.read(12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError(f"not a WAV file: {path}")
    at, form, long_size = 12, None, None
    while at + 8 <= size:
        f.seek(at)
        name, n = struct.unpack("<4sI", f.read(8))
        if name == b"ds64":
            long_size = struct.unpack("<QQ", f.read(16))[1]
        elif name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
            if bits != 16 or kind not in (1, 0xFFFE):
                raise ValueError(f"only PCM16 is read: {path}")
            form = channels, rate
        elif name == b"data":
            if form is None:
                raise ValueError(f"samples before their format: {path}")
            n = (long_size if long_size is not None else size) if n == _UNKNOWN else n
            return Recording(path, at + 8, min(n, size - at - 8), *form)
        at += 8 + n + n % 2
    raise ValueError(f"no samples: {path}")


def found(path: str, channels: int = CHANNELS, rate: int = SAMPLE_RATE) -> list[Recording]:
    """The recordings at a file's or under a folder's path, by name; the last part of a path may be a pattern. Only headers are read."""
    folder, _, pattern = path.rpartition("/")
    path, pattern = (folder or ".", pattern) if "*" in pattern else (path, "*")
    system, root = _file_system(path)
    info = system.get_file_info(root)
    files = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=True))
    prefix, out = path[: len(path) - len(root)] if path.endswith(root) else "", []
    files = [i for i in files if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_")) and fnmatch(i.base_name, pattern)]
    for i in sorted(files, key=lambda i: i.path):
        if i.extension.lower() == "wav":
            with system.open_input_file(i.path) as f:
                out.append(wav_header(f, i.size, prefix + i.path))
        else:
            out.append(Recording(prefix + i.path, 0, i.size, channels, rate))
    return out


@dataclass
class HopRange(InputPartition):
    recording: Recording
    first: int
    end: int


def ranges(recording: Recording, first: int, end: int, hop: int, partition_bytes: int) -> list[HopRange]:
    step = max(1, partition_bytes // (2 * recording.channels * hop))
    return [HopRange(recording, a, min(a + step, end)) for a in range(first, end, step)]


def read_range(part: HopRange, hop: int) -> Iterator[pa.RecordBatch]:
    r = part.recording
    width = 2 * r.channels * hop
    system, path = _file_system(r.path)
    with system.open_input_file(path) as f:
        step = max(1, READ_BYTES // width)
        for a in range(part.first, part.end, step):
            n = min(step, part.end - a)
            f.seek(r.at + a * width)
            raw = f.read(n * width)
            if len(raw) != n * width:
                raise ValueError(f"{r.path} is shorter than it was")
            samples = pa.array((np.frombuffer(raw, "<i2") / 32768.0).astype(np.float32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (r.channels * hop)), samples)
            hops = np.arange(a, a + n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r.path] * n), pa.array(np.full(n, r.rate, np.int64)), pa.array(hops), pa.array(hops * hop), lists], names=[c.split()[0] for c in SCHEMA.split(", ")])


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options.get("path", "")
        if not self.path:
            raise ValueError("recordings need a path")
        self.hop, self.partition_bytes = int(options.get("hop", HOP)), int(options.get("partition_bytes", PARTITION_BYTES))
        self.channels, self.rate = int(options.get("channels", CHANNELS)), int(options.get("rate", SAMPLE_RATE))

    def found(self) -> list[Recording]:
        return found(self.path, self.channels, self.rate)


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = _Options(options)

    def partitions(self) -> list[HopRange]:
        return [p for r in self.o.found() for p in ranges(r, 0, r.hops(self.o.hop), self.o.hop, self.o.partition_bytes)]

    def read(self, partition: HopRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition, self.o.hop)


class RecordingStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = _Options(options)

    def initialOffset(self) -> dict:
        return {"hops": json.dumps({})}

    def latestOffset(self) -> dict:
        return {"hops": json.dumps({r.path: r.hops(self.o.hop) for r in self.o.found()}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[HopRange]:
        before, now = json.loads(start["hops"]), json.loads(end["hops"])
        known = {r.path: r for r in self.o.found()}
        return [p for path in sorted(now) if now[path] > before.get(path, 0) for p in ranges(known[path], before.get(path, 0), now[path], self.o.hop, self.o.partition_bytes)]

    def read(self, partition: HopRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition, self.o.hop)

    def commit(self, end: dict) -> None:
        pass


class RecordingDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(dict(self.options))

    def streamReader(self, schema) -> RecordingStreamReader:
        return RecordingStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingDataSource)


@dataclass(frozen=True)
class RecordingSource:
    """An AudioSource: the hops of recordings as blocks; each file is a session, named by a hash of its path."""

    path: str
    channels: int = CHANNELS
    partition_bytes: int = PARTITION_BYTES

    def _blocks(self, reader) -> DataFrame:
        rows = reader.format("recordings").option("channels", self.channels).option("partition_bytes", self.partition_bytes).load(self.path)
        return rows.select(F.xxhash64("path").alias("session"), F.lit(0).cast("long").alias("epoch"), "hop", "start_sample", (F.col("start_sample") + HOP).alias("end_sample"), "samples")

    def blocks(self, spark: SparkSession) -> DataFrame:
        register(spark)
        return self._blocks(spark.read)

    def stream(self, spark: SparkSession) -> DataFrame:
        register(spark)
        return self._blocks(spark.readStream)
