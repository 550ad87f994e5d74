"""Recordings as files: PCM16 WAV in, and writers for the driver side."""

from __future__ import annotations

import hashlib
import io
import json
import wave
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Samples [n, channels] in [-1, 1) and the rate."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only PCM16 is read")
        raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return (raw / 32768.0).astype(np.float32), w.getframerate()


def encode(samples: np.ndarray, rate: int = 48_000) -> bytes:
    """Clipped and rounded half to even."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(samples * 32768.0), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def read(spark: SparkSession, path: str, hop: int = 960) -> DataFrame:
    """One row per whole hop of each file: path, rate, hop, samples. Files are read in byte ranges, by sources.recordings."""
    from . import recordings

    recordings.register(spark)
    return spark.read.format("recordings").option("hop", hop).load(path).select("path", "rate", "hop", "samples")


def write(path: str, samples: np.ndarray, rate: int = 48_000) -> str:
    """SHA-256 of the file."""
    content = encode(samples, rate)
    Path(path).write_bytes(content)
    return hashlib.sha256(content).hexdigest()


def checked_frames(recordings: DataFrame, seconds: float) -> DataFrame:
    """Recordings (path, rate, hop) whose whole hops are too few for the time that they should hold: path, hops, wanted."""
    from pyspark.sql import functions as F

    n = recordings.groupBy("path").agg(F.count("*").alias("hops"), F.floor(F.first("rate") * seconds / 960).cast("long").alias("wanted"))
    return n.where("hops < wanted")


def write_manifest(path: str, files: dict[str, str], **report: object) -> None:
    """A JSON file: names with their SHA-256, and what the report says. A driver-side report of a few files."""
    Path(path).write_text(json.dumps({"files": [{"name": n, "sha256": h} for n, h in sorted(files.items())]} | report, sort_keys=True, indent=1) + "\n")
