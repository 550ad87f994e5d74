"""What can be exchanged: each is a plain callable or a small object that operators take as an argument."""

from __future__ import annotations

from typing import Any, Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .model import ScanConfig, TrackerConfig


class AudioDecoder(Protocol):
    """operators.channels.decode takes one: a payload's samples in [-1, 1), row by row."""

    def __call__(self, payload: bytes, channels: int) -> np.ndarray: ...


class AudioSource(Protocol):
    """Blocks, batch or streaming: sources.recordings.RecordingSource is one, and operators.pipeline.from_source takes one."""

    def blocks(self, spark: SparkSession) -> DataFrame: ...


class HotmapSource(Protocol):
    """Frames by session and time, for decisions.latest_before()."""

    def frames(self, spark: SparkSession) -> DataFrame: ...


class DirectionScanner(Protocol):
    """operators.pipeline.process takes one: raw spectra [windows, 360] of mean covariances [windows, bins, 7, 7]; NaN where a window cannot be scanned."""

    def __call__(self, covariances: np.ndarray, order: int, cfg: ScanConfig) -> np.ndarray: ...


class DirectionTracker(Protocol):
    """operators.acoustics.tracks takes one: changes the state by a window's candidates (theta, raw score, score), and returns the live tracks."""

    def __call__(self, state: Any, epoch: int, now: int, candidates: list[tuple[float, float, float]], births: bool, period: int, cfg: TrackerConfig) -> list[dict]: ...


__all__ = ["AudioDecoder", "AudioSource", "DirectionScanner", "DirectionTracker", "HotmapSource"]
