"""Fixed values of the data model: timing, geometry, calibration, gate, transforms, configuration."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields

import numpy as np

SAMPLE_RATE, HOP, DOA, CONTEXT, CHANNELS, MICS = 48_000, 960, 1_920, 7_680, 8, 7
# Native to logical channels, calibration of the seven microphones.
CHANNEL_MAP = (0, 1, 2, 3, 4, 5, 7, 6)
GAINS = (1.069754, 1.034156, 1.100770, 1.056586, 1.093528, 1.056039, 0.673006)
POLARITY = (1, 1, 1, 1, 1, 1, 1)
DELAYS = (2, 1, 2, 0, 1, 0, 1)
# The gate's bands (low, high, share) and the profile of its lowest band from 250 Hz in steps of 50 Hz.
GATE_BANDS = ((250.0, 600.0, 0.30), (600.0, 1600.0, 0.30), (1600.0, 3400.0, 0.40))
LOW_PROFILE = (0.161502, 0.180000, 0.180000, 0.180000, 0.163814, 0.088159, 0.041165, 0.005360)
GATE_THRESHOLD = 0.80
# Geometry of the array in metres and the speed of sound.
RADIUS_M, SPEED_OF_SOUND = 0.04, 343.0
MIC_ANGLES_DEG = (0.0, 300.0, 240.0, 180.0, 120.0, 60.0)


@dataclass(frozen=True)
class TrackerConfig:
    association_gate_deg: float = 50.0
    association_chi2: float = 20.0
    max_velocity_dps: float = 60.0
    confirmation_observations: int = 10
    confirmation_window_samples: int = 24_000
    tentative_ttl_samples: int = 24_000
    coasting_ttl_samples: int = 96_000
    probability_detect: float = 0.85
    probability_track: float = 0.80
    probability_new: float = 0.10
    probability_false: float = 0.10
    minimum_association_probability: float = 0.20
    minimum_birth_probability: float = 0.45
    confirmation_existence_probability: float = 0.70
    deletion_existence_probability: float = 0.05
    survival_probability_per_second: float = 0.97**50
    measurement_std_deg: float = 5.0
    angle_std_deg: tuple[float, float] = (0.35, 1.25)
    velocity_std_dps: tuple[float, float] = (3.0, 15.0)
    half_life_seconds: tuple[float, float] = (0.15, 0.50)
    leave_probability: tuple[float, float] = (0.02, 0.05)
    prediction_freeze_std_deg: float = 25.0
    duplicate_birth_guard_deg: float = 15.0
    max_active_tracks: int = 4


@dataclass(frozen=True)
class ScanConfig:
    n_fft: int = 1024
    win: int = 960
    step: int = 480
    low_hz: float = 2000.0
    high_hz: float = 4000.0
    max_frames: int = 19
    count_frames: int = 15
    shrinkage: float = 0.05
    loading: float = 1e-3
    floor: float = 1e-10
    min_bins: int = 12
    threshold: float = 0.35
    prominence: float = 0.05
    min_distance_deg: float = 50.0
    lag_oversampling: int = 4
    activity_dbfs: float = -70.0
    first_peak: float = 0.16
    first_z: float = 2.0
    second_peak: float = 0.07
    second_z: float = 2.0
    second_ratio: float = 0.09
    notch_strength: float = 0.90
    notch_width: float = 0.25
    coactive_level: float = 0.08
    coactive_frames: int = 3


@dataclass(frozen=True)
class RateConfig:
    base_ms: int = 20
    maximum_ms: int = 200
    overload_ms: float = 20.0
    recovery_ms: float = 12.0
    stable_ms: int = 5_000


@dataclass(frozen=True)
class ProjectConfig:
    """Unknown keys are refused; sections cross-check each other."""

    gate_threshold: float = GATE_THRESHOLD
    tracker: TrackerConfig = field(default_factory=TrackerConfig)
    scan: ScanConfig = field(default_factory=ScanConfig)
    rate: RateConfig = field(default_factory=RateConfig)

    @classmethod
    def load(cls, values: dict) -> ProjectConfig:
        parts = {}
        for f in fields(cls):
            if f.name in values:
                kind = {"tracker": TrackerConfig, "scan": ScanConfig, "rate": RateConfig}.get(f.name)
                parts[f.name] = kind(**values[f.name]) if kind else values[f.name]
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown configuration: {sorted(unknown)}")
        out = cls(**parts)
        t, r = out.tracker, out.rate
        if not 0 <= out.gate_threshold <= 1 or abs(t.probability_track + t.probability_new + t.probability_false - 1) > 1e-9:
            raise ValueError("probabilities must lie in [0, 1], and those of track, new and false sum to one")
        if not 0 < r.base_ms <= r.maximum_ms or r.recovery_ms > r.overload_ms:
            raise ValueError("the rate's limits contradict each other")
        return out

    def identity(self) -> str:
        """SHA-256 of the canonical JSON."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def mic_positions(radius: float = RADIUS_M) -> np.ndarray:
    """[7, 2]: a hexagon and its centre."""
    a = np.deg2rad(MIC_ANGLES_DEG)
    return np.vstack([radius * np.column_stack([np.cos(a), np.sin(a)]), [[0.0, 0.0]]])


def gate_weights(freqs: np.ndarray) -> np.ndarray:
    """Weights of the frequency bins, which sum to one."""
    out = np.zeros(len(freqs))
    for i, (low, high, share) in enumerate(GATE_BANDS):
        inner = i == 1
        at = np.flatnonzero((freqs > low) & (freqs < high) if inner else (freqs >= low) & (freqs <= high))
        if not len(at) or i == 0 and (len(at) != len(LOW_PROFILE) or not np.allclose(freqs[at], np.arange(250, 601, 50), rtol=0, atol=1e-6)):
            raise ValueError(f"the axis does not cover {low:g}-{high:g} Hz")
        out[at] = share * np.array(LOW_PROFILE) if i == 0 else share / len(at)
    return out


def frequency_weights(freqs: np.ndarray) -> np.ndarray:
    """Of the direction scan: steps up to 3 kHz, full to 3.6 kHz, then falling."""
    out = np.select([freqs < 2000, freqs < 2300, freqs < 2500, freqs < 2700, freqs < 3000, freqs < 3600], [0.0, 0.35, 0.55, 0.75, 0.90, 1.0], np.nan)
    tail = np.interp(freqs, [3600.0, 3800.0, 4000.0], [1.0, 0.75, 0.45])
    return np.where(np.isnan(out), np.where(freqs <= 4000, tail, 0.0), out)
