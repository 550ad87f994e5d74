"""Configuration of the hardware and of the stages before the gate: strict sections, with YAML on the driver.

model.ProjectConfig holds what the scan, the tracker and the rate controller take; Settings joins both in one file.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from .model import CHANNEL_MAP, CHANNELS, CONTEXT, DELAYS, DOA, GAINS, HOP, MICS, POLARITY, RADIUS_M, SAMPLE_RATE, SPEED_OF_SOUND, ProjectConfig


def canonical(values: object) -> str:
    """SHA-256 of the canonical JSON: sorted keys, no blanks."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _fixed(section: object, **values: object) -> None:
    for name, value in values.items():
        if getattr(section, name) != value:
            raise ValueError(f"{name} is {getattr(section, name)!r}, and only {value!r} is supported")


def _within(section: object, **limits: tuple[float, float]) -> None:
    for name, (low, high) in limits.items():
        if not low <= getattr(section, name) <= high:
            raise ValueError(f"{name} is {getattr(section, name)!r}, outside {low:g} to {high:g}")


@dataclass(frozen=True)
class Hardware:
    mics: int = MICS
    radius_m: float = RADIUS_M
    speed_of_sound: float = SPEED_OF_SOUND
    geometry_version: str = "ring6_centre1"
    calibration_status: str = "unverified"
    report_hash: str | None = None

    def __post_init__(self) -> None:
        _fixed(self, mics=MICS)
        _within(self, radius_m=(1e-3, 10), speed_of_sound=(100, 2000))
        if self.calibration_status not in ("unverified", "verified") or (self.calibration_status == "verified") != (self.report_hash is not None):
            raise ValueError("a verified calibration has a report, an unverified one has none")


@dataclass(frozen=True)
class Device:
    sample_rate: int = SAMPLE_RATE
    channels: int = CHANNELS
    pcm_format: str = "s16-le"
    layout: str = "interleaved"
    block_samples: int = HOP
    channel_map: tuple[int, ...] = CHANNEL_MAP
    name: str = ""
    host_api: str = ""
    serial_enabled: bool = False
    serial_port: str = ""
    serial_baud: int = 115_200
    serial_required: bool = False

    def __post_init__(self) -> None:
        _fixed(self, sample_rate=SAMPLE_RATE, channels=CHANNELS, pcm_format="s16-le", layout="interleaved", block_samples=HOP)
        _within(self, serial_baud=(1, 10_000_000))
        if sorted(self.channel_map) != list(range(CHANNELS)):
            raise ValueError("the channel map is no permutation of the channels")
        if self.serial_required and not self.serial_enabled:
            raise ValueError("a serial port that is required must be enabled")


@dataclass(frozen=True)
class Calibration:
    version: str = "1"
    gains: tuple[float, ...] = GAINS
    polarity: tuple[int, ...] = POLARITY
    delays: tuple[int, ...] = DELAYS

    def __post_init__(self) -> None:
        if not len(self.gains) == len(self.polarity) == len(self.delays) == MICS:
            raise ValueError(f"a calibration has {MICS} values of each kind")
        if min(self.gains) <= 0 or set(self.polarity) - {1, -1} or min(self.delays) < 0:
            raise ValueError("gains are above 0, polarities 1 or -1, delays 0 or more")

    def identity(self) -> str:
        return canonical(asdict(self))


@dataclass(frozen=True)
class Timing:
    hop: int = HOP
    doa: int = DOA
    context: int = CONTEXT
    timestamp_tolerance_ms: float = 5.0

    def __post_init__(self) -> None:
        _fixed(self, hop=HOP, doa=DOA, context=CONTEXT)
        _within(self, timestamp_tolerance_ms=(0, 1e6))


@dataclass(frozen=True)
class Noise:
    enabled: bool = True
    warm_up_seconds: float = 1.0
    eps: float = 1e-12

    def __post_init__(self) -> None:
        _within(self, warm_up_seconds=(1e-3, 3600), eps=(1e-300, 1))


@dataclass(frozen=True)
class Denoise:
    enabled: bool = False
    minimum_gain_db: float = -18.0
    gain_smoothing: float = 0.8

    def __post_init__(self) -> None:
        _within(self, minimum_gain_db=(-120, 0), gain_smoothing=(0, 0.999999))


@dataclass(frozen=True)
class TrackLog:
    max_ids: int = 1000
    sample_seconds: float = 5.0
    submit_seconds: float = 1.0

    def __post_init__(self) -> None:
        _within(self, max_ids=(1, 10_000_000), sample_seconds=(0, 1e6), submit_seconds=(0, 1e6))


_SECTIONS = {"hardware": Hardware, "device": Device, "calibration": Calibration, "timing": Timing, "noise": Noise, "denoise": Denoise, "track_log": TrackLog}


@dataclass(frozen=True)
class Settings:
    """All sections; unknown sections and keys are refused, and sections are held against each other."""

    hardware: Hardware = field(default_factory=Hardware)
    device: Device = field(default_factory=Device)
    calibration: Calibration = field(default_factory=Calibration)
    timing: Timing = field(default_factory=Timing)
    noise: Noise = field(default_factory=Noise)
    denoise: Denoise = field(default_factory=Denoise)
    track_log: TrackLog = field(default_factory=TrackLog)
    project: ProjectConfig = field(default_factory=ProjectConfig)

    def __post_init__(self) -> None:
        if self.denoise.enabled and not self.noise.enabled:
            raise ValueError("the denoiser needs the noise tracker")

    @classmethod
    def load(cls, values: dict) -> Settings:
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        parts: dict[str, object] = {}
        for name, own in values.items():
            if name == "project":
                parts[name] = ProjectConfig.load(own)
                continue
            kind = _SECTIONS[name]
            if unknown := set(own) - {f.name for f in fields(kind)}:
                raise ValueError(f"unknown keys in {name}: {sorted(unknown)}")
            parts[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})
        return cls(**parts)

    @classmethod
    def read(cls, path: str) -> Settings:
        """From a YAML file."""
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the package yaml; use Settings.load() with a dictionary") from e
        return cls.load(yaml.safe_load(Path(path).read_text()) or {})

    def identity(self) -> str:
        return canonical(asdict(self))
