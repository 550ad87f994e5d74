"""Where blocks come from: the driver's tables, made audio, WAV files, hotmap frames."""

from . import hotmap, recordings, shared, synthetic, tables, wav

__all__ = ["hotmap", "recordings", "shared", "synthetic", "tables", "wav"]
