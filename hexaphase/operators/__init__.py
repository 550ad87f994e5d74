"""DataFrame operators: timeline, channels, spectra, acoustics, calibration, decisions, pipeline, control, records, recurrences, recut, reuse, sequential, tracklog, serving."""

from . import acoustics, calibration, channels, control, decisions, pipeline, records, recurrences, recut, reuse, sequential, serving, spectra, timeline, tracklog

__all__ = ["acoustics", "calibration", "channels", "control", "decisions", "pipeline", "records", "recurrences", "recut", "reuse", "sequential", "serving", "spectra", "timeline", "tracklog"]
