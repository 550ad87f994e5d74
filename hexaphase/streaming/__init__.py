"""The sequential operators over streams, and sinks."""

from . import stateful

__all__ = ["stateful"]
