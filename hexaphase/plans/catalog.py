"""All registered queries and their oracle SQL."""

from __future__ import annotations

from . import control_queries, kernel_queries, signal_queries, stream_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "epoch_axis"
