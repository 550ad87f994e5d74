"""Steps that depend on the one before: one function per operator, state in, state out, so that batch and stream share them."""

from __future__ import annotations

from collections import deque

from ..model import RateConfig


def rate_step(state: tuple[int, int] | None, queue_wait: float, slowest: float, cfg: RateConfig = RateConfig()) -> tuple[int, int]:  # noqa: B008
    """(period, healthy time) after a computed window: up at an overload, down after a healthy stretch."""
    period, healthy = state or (cfg.base_ms, 0)
    if queue_wait > cfg.overload_ms or slowest > period:
        return min(cfg.maximum_ms, period + cfg.base_ms), 0
    if period == cfg.base_ms:
        return period, 0
    target = period - cfg.base_ms
    limit = max(cfg.recovery_ms, target - (cfg.base_ms - cfg.recovery_ms))
    if max(queue_wait, slowest) > limit:
        return period, 0
    healthy += period
    return (target, 0) if healthy >= cfg.stable_ms else (period, healthy)


def queue_step(state: tuple[int, int] | None, arrivals: int, served: int, capacity: int) -> tuple[int, int]:
    """(depth, drops) of a queue that drops its oldest entry when full."""
    depth, drops = state or (0, 0)
    over = max(0, depth + arrivals - capacity)
    return max(0, depth + arrivals - over - served), drops + over


def sample_step(anchor: int | None, now: int, gap: int) -> tuple[int, bool]:
    """(anchor, kept): kept if at least gap after the last kept one."""
    return (now, True) if anchor is None or now - anchor >= gap else (anchor, False)


class RunningMinimum:
    """Minimum over the last sub-windows of a fixed number of steps."""

    def __init__(self, steps: int = 5, windows: int = 10) -> None:
        self.steps, self.history, self.n, self.least, self.part = steps, deque(maxlen=windows), 0, None, None

    def __call__(self, value: float) -> float:
        first = self.least is None
        self.least = value if first else min(self.least, value)
        self.part = value if first else min(self.part, value)
        self.n += 1
        if self.n % self.steps == 0:
            self.history.append(self.part)
            self.least, self.part = min(self.history), value
        return self.least
