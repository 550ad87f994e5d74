"""Windows and hops cut from blocks of any size: the samples of one stream, and the state that goes from block to block."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..model import CHANNELS, CONTEXT, HOP

#: A window's scan looks at its last 40 ms.
SCANNED = 2 * HOP


@dataclass
class Block:
    start: int
    seq: int
    samples: np.ndarray  # [n, channels] of float32

    @property
    def end(self) -> int:
        return self.start + len(self.samples)


@dataclass
class Window:
    epoch: int
    window_id: int
    decision_sample: int
    sequence_ids: list[int]
    samples: np.ndarray


@dataclass
class Assembler:
    """Sliding windows of one session. It keeps the blocks that the next window reaches into, and no others; ids outlive epochs."""

    epoch: int | None = None
    calibration: str | None = None
    next_decision: int = CONTEXT
    next_id: int = 0
    discarded: int = 0
    end: int = 0
    ring: list[Block] = field(default_factory=list)

    def tail(self) -> int:
        """Samples so far that no window's step has taken."""
        return max(0, self.end - (self.next_decision - HOP))

    def add(self, epoch: int, calibration: str | None, block: Block) -> list[Window]:
        if epoch != self.epoch:
            self.discarded += self.tail() if self.epoch is not None else 0
            self.epoch, self.calibration, self.next_decision, self.end, self.ring = epoch, calibration, CONTEXT, 0, []
        elif calibration != self.calibration:
            raise ValueError("the calibration changed within an epoch")
        if block.start != self.end:
            raise ValueError(f"a block starts at {block.start} where {self.end} is due: gaps start an epoch")
        self.ring.append(block)
        self.end, out = block.end, []
        while self.end >= self.next_decision:
            out.append(self._window())
            self.next_decision += HOP
            self.next_id += 1
            while self.ring and self.ring[0].end <= self.next_decision - CONTEXT:
                self.ring.pop(0)
        return out

    def _window(self) -> Window:
        start = self.next_decision - CONTEXT
        parts = [b.samples[max(0, start - b.start) : self.next_decision - b.start] for b in self.ring if b.start < self.next_decision]
        return Window(self.epoch, self.next_id, self.next_decision, [b.seq for b in self.ring if b.start < self.next_decision], np.concatenate(parts))


def rows_of(flat: np.ndarray, channels: int = CHANNELS) -> np.ndarray:
    return np.asarray(flat, np.float32).reshape(-1, channels)
