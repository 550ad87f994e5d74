"""Frames of a 16 by 16 byte matrix from a serial byte stream: 16 bytes 0xFF lead each frame; other bytes are skipped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.acoustics import carried

LEAD, SIDE = b"\xff" * 16, 16


def frames(data: bytes, rest: bytes = b"") -> tuple[list[bytes], bytes]:
    """Whole frames, and the bytes to keep for the next piece."""
    data, out = rest + data, []
    while (at := data.find(LEAD)) >= 0:
        end = at + len(LEAD) + SIDE * SIDE
        if len(data) < end:
            return out, data[at:]
        out.append(data[at + len(LEAD) : end])
        data = data[end:]
    return out, data[-(len(LEAD) - 1) :] if data else b""


def parse(pieces: DataFrame, device: str = "device", order: str = "seq") -> DataFrame:
    """Per device its frames in order: frame_no and matrix. A task holds a batch of pieces and what a frame still lacks, however long a device's stream is."""

    def step(state: list, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data in rows["payload"]:
            new, state[0] = frames(bytes(data), state[0])
            out += new
        state[1] += len(out)
        return pd.DataFrame({device: rows[device].iloc[0], "frame_no": range(state[1] - len(out), state[1]), "matrix": pd.Series([list(f) for f in out], dtype=object)})

    kind = pieces.schema[device].dataType.simpleString()
    return carried(pieces.select(device, order, "payload"), [device], [order], f"{device} {kind}, frame_no long, matrix array<short>", lambda: [b"", 0], step)


def command(light: bool | None = None, beam: int | None = None, threshold: int | None = None, reset: bool = False) -> bytes:
    """The device's command bytes."""
    if light is not None:
        return b"E" if light else b"e"
    if beam is not None:
        if not 0 <= beam <= 11:
            raise ValueError("beams are 0 to 11")
        return b"0123456789AB"[beam : beam + 1]
    if threshold is not None:
        return b"T" if threshold > 0 else b"t"
    if reset:
        return b"R"
    raise ValueError("no command")
