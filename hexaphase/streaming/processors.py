"""Arbitrary state over streams: windows, noise and presence, the denoiser, and the last ids, each with typed state.

State lives in the state store as columns (numbers and arrays), a bounded amount for each key, and goes on after a restart from
the checkpoint. Rows of a micro-batch are stepped through in order of epoch and sample; across micro-batches, sources deliver in order
of arrival, as a gap is a new epoch and not late data. The steps are the kernels' own, so that a stream gives what batch gives,
bit by bit, however it is cut into blocks and micro-batches.

These operators need the RocksDB state store; use_state_store() chooses it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..kernels.axis import SCANNED, Assembler, Block, rows_of
from ..kernels.noise import Denoiser, NoiseTracker
from ..model import CONTEXT
from ..operators.acoustics import PRESENCE, PRESENCE_COLUMNS, presence_row


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ordered(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    rows = pd.concat(list(batches), ignore_index=True)
    return rows.sort_values(list(order), kind="stable")


def _calibration(rows: pd.DataFrame) -> list[str | None]:
    return [None if pd.isna(c) else c for c in rows["calibration"]] if "calibration" in rows else [None] * len(rows)


def _put(held: Any, values: list[tuple]) -> None:
    """A list state's values; the store takes no empty lists."""
    if values:
        held.put(values)
    else:
        held.clear()


WINDOWS = "session long, epoch long, window_id long, decision_sample long, doa_start_sample long, context_start long, calibration string, sequence_ids array<long>, discarded long, samples array<float>"


class WindowProcessor(StatefulProcessor):
    """A ring of the blocks that the next window reaches into, and where the stream stands."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "epoch long, calibration string, next_decision long, next_id long, discarded long, stop long")
        self.ring = handle.getListState("ring", "start long, seq long, samples array<float>")

    def handleInputRows(self, key: Any, batches: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        a = Assembler()
        if self.at.exists():
            a = Assembler(*self.at.get(), [Block(s, q, rows_of(x)) for s, q, x in self.ring.get()])
        rows, out = _ordered(batches, "epoch", "start_sample"), []
        for epoch, calibration, start, seq, x in zip(rows["epoch"], _calibration(rows), rows["start_sample"], rows["seq"], rows["samples"], strict=True):
            for w in a.add(int(epoch), calibration, Block(int(start), int(seq), rows_of(x))):
                out.append((key[0], w.epoch, w.window_id, w.decision_sample, w.decision_sample - SCANNED, w.decision_sample - CONTEXT, calibration, w.sequence_ids, a.discarded, w.samples.ravel()))
        self.at.update((a.epoch, a.calibration, a.next_decision, a.next_id, a.discarded, a.end))
        _put(self.ring, [(b.start, b.seq, b.samples.ravel().tolist()) for b in a.ring])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    def close(self) -> None:
        pass


def windows(blocks: DataFrame) -> DataFrame:
    """Full windows of a stream of blocks: session, epoch, start_sample, seq, samples (of any number of samples), and calibration if there is one.

    A calibration may change with an epoch only, and a gap within an epoch is an error, which stops the query. discarded: the
    samples at the ends of the session's earlier epochs that no window's step took.
    """
    return blocks.groupBy("session").transformWithStateInPandas(WindowProcessor(), WINDOWS, "append", "none")


_TRACKER = "n long, calibration string, " + ", ".join(f"{name} array<double>" for name in NoiseTracker.HELD)


class _TrackerState:
    """A noise tracker as a value of arrays and a list of closed sub-windows."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("tracker", _TRACKER)
        self.closed = handle.getListState("closed", "part array<double>, part2 array<double>")
        self.calibration: str | None = None

    def load(self) -> NoiseTracker:
        if not self.now.exists():
            return NoiseTracker()
        n, self.calibration, *arrays = self.now.get()
        return NoiseTracker.resumed(n, dict(zip(NoiseTracker.HELD, arrays, strict=True)), [(a, b) for a, b in self.closed.get()])

    def of(self, tracker: NoiseTracker, calibration: str | None) -> NoiseTracker:
        """The tracker to go on with: another calibration starts anew."""
        if tracker.n and calibration != self.calibration:
            tracker = NoiseTracker()
        self.calibration = calibration
        return tracker

    def save(self, t: NoiseTracker) -> None:
        self.now.update((t.n, self.calibration, *(x.tolist() for x in t.held().values())))
        _put(self.closed, [(a.ravel().tolist(), b.ravel().tolist()) for a, b in t.history])

    def seed(self, rows: pd.DataFrame) -> None:
        """From a row of operators.acoustics.tracker_states()."""
        for r in rows.to_dict("records"):
            self.now.update((int(r["n"]), None if pd.isna(r["calibration"]) else r["calibration"], *(np.asarray(r[name]).tolist() for name in NoiseTracker.HELD)))
            _put(self.closed, [(np.asarray(a).tolist(), np.asarray(b).tolist()) for a, b in zip(r["closed"], r["closed2"], strict=True)])


class PresenceProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracker = _TrackerState(handle)

    def handleInitialState(self, key: Any, initial: pd.DataFrame, timers: Any) -> None:
        self.tracker.seed(initial)

    def handleInputRows(self, key: Any, batches: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        tracker, rows, out = self.tracker.load(), _ordered(batches, "epoch", "end_sample"), []
        for epoch, end, calibration, x in zip(rows["epoch"], rows["end_sample"], _calibration(rows), rows["samples"], strict=True):
            tracker = self.tracker.of(tracker, calibration)
            out.append(presence_row(key[0], epoch, end, tracker(rows_of(x))))
        self.tracker.save(tracker)
        yield pd.DataFrame(out, columns=PRESENCE_COLUMNS)

    def close(self) -> None:
        pass


def presence(hops: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """As operators.acoustics.presence, over a stream of hops; initial: rows of tracker_states(), where a batch run of the same sessions ended."""
    seed = initial.groupBy("session") if initial is not None else None
    return hops.groupBy("session").transformWithStateInPandas(PresenceProcessor(), PRESENCE, "append", "none", seed)


DENOISED = "session long, epoch long, hop long, start_sample long, end_sample long, samples array<float>"


class DenoiseProcessor(StatefulProcessor):
    """Overlap-add is a hop late: the last hop, its frame and its tail wait for the next one."""

    def __init__(self, floor_db: float) -> None:
        self.floor_db = floor_db

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracker = _TrackerState(handle)
        self.held = handle.getValueState("held", "epoch long, hop long, start_sample long, end_sample long, before array<float>, ready array<float>, tail array<double>, gain array<double>")

    def handleInputRows(self, key: Any, batches: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        tracker, engine, at = self.tracker.load(), Denoiser(self.floor_db), None
        if self.held.exists():
            *at, before, ready, tail, gain = self.held.get()
            engine.resume(before, ready, tail, gain)
        rows, out = _ordered(batches, "epoch", "end_sample"), []
        for epoch, hop, start, end, calibration, x in zip(*(rows[c] for c in ("epoch", "hop", "start_sample", "end_sample")), _calibration(rows), rows["samples"], strict=True):
            if at is not None and epoch != at[0]:
                out.append((key[0], *at, engine.flush().ravel()))
            block, tracker = rows_of(x), self.tracker.of(tracker, calibration)
            ready = engine(block, tracker(block))
            if ready is not None:
                out.append((key[0], *at, ready.ravel()))
            at = [int(epoch), int(hop), int(start), int(end)]
        self.tracker.save(tracker)
        self.held.update((*at, *engine.held()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DENOISED.split(", ")])

    def close(self) -> None:
        pass


def denoised(hops: DataFrame, floor_db: float = -18.0) -> DataFrame:
    """As operators.acoustics.denoised, over a stream of hops; the last hop of all waits for one that follows, or for a new epoch."""
    return hops.groupBy("session").transformWithStateInPandas(DenoiseProcessor(floor_db), DENOISED, "append", "none")


class RecentIds(StatefulProcessor):
    """Ids by their number of insertion and numbers by id; beyond the last so many, the oldest is forgotten."""

    def __init__(self, last: int, id_col: str, order: str, kind: str, columns: list[str]) -> None:
        self.last, self.id_col, self.order, self.kind, self.columns = last, id_col, order, kind, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.number_of = handle.getMapState("number_of", f"id {self.kind}", "number long")
        self.id_at = handle.getMapState("id_at", "number long", f"id {self.kind}")
        self.next = handle.getValueState("next", "number long")

    def handleInputRows(self, key: Any, batches: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        rows = _ordered(batches, self.order)
        number, kept = self.next.get()[0] if self.next.exists() else 0, []
        for x in rows[self.id_col].tolist():
            new = not self.number_of.containsKey((x,))
            kept.append(new)
            if new:
                self.number_of.updateValue((x,), (number,))
                self.id_at.updateValue((number,), (x,))
                if number >= self.last:
                    oldest = self.id_at.getValue((number - self.last,))[0]
                    self.number_of.removeKey((oldest,))
                    self.id_at.removeKey((number - self.last,))
                number += 1
        self.next.update((number,))
        yield rows.loc[kept, self.columns]

    def close(self) -> None:
        pass


def recent_ids(events: DataFrame, key: str, order: str, id_col: str, last: int = 1024) -> DataFrame:
    """As operators.sequential.recent_ids, over a stream: the rows whose id is none of the key's last so many new ids."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    kind = events.schema[id_col].dataType.simpleString()
    return events.groupBy(key).transformWithStateInPandas(RecentIds(last, id_col, order, kind, events.columns), schema, "append", "none")


__all__ = ["denoised", "presence", "recent_ids", "use_state_store", "windows"]
