"""Operators whose every step needs the one before: one pass per stream, in order, in Arrow batches.

A stream is one key; streams are independent and spread over tasks. A task steps through its sorted rows batch by batch and
holds one state, so neither long streams nor many short ones cost more. The steps are those of kernels.recursions, which
the streaming wrappers use too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..kernels.recursions import RunningMinimum, queue_step, rate_step, sample_step
from ..model import RateConfig


def per_stream(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Callable, schema: str) -> DataFrame:
    """step(state, *values of inputs) -> (state, values of the new columns); the state of a stream begins as None. schema names the new columns."""
    new = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for rows in batches:
            out: list[list] = [[] for _ in new]
            named = zip(*([None if x != x else x for x in rows[k].tolist()] for k in keys), strict=True)
            for own, values in zip(named, zip(*(rows[c].tolist() for c in inputs), strict=True), strict=True):
                if own != key:
                    key, state = own, None
                state, made = step(state, *values)
                for column, x in zip(out, made, strict=True):
                    column.append(x)
            yield rows.assign(**dict(zip(new, out, strict=True)))

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{types}, {schema}")


def adaptive_rate(df: DataFrame, keys: list[str], order: list[str], queue_wait: str | None, slowest: str, cfg: RateConfig = RateConfig()) -> DataFrame:  # noqa: B008
    """Adds period_ms after each computed window."""

    def step(state, slow, wait=0.0):
        state = rate_step(state, wait, slow, cfg)
        return state, (state[0],)

    return per_stream(df, keys, order, [slowest, *([queue_wait] if queue_wait else [])], step, "period_ms long")


def bounded_queue(df: DataFrame, keys: list[str], order: list[str], arrivals: str, served: str, capacity: int = 100) -> DataFrame:
    """Adds depth and drops of a queue that drops its oldest entry when full."""

    def step(state, came, went):
        state = queue_step(state, int(came), int(went), capacity)
        return state, state

    return per_stream(df, keys, order, [arrivals, served], step, "depth long, drops long")


def sampled(df: DataFrame, keys: list[str], order: list[str], at: str, gap: int) -> DataFrame:
    """Only rows at least gap after the last one kept."""

    def step(anchor, now):
        anchor, kept = sample_step(anchor, int(now), gap)
        return anchor, (kept,)

    return per_stream(df, keys, order, [at], step, "_kept boolean").where("_kept").drop("_kept")


def recent_ids(df: DataFrame, keys: list[str], order: list[str], id_col: str, last: int = 1024) -> DataFrame:
    """Only rows whose id is none of the stream's last so many new ids: an id that was forgotten comes as new again."""

    def step(held, x):
        held = {} if held is None else held
        new = x not in held
        if new:
            held[x] = None
            if len(held) > last:
                del held[next(iter(held))]
        return held, (new,)

    return per_stream(df, keys, order, [id_col], step, "_new boolean").where("_new").drop("_new")


def tracked_minimum(df: DataFrame, keys: list[str], order: list[str], value: str, steps: int = 5, windows: int = 10) -> DataFrame:
    """Adds minimum: over the last windows of steps values each, as the noise tracker has it."""

    def step(state, x):
        state = state or RunningMinimum(steps, windows)
        return state, (state(x),)

    return per_stream(df, keys, order, [value], step, "minimum double")
