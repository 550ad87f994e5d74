"""Windows that are not computed: when they must be, what they may show instead, and what a fault shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decisions import alive

REUSED, PERIOD = ":adaptive_reuse_previous_output", "reused_at_period_ms="


def forced(df: DataFrame, session: list[str], order: str, control: list[str]) -> DataFrame:
    """Adds force: the first window, and every one whose control values differ from those of the window before."""
    key = F.struct(*control)
    before = F.lag(key).over(Window.partitionBy(*session).orderBy(order))
    return df.withColumn("force", before.isNull() | ~key.eqNullSafe(before))


def may_reuse(computed: Column, has_last: Column, is_open: Column, order: Column, last_order: Column) -> Column:
    """An open gate reuses only a spectrum of its own order, or none; a closed one needs no spectrum."""
    fits = order.isin(1, 2, 3) & (last_order.isNull() | (last_order == order))
    return ~computed & has_last & (~is_open | F.coalesce(fits, F.lit(False)))


def held_tracks(df: DataFrame, session: list[str], order: str, computed: Column, tracks: str) -> DataFrame:
    """Adds held: the array of tracks of the last computed window."""
    w = Window.partitionBy(*session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("held", F.last(F.when(computed, F.col(tracks)), ignorenulls=True).over(w))


def retimed(df: DataFrame, now: str, tracks: str = "held") -> DataFrame:
    """The tracks of an earlier window as they are at this one.

    Those past their time to live go. Of the others confirmed ones coast; nothing is measured, observed or new; missed counts on.
    tracks: an array of structs with state, measured_theta, last_observed, is_observed, is_new and missed, among others.
    """
    fields = df.schema[tracks].dataType.elementType.names

    def moved(x: Column) -> Column:
        new = {
            "state": F.when(x["state"] == "confirmed", "coasting").otherwise(x["state"]),
            "measured_theta": F.lit(None).cast("double"),
            "is_observed": F.lit(False),
            "is_new": F.lit(False),
            "missed": F.greatest(F.lit(0), F.col(now) - x["last_observed"]),
        }
        return F.struct(*(new.get(f, x[f]).alias(f) for f in fields))

    def lives(x: Column) -> Column:
        return F.col(now) - x["last_observed"] < F.when(x["state"] == "tentative", 24_000).otherwise(96_000)

    return df.withColumn(tracks, F.transform(F.filter(tracks, lives), moved))


def reuse_marks(df: DataFrame, reason: str, diagnostics: str, period_ms: str) -> DataFrame:
    """The gate's reason with the mark of reuse once, and one diagnostic of the period."""
    kept = F.filter(diagnostics, lambda x: ~x.startswith(PERIOD))
    note = F.concat(F.lit(PERIOD), F.col(period_ms).cast("string"))
    return df.withColumns({reason: F.concat(F.substring_index(reason, REUSED, 1), F.lit(REUSED)), diagnostics: F.concat(kept, F.array(note))})


def fault_rows(df: DataFrame, error: str) -> DataFrame:
    """What a window shows whose processing failed: no directions, and a gate that is unavailable."""
    return df.withColumns(
        {
            "gate": F.lit("unavailable"),
            "backend": F.lit("adaptive_fault_fallback_v1"),
            "gate_reason": F.lit("l2_processing_fault"),
            "sound_present": F.lit(False),
            "diagnostics": F.array(F.col(error)),
            "missing_reason": F.concat(F.lit("adaptive_fault:"), F.col(error)),
            "reused": F.lit(True),
        }
    )


__all__ = ["alive", "fault_rows", "forced", "held_tracks", "may_reuse", "retimed", "reuse_marks"]
