"""Gate, counts, scan orders, directions and reuse as expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import circular_distance, greedy_circular, is_open, signed_delta
from ..model import GATE_THRESHOLD


#: Why a gate is what it is.
GATE_REASONS = {
    "invalid": "current_probability_identity_or_interval_mismatch",
    "unavailable": "requires_current_aligned_20ms_probability",
    "warming_up": "current_probability_warming_up",
    "open": "current_probability_at_or_above_threshold",
    "closed": "current_probability_below_threshold",
}


def gate(df: DataFrame, p: str, state: str, threshold: float | str = GATE_THRESHOLD, matches: Column | None = None) -> DataFrame:
    """Adds gate (open, closed, or the state that blocks it), sound_present and gate_reason. matches: whether the probability is of this session, epoch and interval; the gate is invalid where it is not."""
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    kind = F.when(F.col(state) != "ready", F.col(state)).when(F.col(p).isNull(), "unavailable").when(F.col(p) >= limit, "open").otherwise("closed")
    if matches is not None:
        kind = F.when(~F.coalesce(matches, F.lit(False)), "invalid").otherwise(kind)
    reason = F.element_at(F.create_map(*(F.lit(x) for pair in GATE_REASONS.items() for x in pair)), F.col("gate"))
    return df.withColumn("gate", kind).withColumns({"sound_present": F.col("gate") == "open", "gate_reason": reason})


def open_run(df: DataFrame, session: list[str], order: str, is_on: Column, to: str = "k", step: int | None = None) -> DataFrame:
    """Place of each open row in its run of consecutive open rows; 0 when not open. step: rows further apart than this in order are not consecutive."""
    w = Window.partitionBy(*session).orderBy(order)
    df = df.withColumn("_on", F.coalesce(is_on, F.lit(False)))
    begins = ~F.col("_on") if step is None else ~F.col("_on") | F.coalesce(F.col(order) - F.lag(order).over(w) != step, F.lit(False))
    df = df.withColumn("_i", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*session, "_i", "_on").orderBy(order))
    return df.withColumn(to, F.when(F.col("_on"), place).otherwise(0).cast("long")).drop("_on", "_i")


def frames_in_use(k: str = "k", first: int = 15, most: int = 19) -> Column:
    return F.when(F.col(k) > 0, F.least(F.lit(most), first + 2 * (F.col(k) - 1))).otherwise(0).cast("long")


def vote(df: DataFrame, session: list[str], order: str, raw: str, step: int | None = None) -> DataFrame:
    """Adds stable: the value that two of the last three agree on, else the last such value. step: a gap wider than this in order forgets what came before."""
    w = Window.partitionBy(*session).orderBy(order)
    keys = list(session)
    if step is not None:
        gap = F.coalesce(F.col(order) - F.lag(order).over(w) > step, F.lit(False))
        df = df.withColumn("_gap", gap).withColumn("_run", F.sum(F.col("_gap").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        keys, w = [*keys, "_run"], Window.partitionBy(*session, "_run").orderBy(order)
    r0, r1, r2 = F.col(raw), F.lag(raw, 1).over(w), F.lag(raw, 2).over(w)
    df = df.withColumn("_v", F.when((r0 == r1) | (r0 == r2), r0).when(r1 == r2, r1))
    return df.withColumn("stable", F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_v", "_gap", "_run")


def order_plan(gate_open: Column, enabled: Column, follow: Column, count: Column, fault: Column) -> Column:
    """Sources that the scan assumes; null when it does not run."""
    return F.when(~gate_open, None).when(~enabled | ~follow, 2).when(fault, 1).when(count >= 2, 2).otherwise(1).cast("long")


def select_directions(df: DataFrame, keys: list[str], theta: str, priority: list[Column], limit: int = 3, separation: float = 50.0, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per key the greedy choice of directions at least separation apart, in order of priority; and how many there were."""
    ordered = F.array_sort(F.collect_list(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(priority)), F.col(theta).alias("theta"), *extra)))
    grouped = df.groupBy(*keys).agg(ordered.alias("_c"))
    return grouped.select(*keys, F.size("_c").cast("long").alias("eligible"), greedy_circular("_c", limit, separation).alias("chosen"))


def associations(tracks: DataFrame, candidates: DataFrame, keys: list[str], variance: float = 25.0, gate_deg: float = 50.0, chi2: float = 20.0) -> DataFrame:
    """Pairs of track and candidate of the same window within the gate, with the likelihood."""
    j = tracks.join(candidates, keys).withColumn("innovation", signed_delta("theta", "track_theta"))
    inside = (F.abs("innovation") <= gate_deg) & (F.col("innovation") * F.col("innovation") / variance <= chi2)
    return j.where(inside).withColumn("likelihood", F.exp(-0.5 * F.col("innovation") * F.col("innovation") / variance))


def alive(now: str, seen: str, confirmed: Column, tentative_ttl: int = 24_000, coasting_ttl: int = 96_000) -> Column:
    return F.col(now) - F.col(seen) < F.when(confirmed, coasting_ttl).otherwise(tentative_ttl)


def hold_last(df: DataFrame, session: list[str], order: str, computed: Column, columns: list[str]) -> DataFrame:
    """Adds last_<column>: of the last computed row; and state: confirmed there, coasting after it, null before any."""
    w = Window.partitionBy(*session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(computed, F.struct(*columns)), ignorenulls=True).over(w)
    df = df.withColumn("_h", held)
    state = F.when(F.col("_h").isNull(), None).when(computed, "confirmed").otherwise("coasting")
    return df.withColumn("state", state).withColumns({f"last_{c}": F.col(f"_h.{c}") for c in columns}).drop("_h")


def latest_before(df: DataFrame, session: list[str], order: list[str], is_source: Column, columns: list[str], prefix: str = "asof_") -> DataFrame:
    """As-of join of a stream with rows of its own: the latest source row not after each row."""
    w = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(is_source, F.struct(*columns)), ignorenulls=True).over(w)
    return df.withColumn("_h", held).withColumns({f"{prefix}{c}": F.col(f"_h.{c}") for c in columns}).drop("_h")


def side_input(df: DataFrame, session: list[str], order: list[str], is_source: Column, columns: list[str], required: bool = False, prefix: str = "asof_") -> DataFrame:
    """latest_before() with degraded: no source row yet. required: that is an error."""
    out = latest_before(df, session, order, is_source, [*columns, order[-1]], prefix)
    missing = F.col(f"{prefix}{order[-1]}").isNull()
    if required:
        missing = F.when(missing, F.raise_error(F.lit("the side input is required and missing")).cast("boolean")).otherwise(False)
    return out.withColumn("degraded", missing).drop(*([f"{prefix}{order[-1]}"] if order[-1] not in columns else []))


def mailbox(df: DataFrame, session: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The latest row of each session."""
    return df.groupBy(*session).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*session, "_r.*")


def nearest_within(theta: str, clicked: str, reach: float = 8.0) -> Column:
    return circular_distance(theta, clicked) <= reach


__all__ = ["alive", "associations", "frames_in_use", "gate", "hold_last", "is_open", "latest_before", "mailbox", "nearest_within", "open_run", "order_plan", "select_directions", "side_input", "vote"]
