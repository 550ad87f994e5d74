"""Recurrences without a walk over whole streams.

affine(): a first-order recursion is a chain of affine maps, and these compose. Each chunk of a stream folds its maps into one; the
chunks' maps are scanned by doubling, in as many steps as their number has bits; a second pass starts each chunk from its own
value. So a stream of any length spreads over tasks, chunk by chunk.

anchors(): the greedy choice of rows that lie a gap apart. Each row has a successor, the first one a gap later, found within
slots of a gap's length; doubling the successors reaches all anchors from a stream's first row, again in as many rounds as their
number has bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .sequential import per_stream

CHUNK = 4096


def _bits(n: int | None) -> int:
    return math.ceil(math.log2(n)) if n and n > 1 else 0


def _meet(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """The join on pairs of columns, of which null is a value like any other; of right, the columns it is joined on go."""
    names = {c: f"_r_{c}" for _, c in on}
    right = right.withColumnsRenamed(names)
    out = left.join(right, [F.col(x).eqNullSafe(F.col(names[y])) for x, y in on], how)
    return out if how == "left_semi" else out.drop(*names.values())


def affine(df: DataFrame, keys: list[str], place: str, a: Column, b: Column, start: Column, to: str, chunk: int = CHUNK) -> DataFrame:
    """Adds to: a stream's first row has start, each later one a times the last value plus b. place: a whole number that orders a stream. A row whose b is null keeps the last value."""
    own = [*keys, "_chunk"]
    df = df.withColumns({"_chunk": F.floor(F.col(place) / chunk), "_b": b.cast("double"), "_x": start.cast("double")})
    df = df.withColumn("_a", F.when(F.col("_b").isNull(), 1.0).otherwise(a.cast("double"))).withColumn("_b", F.coalesce("_b", F.lit(0.0)))
    df = df.repartition(*own)
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("x"))
    fold = lambda m, r: F.struct((r["_a"] * m["a"]).alias("a"), (r["_a"] * m["b"] + r["_b"]).alias("b"), F.coalesce(r["_a"] * m["x"] + r["_b"], r["_x"]).alias("x"))
    maps = df.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct(place, "_a", "_b", "_x"))).alias("_r")).select(*own, F.aggregate("_r", none, fold).alias("_m"))
    order = Window.partitionBy(*keys).orderBy("_chunk")
    first = F.row_number().over(order) == 1
    maps = maps.select(*own, F.when(first, 0.0).otherwise(F.col("_m.a")).alias("_ma"), F.when(first, F.col("_m.x")).otherwise(F.col("_m.b")).alias("_mb"))
    for step in range(_bits(df.agg(F.max("_chunk") - F.min("_chunk") + 1).first()[0])):
        before = lambda c, other, n=2**step: F.lag(c, n, other).over(order)
        maps = maps.select(*own, (F.col("_ma") * before("_ma", 1.0)).alias("_ma"), (F.col("_ma") * before("_mb", 0.0) + F.col("_mb")).alias("_mb"))
    maps = maps.select(*own, F.lag("_mb").over(order).alias("_s"))
    df = _meet(df, maps, [(c, c) for c in own])

    def step(state, x, y, first_value, entry):
        held = entry if state is None else state[0]
        value = first_value if held is None or held != held else x * held + y
        return (value,), (value,)

    return per_stream(df, own, [place], ["_a", "_b", "_x", "_s"], step, f"{to} double").drop("_chunk", "_a", "_b", "_x", "_s")


def smoothed(df: DataFrame, keys: list[str], place: str, value: str, keep: float, to: str = "smoothed", chunk: int = CHUNK) -> DataFrame:
    """First-order smoothing: keep times the last value, the rest from the new one."""
    return affine(df, keys, place, F.lit(keep), (1 - keep) * F.col(value), F.col(value), to, chunk)


def successors(points: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """points (keys, at; distinct) with next: the first point at least gap later, or null.

    In slots of a gap's length it lies in the slot after a point's own, or else it is the first point of a later slot. So a slot
    is a group of its own, and only one row a slot is put in order over a whole stream.
    """
    points = points.withColumn("_slot", F.floor(F.col(at) / gap))
    ask = points.select(*keys, (F.col("_slot") + 1).alias("_slot"), (F.col(at) + gap).alias("_k"), F.col(at).alias("_x"))
    both = ask.unionByName(points.select(*keys, "_slot", F.col(at).alias("_k"), F.lit(None).cast("long").alias("_x")))
    # from late to early: a point comes before those who ask at its own time
    down = Window.partitionBy(*keys, "_slot").orderBy(F.desc("_k"), F.col("_x").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_here", F.last(F.when(F.col("_x").isNull(), F.col("_k")), ignorenulls=True).over(down)).where("_x is not null")
    order = Window.partitionBy(*keys).orderBy("_slot")
    beside = F.lead("_slot").over(order) == F.col("_slot") + 1
    slots = points.groupBy(*keys, "_slot").agg(F.min(at).alias("_first"))
    slots = slots.select(*keys, F.col("_slot").alias("_own"), F.when(beside, F.lead("_first", 2).over(order)).otherwise(F.lead("_first").over(order)).alias("_later"))
    found = _meet(here.withColumn("_own", F.col("_slot") - 1), slots, [*((k, k) for k in keys), ("_own", "_own")])
    return found.select(*keys, F.col("_x").alias(at), F.coalesce("_here", "_later").alias("next"))


def anchors(df: DataFrame, keys: list[str], at: str, gap: int, ties: list[str] | None = None) -> DataFrame:
    """Only rows at least gap after the last one kept, from each stream's first row on; of rows at one time the first by ties. Rows without a time go."""
    df = df.where(F.col(at).isNotNull())
    points = df.select(*keys, F.col(at).cast("long").alias(at)).distinct()
    jump = written(successors(points, keys, at, gap).where("next is not null"))
    reached = written(points.groupBy(*keys).agg(F.min(at).alias(at)))
    slots = points.groupBy(*keys).agg(F.count_distinct(F.floor(F.col(at) / gap)).alias("n"))  # each has one anchor at most
    pairs = [(k, k) for k in keys]
    for _ in range(_bits(slots.agg(F.max("n")).first()[0])):
        reached = written(reached.unionByName(_meet(reached, jump, [*pairs, (at, at)]).select(*keys, F.col("next").alias(at))))
        jump = written(_meet(jump, jump.withColumnRenamed("next", "_next"), [*pairs, ("next", at)]).select(*keys, at, F.col("_next").alias("next")))
    first = F.row_number().over(Window.partitionBy(*keys, at).orderBy(*(ties or [at])))
    return _meet(df.withColumn("_n", first).where("_n = 1").drop("_n"), reached, [*pairs, (at, at)], "left_semi")
