"""Sharding by a Feistel permutation with cycle walking, in DataFrame functions only.

Every row gets a global row number: rows are counted by content first, so that repeated rows are one entry with a count;
an entry lies in one of many hash buckets; its number is the bucket's offset, plus its place in the bucket. The
permutation works on numbers below rows x cols, the smallest near-square grid that holds them all: each round adds a
keyed hash of one coordinate to the other, which can be undone, so it is a bijection; a result outside the range is
permuted again until it falls inside (cycle walking). The permuted number mod the number of shards is the shard, and the
quotient is the slot: the law is "rows", counts differ by one at most. Any row's place can be computed from its number,
and reruns agree.

Only the table of bucket totals, of as many rows as there are buckets, is broadcast or meets in one task.

Defined cases: a null or empty text has size 1 and checksum 0; a very long one counts whole. Rows alike in id and text (ties)
take consecutive numbers, however many they are. Null ids are ids. An empty table gives no rows. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BUCKETS = 4096
RUN = 4096
ROUNDS = 6
#: At most rows - 1 numbers of the grid lie outside the range, so this many walks end surely for up to WALKS**2 rows; beyond, one walk goes on with odds of less than 1 / WALKS, and all of them with less than WALKS**-WALKS.
WALKS = 64


def feistel(x: str, rows: str, cols: str, seed: int, rounds: int = ROUNDS) -> str:
    """SQL for a permutation of 0 .. rows * cols - 1 at x; each argument is a SQL expression of bigints."""
    left, right = f"({x} div {cols})", f"({x} % {cols})"
    sql = "v"
    for r in range(rounds):
        to, by, size = ("l", "r", rows) if r % 2 == 0 else ("r", "l", cols)
        new = f"pmod(v.{to} + pmod(xxhash64({seed}L, {r}, v.{by}), {size}), {size})"
        l, rt = (new, "v.r") if to == "l" else ("v.l", new)
        sql = f"transform(array({sql}), v -> named_struct('l', {l}, 'r', {rt}))[0]"
    first = f"named_struct('l', {left}, 'r', {right})"
    return f"transform(transform(array({first}), v -> {sql}), v -> v.l * {cols} + v.r)[0]"


def permuted(df: DataFrame, number: str, total: str, seed: int, walks: int = WALKS) -> DataFrame:
    """df with place: its number, below total, under the permutation."""
    df = df.withColumn("_cols", F.ceil(F.sqrt(F.col(total).cast("double"))).cast("long"))
    df = df.withColumn("_rows", F.expr(f"({total} + _cols - 1) div _cols"))
    step = lambda x: feistel(x, "_rows", "_cols", seed)
    df = df.withColumn("place", F.expr(step(number)))
    again = f"aggregate(sequence(1, {walks}), place, (x, i) -> if(x < {total}, x, {step('x')}))"
    df = df.withColumn("place", F.expr(f"if(place < {total}, place, {again})"))
    out = F.when(F.col("place") < F.col(total), F.col("place")).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))
    return df.withColumn("place", out).drop("_cols", "_rows")


def numbered(entries: DataFrame, keys: list[str], count: str, seed: int, buckets: int = BUCKETS) -> DataFrame:
    """entries, distinct in keys, with first (the row number of the first of count rows) and total (the number of all rows)."""
    at = entries.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(buckets)).cast("int"))
    sums = at.groupBy("_b").agg(F.sum(count).alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    sums = sums.select("_b", F.sum("_n").over(everything.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.sum("_n").over(everything).alias("total"))
    inside = Window.partitionBy("_b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = at.withColumn("_in", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return placed.join(F.broadcast(sums), "_b").withColumn("first", F.coalesce("_before", F.lit(0)) + F.col("_in")).drop("_b", "_before", "_in")


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard. The text stays where it is read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    entries = light.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_rows_alike"))
    out = numbered(entries, ["doc_id", "size", "text_crc32"], "_rows_alike", seed)
    # an entry of very many rows alike is cut into runs first, which spread over tasks
    runs = out.where(f"_rows_alike > {RUN}").withColumn("_r", F.explode(F.expr(f"sequence(0L, (_rows_alike - 1) div {RUN})")))
    runs = runs.withColumn("_rows_alike", F.expr(f"least({RUN}, _rows_alike - _r * {RUN})")).withColumn("first", F.expr(f"first + _r * {RUN}")).repartition("_r", "first")
    out = out.where(f"_rows_alike <= {RUN}").unionByName(runs.drop("_r"))
    out = out.withColumn("number", F.explode(F.expr("sequence(first, first + _rows_alike - 1)")))
    out = permuted(out, "number", "total", seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.expr(f"cast(place % {shards} as int)").alias("shard"), F.expr(f"place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "number")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
