"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Targets: the sources share budget times all words by weight; a source over cap times its size stops there and its
excess is shared again by weight, until none is above. Blocks: a source's documents stand in the order of a seeded
hash, and its words, end to end, are cut into blocks of equal length (the last one may be shorter). Schedule: the sources
lay their slots end to end on a line of M cells; cell v is visited at place bitreverse(v), which is the van der Corput
order, so that every stretch of the schedule holds each source in about its share. Bit reversal undoes itself, so each
source computes the places of its own cells. The slots of a source, ranked by place, take its blocks in turn and start
over when all are taken. As a source gets at most cap times as many slots as blocks, no document is taken more often.

A hot source spreads over many tasks: word offsets are summed in hash buckets first and over the buckets then, slots are
made and ranked in chunks, and slots meet blocks on (source, block). Sources may be as many as documents: the table of sources
is put in order by range, and running sums add what its partitions hold. Only totals and hot sources are broadcast.

Defined cases: a null or empty text has no words; such rows take nothing. A very long text counts whole, and its blocks spread
like others. A null source is a source, the last one. Rows alike in all columns used (ties) are each mixed; so are rows with
null ids. Empty tables give no rows. Other columns, whatever their names, are not read, and mix_documents() returns them as they
are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, columns, fresh, join_keyed, saved, table

WEIGHTS = (5, 2, 1)
BUDGET, CAP = 1.5, 2.0
#: Words in a block at most; a source has this many blocks at least, as far as it has words.
BLOCK_WORDS, LEAST_BLOCKS = 1024, 256
CHUNK = 4096
BUCKETS = 1024


def in_order(df: DataFrame, part: str, *order: Column) -> DataFrame:
    """df in this order over partitions, whose numbers are in column part."""
    return saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))


def running(df: DataFrame, part: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df, made by in_order(), with the sums over all rows before a row. What meets in one task is a row per partition."""
    whole = df.groupBy(part).agg(*(F.sum(x).alias(k) for k, x in sums.items()))
    ahead = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(part, *(F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({k: F.coalesce(F.sum(x).over(inside), F.lit(0)) for k, x in sums.items()}).join(F.broadcast(whole), part)
    return df.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop(*(f"_{k}" for k in sums))


def _sources(rows: DataFrame, weights: tuple, budget: float, cap: float) -> DataFrame:
    """One row per source: s, source, no_source, rows, source_size, target, block (words), blocks, slots, before (slots of the sources ahead), m (log2 of the schedule's length)."""
    by_name = [F.col("no_source"), F.col("source")]
    src = rows.groupBy("source", "no_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    src = running(in_order(src, "_by_name", *by_name), "_by_name", by_name, {"s": F.lit(1)})
    src = src.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")).cast("double"))
    # with sources in order of size / weight, those that stop at their cap come first: level is what a unit of weight gets if all before are capped
    by_fill = [F.col("_fill"), F.col("s")]
    src = in_order(src.withColumn("_fill", F.col("source_size") / F.col("w")), "_by_fill", *by_fill)
    words, weight = (x or 0 for x in src.agg(F.sum("source_size"), F.sum("w")).first())
    filled = running(src, "_by_fill", by_fill, {"_words": F.col("source_size"), "_weight": F.col("w")})
    filled = filled.withColumn("_level", (F.lit(budget * words) - cap * F.col("_words")) / (F.lit(weight) - F.col("_weight")))
    free = filled.where(F.col("_level") * F.col("w") <= cap * F.col("source_size"))
    level = free.agg(F.min(F.struct("_fill", "s", "_level"))["_level"]).first()[0]
    full = cap * F.col("source_size")
    src = src.withColumn("target", full if level is None else F.least(full, F.lit(level) * F.col("w")))
    src = src.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.expr(f"source_size div {LEAST_BLOCKS}"))))
    src = src.withColumn("blocks", F.expr("(source_size + block - 1) div block"))
    whole = F.floor(F.col("target") / F.greatest(F.lit(1), F.col("source_size"))).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    slots = whole * F.col("blocks") + F.least(F.col("blocks"), F.round(rest / F.col("block")).cast("long"))
    src = src.withColumn("slots", F.least(slots, F.floor(F.lit(cap) * F.col("blocks")).cast("long")))
    total = src.agg(F.sum("slots")).first()[0] or 0
    src = running(src, "_by_name", [F.col("s")], {"before": F.col("slots")})
    return src.select("s", "source", "no_source", "rows", "source_size", "target", "block", "blocks", "slots", "before", F.lit(max(1, (max(2, total) - 1).bit_length())).alias("m"))


def schedule(src: DataFrame) -> DataFrame:
    """One row per slot: s, place (in the schedule), block_no."""
    chunks = src.where("slots > 0").select("s", "slots", "blocks", "before", "m", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")).alias("chunk"))
    chunks = chunks.repartition("s", "chunk")
    cells = chunks.select("s", "blocks", "m", F.explode(F.expr(f"sequence(before + chunk * {CHUNK}, before + least(slots, (chunk + 1) * {CHUNK}) - 1)")).alias("v"))
    for mask, by in ((0x5555555555555555, 1), (0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4), (0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16)):
        cells = cells.withColumn("v", F.expr(f"((shiftrightunsigned(v, {by})) & {mask}L) | shiftleft(v & {mask}L, {by})"))
    cells = cells.withColumn("place", F.expr("shiftrightunsigned(shiftrightunsigned(v, 32) | shiftleft(v, 32), 64 - m)")).drop("v", "m")
    cells = cells.withColumn("part", F.expr(f"place div {CHUNK}"))
    sums = cells.groupBy("s", "part").agg(F.count("*").alias("_n"))
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = cells.withColumn("_in", F.row_number().over(Window.partitionBy("s", "part").orderBy("place")) - 1).join(sums.hint("merge"), ["s", "part"])
    return ranked.select("s", "place", F.expr("(_ahead + _in) % blocks").alias("block_no"))


_SOURCE = ["source", "no_source"]


def placed(rows: DataFrame, src: DataFrame, seed: int) -> DataFrame:
    """Rows with words, each with the first of its words' numbers in its source's shuffled order."""
    rows = join_keyed(rows.where("size > 0"), src, _SOURCE, "rows")
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_b", F.expr(f"pmod(shiftright(_h, 32), {BUCKETS})"))
    sums = rows.groupBy("s", "_b").agg(F.sum("size").alias("_n"))
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy("s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy("s", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["s", "_b"]).withColumn("start", F.col("_ahead") + F.col("_in"))
    return saved(at.select("s", "start", "doc_id", "size", "source_size", "target", "block"))


def prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, budget: float, cap: float) -> tuple[DataFrame, DataFrame]:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(source, F.lit("")).alias("source"), source.isNull().alias("no_source"), size.alias("size")))
    return rows, saved(_sources(rows, weights, budget, cap))


def mixed(at: DataFrame, src: DataFrame) -> DataFrame:
    """The mix: s, place, doc_id, start (names the row in its source), word_from and word_to within the document, in any order; orderBy("place", "start") is the mix's own. at: of placed()."""
    parts = at.withColumn("block_no", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)")))
    parts = parts.withColumn("word_from", F.expr("greatest(0, block_no * block - start)")).withColumn("word_to", F.expr("least(size, (block_no + 1) * block - start)"))
    # the planner takes what explode() makes for as small as its input, so joins on slots say that they must not broadcast
    return schedule(src).join(parts.select("s", "block_no", "doc_id", "start", "word_from", "word_to").hint("merge"), ["s", "block_no"])


def mix_counts(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken."""
    rows, src = prepared(docs, id_col, text_col, source_col, weights, budget, cap)
    at = placed(rows, src, seed)
    took = mixed(at, src).groupBy("s", "start").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    taken = at.join(took, ["s", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    empty = join_keyed(rows.where("size = 0"), src, _SOURCE, "rows").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty)


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with whole rows repeated: a row comes as often as the schedule takes the block that its first word is in. doc_id names a row."""
    i, times = fresh("i", "times")
    rows, src = prepared(docs, id_col, text_col, source_col, weights, budget, cap)
    starts = placed(rows, src, seed).select("s", "doc_id", F.expr("start div block").alias("block_no"))
    slots = schedule(src).groupBy("s", "block_no").agg(F.count("*").cast("int").alias(times))
    took = starts.join(slots.hint("merge"), ["s", "block_no"]).groupBy(F.col("doc_id").alias(i)).agg(F.max(times).alias(times))
    return docs.join(took, docs[id_col].eqNullSafe(took[i])).withColumn(times, F.explode(F.expr(f"sequence(1, {times})"))).select(*columns(docs))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))
