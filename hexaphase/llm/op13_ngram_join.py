"""N-gram Jaccard join: documents whose sets of four-word shingles have a similarity of 0.85 or more, by filters over several orders.

Two sets that similar share a token (a hashed shingle) among the first p = n - ceil(0.85 n) + 1 of each, whatever the global order
of tokens; and among the first p - 1 + l of each they share l. No filter loses a link, so a pair must pass all of them:

- Order 1 has a quarter of all tokens, chosen by their hashes, first, the rarest before the others; then the rest by hash. Only that
  quarter is counted over the corpus. A token of one set only can't be shared: a set whose first p tokens are all of that kind has no
  partner, and is done.
- Order 2 has all tokens of the sets that are left, the rarest first, and finds candidates. Passages that many documents share stand
  last and make none. In the cell of a pair's first common token, no token before it is common, which must leave enough.
- Orders 3 and 4 are permutations of the hashes. Candidates must share min(p) tokens among the first 2 p - 1 of each.
- What passes is verified on the whole sets.

Equal sets are one class and never meet as pairs. The classes that share a token of order 2's prefix are a cell. In a round each
cell names leaders, by a minimum that combines before the shuffle, and its classes are held against these; leaders then leave, and
so does a cell whose classes are connected by what was found. Each round names more leaders, until no cell is left: every pair of
a cell was either compared or is connected; cells of few pairs are finished at once. So a group of copies costs about its size, and none is left out.

Tokens that very many documents hold, as a bounded sample tells, are dealt by a salt, and the sample tells how rare they are: any
order of tokens gives the same result.

Defined cases: a null or empty text, or one of white space, has an empty set and links with nothing, not even with its like; its
component is its own doc_id. With one to three words the whole sequence is the shingle. Very long texts are hashed whole. Ties in
size or rarity go by hash. Repeated rows are each reported and are copies of each other. Null doc_ids are reported and count as
the largest. An empty table gives no rows. Other columns, whatever their names, are not read. Sets are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, RangeHash, arrow_batches, join_keyed, mix, saved, table, word_bounds
from .op5_simhash import components

SHINGLE, PERCENT = 4, 85
#: Tokens below this come first in order 1 and are counted: a quarter of all.
COUNTED = 1 << 62
#: Tokens that make up more than HOT_ROWS in SAMPLED_ROWS of all are hot: their postings are dealt over SALTS groups.
SAMPLED_ROWS, HOT_ROWS = 1_000_000, 64
SALTS = 1024
#: So many ids are broadcast at most; more join by a shuffle.
BROADCAST_IDS = 1_000_000
#: Leaders of a cell in the first round, and how many times more in each later one.
LEADERS, MORE = 8, 4
#: Components of a cell's classes are summed up in so many buckets.
BUCKETS = 8
#: Cells whose pairs are this many or fewer in all are finished at once.
AT_ONCE = 4e6
_FACTORS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; none without words."""
    buf = np.frombuffer(text.translate(LOWER), np.uint8)
    start, end = word_bounds(buf)
    if not len(start):
        return np.zeros(0, np.uint64)
    word = RangeHash(buf)(start, end)
    width = min(SHINGLE, len(word))
    h = np.full(len(word) - width + 1, np.uint64(width))
    for k in range(width):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + word[k : len(h) + k] + np.uint64(k))
    return np.unique(h)


def prefix_size(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def _class_of(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), 42)


def first_order(h: np.ndarray) -> np.ndarray:
    """The tokens of a set that order 1's prefix is made of: all counted ones, and the least others if these are too few."""
    n = int(np.searchsorted(h, np.uint64(COUNTED)))
    return h[: max(n, prefix_size(len(h)))] if len(h) else h


def later_orders(h: np.ndarray) -> bytes:
    """The first 2 p - 1 tokens under each of the later orders, by the upper halves of their hashes there, ascending."""
    k = 2 * prefix_size(len(h)) - 1
    ranks = [mix(h * np.uint64(f)) for f in _FACTORS]
    return b"".join(np.sort((r if k >= len(r) else np.partition(r, k)[:k]) >> np.uint64(32)).astype(np.uint32).tobytes() for r in ranks)


def share(x: bytes, y: bytes, size_x: int, size_y: int) -> bool:
    """Whether two sets share enough of their prefixes under each later order."""
    a, b = (np.frombuffer(v, np.uint32).reshape(len(_FACTORS), -1) for v in (x, y))
    least = min(prefix_size(size_x), prefix_size(size_y))
    for u, v in zip(a, b, strict=True):
        own, other = np.unique(u), np.unique(v)
        alike = len(u) - len(own) + len(v) - len(other)  # different tokens may be alike in half their hashes
        if len(np.intersect1d(own, other, assume_unique=True)) < least - alike:
            return False
    return True


def similar(x: np.ndarray, y: np.ndarray, size_x: int, size_y: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (size_x + size_y - common)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    at = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in sets], dtype=np.int64)]), pa.int32())
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def embedded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the class), size, tokens (of first_order): one row per row of docs."""
    rows = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py() or b"") for t in batch.column(1)]
            fps = np.array([_class_of(h) for h in sets], np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array(fps), pa.array([len(h) for h in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, _lists([first_order(h) for h in sets])], names=["doc_id", "fp", "size", "tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, size int, tokens array<long>")


def _postings(rows: DataFrame) -> DataFrame:
    """token, fp: of each class once. Only rows of repeated classes move for that."""
    rows = rows.where("size > 0").select("fp", "tokens")
    repeated = saved(rows.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
    once = rows.join(repeated, "fp", "left_anti").unionByName(rows.join(repeated, "fp", "left_semi").dropDuplicates(["fp"]))
    return once.select("fp", F.explode("tokens").alias("token"))


def _shared(postings: DataFrame, total: int) -> DataFrame:
    """fp, token, n of the postings (token, fp) whose token several classes hold: n is how many, or, of hot tokens, what the sample tells, which orders them as well."""
    share = min(1.0, SAMPLED_ROWS / max(total, 1))
    hot = postings.select("token").sample(share, 7).groupBy("token").count().where(f"count > {HOT_ROWS}")
    hot = saved(hot.select("token", F.ceil(F.col("count") / share).alias("many")))  # SAMPLED_ROWS / HOT_ROWS at most
    salt = F.when(F.col("many").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.lit(SALTS))).alias("salt")
    dealt = postings.join(F.broadcast(hot), "token", "left").select("token", "fp", "many", salt).repartition("token", "salt")
    n = F.coalesce("many", F.expr("count(*) over (partition by token, salt)"))
    return dealt.withColumn("n", n).where("n > 1").select("fp", "token", "n")


_PREFIX = f"size - ({PERCENT} * size + 99) div 100 + 1"
_COUNTED = f"(token >= 0 and token < {COUNTED}L)"


def _alive(rows: DataFrame) -> DataFrame:
    """fp of the classes that share a token of the prefix, as far as the counted quarter of all tokens tells: no other class has a partner."""
    classes = rows.where("size > 0").select("fp", "size", F.expr(f"size(filter(tokens, token -> {_COUNTED}))").alias("counted")).dropDuplicates(["fp"])
    met = _shared(_postings(rows), rows.agg(F.sum(F.size("tokens"))).first()[0] or 0).withColumn("first", F.expr(_COUNTED))
    met = met.join(classes.hint("merge"), "fp")
    met = met.withColumn("shared", F.expr("count_if(first) over (partition by fp)")).withColumn("place", F.expr("row_number() over (partition by fp order by not first, n, token)"))
    return met.where(f"not first or counted - shared + place <= {_PREFIX}").select("fp").distinct()


def _cells(sets: DataFrame) -> DataFrame:
    """s (a token), fp, size, lone, c: each class in the cells of its prefix, now by the rarity of all tokens among the classes that are left. lone: how many of its tokens come before s. c: the class's component, itself so far.

    A similar pair is found in the cell of its first common token. There, none of the tokens before it is common, which bounds how
    similar the two can be: a class leaves a cell in which no other one could be its partner.
    """
    met = _shared(sets.select("fp", F.explode("tokens").alias("token")), sets.agg(F.sum("size")).first()[0] or 0)
    met = met.join(sets.select("fp", "size").hint("merge"), "fp")
    met = met.withColumn("lone", F.expr("size - cast(count(*) over (partition by fp) as int)")).withColumn("place", F.expr("row_number() over (partition by fp order by n, token)"))
    cells = saved(met.where(f"lone + place <= {_PREFIX}").select(F.col("token").alias("s"), "fp", "size", F.expr("lone + place - 1").alias("lone")))
    return cells.withColumn("c", F.col("fp"))


def _fitting(open_: DataFrame) -> DataFrame:
    """The rows of open_ whose class can still have a partner in its cell: one of another component, by sizes and places.

    For that, a cell's classes are summed up by size and BUCKETS of components: the fewest tokens before s, whose that is, and
    whether the bucket has other components too, which then may all be partners.
    """
    bucket = F.pmod(F.xxhash64("c"), F.lit(BUCKETS)).alias("j")
    summed = open_.groupBy("s", "size", bucket).agg(F.min(F.struct("lone", "c")).alias("m"), (F.min("c") != F.max("c")).alias("mixed"), F.count("*").alias("n"))
    summed = summed.groupBy("s").agg(F.collect_list(F.struct("size", "m.lone", "m.c", "mixed")).alias("others"), F.sum("n").alias("rows")).where("rows > 1")
    other = lambda y: ((y["c"] != F.col("c")) | y["mixed"]) & _may_link(F.col("size"), F.col("lone"), y["size"], y["lone"])
    return join_keyed(open_, saved(summed), ["s"], "rows").where(F.exists("others", other)).drop("others")


def _may_link(size_x: Column, lone_x: Column, size_y: Column, lone_y: Column) -> Column:
    """Whether sets can be similar by their sizes and by how many tokens of each the other does not have."""
    most = F.least(size_x - lone_x, size_y - lone_y)
    return 100 * most >= PERCENT * (size_x + size_y - most)


def _sets(docs: DataFrame, rows: DataFrame, fps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """fp, size, orders, tokens (the whole set) of the classes fps, from the text of one document each."""
    wanted = saved(rows.where("size > 0").join(fps, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("id")))
    texts, ids = _texts(docs, id_col, text_col), wanted.select("id")
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(F.col("id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [h for t in batch.column(0) if len(h := shingles(t.as_py() or b""))]
            fps_ = np.array([_class_of(h) for h in sets], np.uint64).view(np.int64)
            columns = [pa.array(fps_), pa.array([len(h) for h in sets], pa.int32()), pa.array([later_orders(h) for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, _lists(sets)], names=["fp", "size", "orders", "tokens"])

    found = texts.mapInArrow(run, "fp long, size int, orders binary, tokens array<long>").join(wanted.select("fp"), "fp", "left_semi")
    return saved(found.dropDuplicates(["fp"]))


def _passing(pairs: DataFrame, sets: DataFrame, name: str, test) -> DataFrame:
    """The pairs (a, b, size_a, size_b) whose values in column name of sets pass the test."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col(name).alias("x")).hint("merge"), "a")
    both = both.join(sets.select(F.col("fp").alias("b"), F.col(name).alias("y")).hint("merge"), "b").select("a", "b", "size_a", "size_b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            value = (lambda v: v.values.to_numpy()) if pa.types.is_list(batch.schema.field(4).type) else (lambda v: v.as_py())
            keep = [test(value(x), value(y), m, n) for x, y, (m, n) in zip(batch.column(4), batch.column(5), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "size_a", "size_b"]).filter(pa.array(keep, pa.bool_()))

    return saved(both.mapInArrow(run, "a long, b long, size_a int, size_b int"))


def _led(open_: DataFrame, number: int, leaders: int) -> DataFrame:
    """s, rows, led: up to so many classes of each cell that is not yet connected, those with the fewest tokens before s first: copies meet their original. The same classes lead in most of a group's cells. In odd rounds they are of different components, so that the few that are left over lead."""
    order = F.xxhash64(F.lit(number), "fp")
    bucket = F.pmod(F.xxhash64(F.lit(number), "c" if number % 2 else "fp"), F.lit(leaders)).alias("j")
    led = open_.groupBy("s", bucket).agg(F.min(F.struct("lone", order.alias("o"), "fp", "size", "c")).alias("l"), F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))
    led = led.groupBy("s").agg(F.collect_list("l").alias("led"), F.sum("n").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))
    return led.where("least < most").drop("least", "most")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs (fp, size, l.fp, l.size) that the later orders let pass and whose sets are similar."""
    ends = [f"if(fp < l.fp, {x}, {y})" for x, y in (("fp", "l.fp"), ("l.fp", "fp"), ("size", "l.size"), ("l.size", "size"))]
    pairs = saved(pairs.select(*(F.expr(e).alias(n) for e, n in zip(ends, ("a", "b", "size_a", "size_b"), strict=True))).distinct())
    for name, test in (("orders", share), ("tokens", similar)):
        pairs = _passing(pairs, sets, name, test)
    return pairs.select("a", "b")


def links(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b: similar classes; those that are similar are connected by them, directly or through others. rows: of embedded()."""
    sets = _sets(docs, rows, saved(_alive(rows)), id_col, text_col)
    open_, found = _cells(sets), rows.sparkSession.createDataFrame([], "a long, b long")
    leaders, number = LEADERS, 0
    linkable = lambda l: (l["c"] != F.col("c")) & _may_link(F.col("size"), F.col("lone"), l["size"], l["lone"])
    while True:
        open_ = saved(_fitting(open_))
        led = saved(_led(open_, number, leaders))
        left = led.agg(F.sum(F.col("rows").cast("double") * F.col("rows"))).first()[0]
        if left is None:
            return found
        if left <= AT_ONCE:  # what is left of the cells is small: each pair is looked at
            others = open_.select("s", F.struct("fp", "size", "lone", "c").alias("l"))
            pairs = open_.hint("merge").join(others.hint("merge"), "s").where(linkable(F.col("l"))).where("fp < l.fp")
            return found.unionByName(_verified(pairs, sets))
        met = saved(join_keyed(open_, led, ["s"], "rows"))
        roots = saved(components(found.unionByName(_verified(met.select("fp", "size", "lone", "c", F.explode(F.filter("led", linkable)).alias("l")), sets))))
        found = roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        rest = met.where("not exists(led, l -> l.fp = fp)").select("s", "fp", "size", "lone")
        open_ = rest.join(roots, rest["fp"] == roots["node"], "left").select("s", "fp", "size", "lone", F.coalesce("root", "fp").alias("c"))
        leaders, number = leaders * MORE, number + 1


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    with arrow_batches(docs.sparkSession):
        rows = saved(embedded(docs, id_col, text_col))
        edges = saved(links(docs, rows, id_col, text_col))
    roots = saved(components(edges))
    classes = saved(rows.where("size > 0").groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")))
    linked = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "root", "id")
    linked = linked.join(linked.groupBy("root").agg(F.min("id").alias("least")), "root").select("fp", "least")
    named = saved(classes.join(linked, "fp", "left").select("fp", F.coalesce("least", "id").alias("component_id"), "rows"))
    full = join_keyed(rows.where("size > 0").select("doc_id", "fp", "size"), named, ["fp"], "rows").select("doc_id", "size", "component_id")
    empty = rows.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
