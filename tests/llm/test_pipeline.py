"""The pipeline's stages in order, each on its own input."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hexaphase.llm import common, near_copies, op3_sentencepiece, op5_simhash, op7_quality
from hexaphase.llm.common import saved, table


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = table(spark, sf, "documents")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(saved(f(spark, out[-1], sf)))
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns_and_counts(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5]) and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "tokens"]
    n = [len(ids(s)) for s in stages]
    assert n[0] > n[1] >= n[2] >= n[3] > 0 and n[4] == n[5]


def test_quality_rejects_by_score(spark, sf, stages):
    model = op7_quality.fit(stages[0], table(spark, sf, "labels"))
    kept = {r.doc_id for r in op7_quality.score(stages[0].select("doc_id", "text"), model).collect() if r.score >= corpus_pipeline.LEAST_QUALITY}
    assert set(ids(stages[1])) == kept


def test_one_of_each_group_stays(stages):
    texts = ["".join((r.text or "").split()) for r in stages[2].collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {"".join((r.text or "").split()) for r in stages[1].collect()}


def test_mix_repeats_twice_at_most_and_tokens_round_trip(stages):
    got = ids(stages[4])
    assert set(got) <= set(ids(stages[3])) and max(map(got.count, set(got))) <= 2
    assert all(r.round_trip for r in stages[5].collect())


def near_pairs(rows):
    """Brute force: pairs of ids whose five-word shingle sets have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, text in rows:
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in re.split(r"[ \t\n\v\f\r]+", text or "") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}


def smallest(ids, pairs):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_copies_leave(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(3000)}"
    rows, shared = [], [word() for _ in range(30)]
    for base in range(12):
        text = [word() for _ in range(int(rng.integers(60, 200)))] + shared * (base % 3 == 0)
        for copy in range(6):
            other = list(text)
            for _ in range(copy):
                other[rng.integers(len(other))] = word()
            rows.append((len(rows), " ".join(other)))
    text = [word() for _ in range(120)]
    for _ in range(60):  # a large group, in which many pairs are not similar directly
        other = list(text)
        for _ in range(2):
            other[rng.integers(len(other))] = word()
        rows.append((len(rows), " ".join(other)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "One two"), (len(rows) + 3, "one  TWO")]
    pairs = near_pairs(rows)
    want = smallest([i for i, _ in rows], pairs)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(df.repartition(3)).collect()} == want
    assert set(ids(corpus_pipeline.near_dedup(spark, df, ""))) == {i for i in want if want[i] == i} and len(pairs) > 100


def test_near_copies_go_through_the_fingerprint_grid(spark):
    """op5's grid links close copies by itself; classes of near fingerprints whose sets are not similar stay apart."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(20):
        text = [f"w{rng.integers(5000)}" for _ in range(400)]
        texts += [" ".join(text), " ".join([*text[:-1], "other"]), " ".join(["another", *text[1:]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = saved(near_copies.embedded(df, "doc_id", "text"))
    sets = {r.fp: r for r in rows.collect()}
    assert all(r.print == int(np.uint64(op5_simhash.majority(np.frombuffer(r.hashes, np.uint64))).view(np.int64)) for r in sets.values())
    near = lambda a, b: near_copies.similarity(*(np.frombuffer(sets[x].hashes, np.uint64) for x in (a, b))) >= 0.8
    bits = lambda a, b: ((sets[a].print ^ sets[b].print) & (2**64 - 1)).bit_count()
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if bits(a, b) <= 3 and near(a, b)}
    edges = {(r.a, r.b) for r in near_copies.print_links(rows.select("fp", "print", "size"), rows).collect()}
    assert edges <= want and len(edges) >= 10 and smallest(sets, edges) == smallest(sets, want)
    lone = rows.withColumn("print", F.lit(7).cast("long"))
    assert {frozenset((r.a, r.b)) for r in near_copies.print_links(lone.select("fp", "print", "size"), lone).collect()} == {frozenset((min(sets), b)) for b in sets if b != min(sets) and near(min(sets), b)}


def test_sets_are_picked_without_sorting_them(spark, monkeypatch):
    """A class's set is that of one row, chosen by number: no plan sorts or groups sketches or sets to leave one of each."""
    texts = [f"a b c d e f g h i j k l m n o {k // 3 % 2}" for k in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows, plans = saved(near_copies.embedded(df, "doc_id", "text")), []
    monkeypatch.setattr(near_copies, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df))
    edges = near_copies.links(rows).collect()
    assert rows.select("row").distinct().count() == 12 and {(r.a, r.b) for r in edges} == {tuple(sorted(r.fp for r in rows.select("fp").distinct().collect()))}
    read = [p for p in plans if re.search("sketch|hashes", p)]
    assert len(read) >= 2 and not any("SortAggregate" in p for p in read)


def test_workers_give_back_what_they_free(monkeypatch):
    """Before a task and after it; and op3 holds as text no more of a batch than it encodes at once."""
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append("back"))
    assert list(common.lean(lambda batches: (done.append(x) or x for x in batches))(iter([1, 2]))) == [1, 2] and done == ["back", 1, 2, "back"]
    monkeypatch.undo()
    common.give_back()


def test_reading_a_saved_table_takes_no_memory_outside_the_heap(spark):
    """Each thread of vectored reads would keep a buffer of its largest read, and an executor keeps its threads."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(spark._jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean"))
    direct = lambda: next(b.getMemoryUsed() for b in beans if b.getName() == "direct")
    digests = F.concat(*(F.sha2(F.concat_ws(":", "id", F.lit(i)), 512) for i in range(16)))
    made = spark.range(0, 40_000, 1, 2).select("id", F.unhex(digests).alias("x"))
    one, other = saved(made), near_copies.saved(made)
    before = direct()
    assert [df.agg(F.sum(F.length("x"))).first()[0] for df in (one, other)] == [40_000 * 1024] * 2
    assert direct() - before < 5_000_000
    assert all(f.endswith(".snappy.parquet") for f in other.inputFiles())


def test_stages_send_short_batches_and_read_without_kept_buffers(spark, sf):
    """Stages compute after they have returned, so the session's settings must hold then; smaller batches of the caller stay."""
    rows, vectored = "spark.sql.execution.arrow.maxRecordsPerBatch", "parquet.hadoop.vectored.io.enabled"
    docs, before = table(spark, sf, "documents"), spark.conf.get(rows)
    try:
        for stage in (corpus_pipeline.quality, corpus_pipeline.tokens):
            for given, want in (("10000", "1000"), ("0", "1000"), ("40", "40")):
                spark.conf.set(rows, given)
                stage(spark, docs, sf)
                assert spark.conf.get(rows) == want
        assert spark._jsparkSession.sessionState().newHadoopConf().get(vectored) == "false"
    finally:
        spark.conf.set(rows, before)
        spark.conf.unset(vectored)


def test_tokens_do_not_depend_on_pieces(spark, sf, monkeypatch):
    rows = table(spark, sf, "documents").select("doc_id", "text").limit(40).unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    rows = saved(rows)
    want = sorted(map(str, op3_sentencepiece.tokenize(rows).collect()))
    monkeypatch.setattr(op3_sentencepiece, "CHUNK_BYTES", 3000)
    assert sorted(map(str, op3_sentencepiece.tokenize(rows).collect())) == want and len(want) == rows.count()


def test_near_dedup_stage_against_brute_force(stages):
    want = smallest(ids(stages[2]), near_pairs([(r.doc_id, r.text) for r in stages[2].collect()]))
    assert sorted(ids(stages[3])) == sorted(i for i in want if want[i] == i)


def test_stages_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Every stage keeps all columns, whatever their names, and gives defined rows for odd and for no rows."""
    spark.createDataFrame([(0, 1, 0), (1, 1, 0), (5, 0, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, odd, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert none.count() == 0, name
        if name == "tokens":
            assert out.count() == odd.count()
        else:
            assert out.columns == none.columns == odd.columns and out.count() <= odd.count() * (2 if name == "mixing" else 1), name
            kept = {r.doc_id for r in out.collect()}
            assert kept <= {r.doc_id for r in odd.collect()}, name
            if name == "exact_dedup":
                assert {1, 5, 6, 7, 8, 9, 10} <= kept and 0 not in kept and len(kept & {2, 3, 4}) == 1
            if name == "near_dedup":
                assert {5, 6, 7, 10} <= kept and not {1, 9} & kept


def test_sets_that_share_a_passage_are_not_held_against_each_other(spark, monkeypatch):
    """Sets that meet in cells without being similar are left to the exact search, which pairs few of them and still finds what is similar among them."""
    rng = np.random.default_rng(12)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join([*passage, *(f"w{rng.integers(10**9)}" for _ in range(12 + k % 4))])) for k in range(400)]
    rows += [(400 + k, rows[k][1] + " end") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made, pairs = saved(near_copies.embedded(df, "doc_id", "text")), []
    plain = near_copies._pairs
    monkeypatch.setattr(near_copies, "_pairs", lambda met: pairs.append(out := plain(met)) or out)
    near_copies.links(made).collect()
    assert sum(p.count() for p in pairs) < 12_000 < 400 * 399 // 2  # before: each pair of a cell
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == smallest([i for i, _ in rows], near_pairs(rows))


@pytest.mark.parametrize("at_once", [0, 2e7])
def test_exact_search_finds_all_links(spark, monkeypatch, at_once):
    """Without cells of least hashes or fingerprints before it, by rounds of leaders and at once."""
    rng = np.random.default_rng(5)
    rows = []
    for base in range(8):
        text = [f"w{rng.integers(500)}" for _ in range(80)]
        for copy in range(9):
            other = list(text)
            for _ in range(copy % 4):
                other[rng.integers(len(other))] = f"w{rng.integers(500)}"
            rows.append((len(rows), " ".join(other[: 80 - copy])))
    monkeypatch.setattr(near_copies, "AT_ONCE", at_once)
    made = saved(near_copies.embedded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text"))
    none = spark.createDataFrame([], "a long, b long")
    edges = near_copies.exact_links(made.select("fp", F.col("fp").alias("c")).distinct(), made, near_copies._heads(made), none)
    got = {r.doc_id: r.component_id for r in near_copies._named(made, saved(edges)).collect()}
    pairs = near_pairs(rows)
    assert got == smallest([i for i, _ in rows], pairs) and len(pairs) > 50
