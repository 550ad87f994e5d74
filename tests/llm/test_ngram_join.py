"""The join of four-word shingle sets against all pairs, and its filters against their definitions."""

import itertools
import random
import re

import numpy as np
import pytest

from hexaphase.llm import op13_ngram_join as op13
from hexaphase.llm.common import table


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs of sets."""
    sets = []
    for i, text in rows:
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in re.split(r"[ \t\n\v\f\r]+", text or "") if x]
        sets.append((i, frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(sets)), 2):
        a, b = sets[x][1], sets[y][1]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            root[find(y)] = find(x)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets))


def held(df):
    return sorted(tuple(r) for r in df.collect())


def test_documents_against_all_pairs(spark, sf):
    got = op13.op13_ngram_join(spark, sf)
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and held(got) == brute(rows)


def made(rng):
    """Chains, near copies about the threshold, documents of shared passages, short texts, copies."""
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    passages = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(4)]
    out = []
    for i in range(60):  # a chain: each a few words from the one before
        at = rng.randrange(len(base))
        base[at : at + rng.choice([0, 1, 2])] = [rng.choice(words) for _ in range(rng.randrange(3))]
        out.append(" ".join(base))
    for _ in range(60):
        out.append(" ".join(rng.sample(passages, rng.randrange(1, 4)) + [rng.choice(words) for _ in range(rng.randrange(0, 8))]))
    for _ in range(40):  # one number of differences about the threshold
        t = [rng.choice(words) for _ in range(rng.randrange(1, 90))]
        out.append(" ".join(t))
        for at in sorted(rng.sample(range(len(t)), min(len(t), rng.randrange(1, 4)))):
            t[at] = rng.choice(words)
        out.append(" ".join(t))
    out += [out[3].upper(), out[3] + " ", "", None, " \n", "", "one", "One", "one two three", "one two three", "a b c d", "a b c d a b c d a b c d"]
    return list(enumerate(out)) + [(0, out[0]), (7, out[90])]


def test_made_texts_against_all_pairs(spark, monkeypatch):
    rows = made(random.Random(13))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as size", "3 as s", "4 as id").repartition(4)
    want = brute(rows)
    assert held(op13.similar_documents(df)) == want
    monkeypatch.setattr(op13, "AT_ONCE", 0)  # many rounds
    monkeypatch.setattr(op13, "LEADERS", 1)
    monkeypatch.setattr(op13, "MORE", 2)
    monkeypatch.setattr(op13, "HOT_ROWS", 3)  # hot tokens
    monkeypatch.setattr(op13, "BROADCAST_IDS", 0)
    assert held(op13.similar_documents(df)) == want


def test_odd_documents(spark, odd, empty):
    got = held(op13.similar_documents(odd))
    assert got == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert op13.similar_documents(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, None), (None, "q r s t u v")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id) for r in op13.similar_documents(nulls).collect() if r.component_id) == [(False, 2, 4), (True, 2, 4)]


@pytest.mark.parametrize("seed", range(30))
def test_no_filter_loses_a_similar_pair(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    gone = int(rng.integers(0, prefix := op13.prefix_size(len(x))))
    y = np.delete(x, rng.permutation(len(x))[:gone])
    z = np.unique(np.concatenate([x, rng.integers(0, 1 << 64, int(len(x) * 0.17), dtype=np.uint64)]))
    for other in (y, z):
        if op13.similar(x, other, len(x), len(other)):
            assert op13.share(op13.later_orders(x), op13.later_orders(other), len(x), len(other))
            assert len(np.intersect1d(op13.first_order(x)[:prefix], op13.first_order(other)[: op13.prefix_size(len(other))]))
    apart = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    assert not op13.similar(x, apart, len(x), len(apart))
