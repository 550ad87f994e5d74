"""Alignment of two tokenizers' tokens against loops over whole texts."""

import collections
import hashlib
from pathlib import Path

import numpy as np
import pytest

from hexaphase.llm import op12_alignment as op12
from hexaphase.llm.common import table


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op12.MODEL_A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=op12.MODEL_B)


def brute_groups(text, tokenizers):
    """(A ids, B ids) of each group: whole texts encoded, and their bytes cut where both sides' tokens end."""
    a, b = tokenizers
    if not text:
        return []
    of, want = op12.byte_characters(), (" " + text).encode()
    sides = [[(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]]
    sides.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]])
    if any(b"".join(r for _, r in s) != want for s in sides):
        return []
    ends = []
    for s in sides:
        at, own = 0, []
        for i, r in s:
            at += len(r)
            own.append((at, i))
        ends.append(own)
    cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
    return [tuple([i for e, i in own if x < e <= y] for own in ends) for x, y in zip([0, *cuts], cuts)] if len(want) < 4000 else brute_long(ends, cuts)


def brute_long(ends, cuts):
    import bisect

    out = [([], []) for _ in cuts]
    for k, own in enumerate(ends):
        for e, i in own:
            out[bisect.bisect_left(cuts, e)][k].append(i)
    return out


def brute(rows, tokenizers):
    found = [(i, brute_groups(t, tokenizers)) for i, t in rows]
    count, links = collections.Counter(), []
    for _, groups in found:
        c = collections.Counter()
        for a, b in groups:
            for x, n in collections.Counter(a).items():
                for y, m in collections.Counter(b).items():
                    c[x, y] += n * m
        links.append(c)
        count.update(c.keys())
    most = collections.Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, groups), c in zip(found, links):
        s = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n for p, n in c.items() if count[p] == most[p[0]])
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(c.values()), best, sum(n * count[p] for p, n in c.items()), hashlib.sha256(s.encode()).hexdigest() if s else ""))
    return sorted(out)


def held(df):
    return sorted(tuple(r) for r in df.collect())


ODD = [None, "", " ", "  ", "\n", "a\nb", "a\n\nb", "a \n b", " lead", "tail ", "▁", "a▁b", "<|endoftext|> and <s> </s> <unk>", "x" * 5000, "=" * 999 + "-" * 500, "日本語テキスト 😀😀 mañana", "it's 'tis they'll \t tab\r\nCRLF", "a\x1cb c᠎d e  f", "\x00\x01", "1 2 3,4.5", " ' s", "é x", "ab " * 3000]


def test_documents_against_brute_force(spark, sf, tokenizers):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = op12.op12_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert held(got) == brute(rows, tokenizers)


def test_odd_texts_against_brute_force(spark, odd, empty, tokenizers, monkeypatch):
    rows = list(enumerate(ODD)) + [(3, "  "), (100, "ab " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as number", "3 as pairs").repartition(3)
    assert held(op12.alignments(df)) == brute(rows, tokenizers)
    assert held(op12.alignments(odd)) == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], tokenizers)
    assert op12.alignments(empty).count() == 0 and op12.pair_counts(empty).count() == 0 and op12.groups(empty).count() == 0


def test_blocks_do_not_change_results(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents").where("doc_id < 60")
    one = held(op12.alignments(docs.coalesce(1)))
    monkeypatch.setattr(op12, "BLOCK_PAIRS", 500)
    monkeypatch.setattr(op12, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(op12, "UNITS", 200)
    monkeypatch.setattr(op12, "HEAVY", 2)
    monkeypatch.setattr(op12, "LINKS_AT_ONCE", 50)
    assert held(op12.alignments(docs.repartition(5))) == one


def test_groups_have_the_bytes_of_their_tokens(spark, tokenizers):
    rows = [(i, t) for i, t in enumerate(ODD)]
    for r in op12.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = brute_groups(ODD[r.doc_id], tokenizers)
        assert [(g.a, g.b) for g in r.groups] == want
        ends = [g.end for g in r.groups]
        assert [g.start for g in r.groups] == [0, *ends][: len(ends)] and (not ends or ends[-1] == len((" " + ODD[r.doc_id]).encode()))


def test_counts_and_ties(spark, tokenizers):
    rows = [(1, "cat dog"), (2, "cat"), (3, "cat cat")]
    got = {(r.a, r.b): (r.n, r.best) for r in op12.pair_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cat = tokenizers[0].encode(" cat").ids[0], tokenizers[1].encode("cat")[0]
    assert got[cat] == (3, True) and all(best for n, best in got.values() if n == 3)


def test_units_stay_in_their_broadcast():
    """A worker's later tasks find the models read and the units that it has met."""
    from pathlib import Path

    held = {"a": Path(op12.MODEL_A).read_text(encoding="utf-8"), "b": Path(op12.MODEL_B).read_bytes()}
    units = op12.kept_units(held)
    op12.align(["the cat"], units)
    assert op12.kept_units(held) is units and " cat" in units.at


def test_units_used_often_are_kept(monkeypatch):
    """A worker that has met too many units keeps those used most, so that they are not encoded again, and gives the same tokens."""
    sides = [op12.side_a(Path(op12.MODEL_A).read_text(encoding="utf-8")), op12.side_b(Path(op12.MODEL_B).read_bytes())]
    texts = [f"the same words again and again n{k} ▁x{k}" for k in range(60)]
    want = op12.align(texts, op12.Units(*sides))
    monkeypatch.setattr(op12, "UNITS", 40)
    units, learned = op12.Units(*sides), []
    plain = units._learn
    monkeypatch.setattr(units, "_learn", lambda new: learned.extend(new) or plain(new))
    parts = [op12.align([t], units) for t in texts]
    for k in (0, 1):
        assert np.concatenate([p.ids[k] for p in parts]).tolist() == want.ids[k].tolist()
    assert learned.count(" words") == 1 and len(units.at) <= 40
