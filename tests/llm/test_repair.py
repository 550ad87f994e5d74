"""Conversation repair against a brute force over whole edit strings, on long, odd and empty tables."""

import hashlib
import random
import zlib

import pytest

from hexaphase.llm import op11_repair as op11
from hexaphase.llm.common import table

WHITE = " \t\n\x0b\x0c\r"


def best_edits(turns):
    """(cost, edits) by comparing whole edit strings; turns: (role, text, fault)."""
    after = {0: (0, ""), 3: (0, "")}
    forced = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserts(best):
        for _ in range(4):
            for s in range(4):
                if forced[s] in best:
                    c, e = best[forced[s]]
                    best[s] = min(best.get(s, (10**9, "")), (c + 2, "I" + e))
        return best

    after = inserts(after)
    for role, _, fault in reversed(turns):
        here = {}
        for s in range(4):
            ways = [(after[s][0] + 3, "D" + after[s][1])]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                to = {"s": 1, "u": 2, "a": 3}.get(role[:1])
                if (s, to) in ((0, 1), (0, 2), (1, 2), (2, 3), (3, 2)):
                    ways.append((after[to][0] + extra, "K" + after[to][1]))
                ways.append((after[forced[s]][0] + 2 + extra, "R" + after[forced[s]][1]))
            here[s] = min(ways)
        after = inserts(here)
    return after[0]


def brute(rows):
    """rows: (turn, role, text) of one conversation, in order."""
    turns, seen, numbers = [], set(), [t for t, _, _ in rows if t is not None]
    for _, role, text in rows:
        solid = text.strip(WHITE)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        turns.append((role, text, fault))
    cost, edits = best_edits(turns)
    repaired, i, state = [], 0, 0
    for e in edits:
        forced = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
        role, text = (forced, "") if e == "I" else turns[i][:2]
        i += e != "I"
        if e != "D":
            role = forced if e == "R" else role
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            repaired.append(f"{role}:{text}")
    faults = [f for _, _, f in turns]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(repaired).encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def expected(rows):
    out = {r[0]: [] for r in rows}
    for conv, *turn in damage(rows):
        out[conv].append(tuple(turn))
    return {k: brute(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0))) for k, v in out.items()}


def held(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def conversations(rng, n, sizes):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u"], ["Yes.", "No", "What?", "", None, " \n", "Long! ", "ok.\x0b"]
    return [(c, t, rng.choice(roles[: 2 + 5 * (rng.random() < 0.4)]), f"{t}{rng.choice(texts[:3])}" if rng.random() < 0.7 else rng.choice(texts)) for c in range(n) for t in sorted(rng.sample(range(sizes * 2), rng.randrange(1, sizes)))]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_table_against_brute_force(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = op11.op11_repair(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert held(got) == expected(rows)


def test_odd_conversations_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = conversations(rng, 60, 12)
    rows += [(None, None, "user", "Hm."), (None, 3, None, None), (None, 5, "assistant", "x" * 150_000)]
    rows += [(900, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Yes.", "No", f"T{t}."])) for t in range(700)]  # over all tasks
    rows += [(901, 0, "user", "Only one")]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "2 as chain", "3 as fault").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert held(op11.op11_repair(spark, str(tmp_path))) == expected(rows)


def test_repeated_rows_and_ties(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")] + [(2, None, "user", "Same.")] * 50
    got = held(op11.summaries(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    assert got[1] == brute([r[1:] for r in rows[:4]]) and got[2] == brute([r[1:] for r in rows[4:]])
    tied = [(3, 0, "user", f"Text {i}.") for i in range(9)]
    one, two = (held(op11.summaries(spark.createDataFrame(t, SCHEMA).repartition(3))) for t in (tied, tied[::-1]))
    assert one == two and one[3][5] == 4 * op11.REROLE_COST + op11.INSERT_COST


def test_repaired_turns_have_the_form_and_the_digest(spark, sf):
    rows = op11.damaged(table(spark, sf, "conversations"))
    edits = op11.repair(rows).orderBy("conv_id", "part", "pos", "nth").collect()
    want = held(op11.summaries(rows))
    for conv, w in want.items():
        own = [e for e in edits if e.conv_id == conv]
        stay = [f"{e.role}:{e.text}" for e in own if e.edit != "D"]
        assert "".join(e.edit for e in own) == w[6] and hashlib.sha256("\n".join(stay).encode()).hexdigest() == w[7]
        initials = "".join(s[0] for s in stay).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2) and (initials or not stay)


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11.op11_repair(spark, str(tmp_path)).count() == 0
    assert op11.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert held(op11.op11_repair(spark, f"{tmp_path}/b")) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("n", [0, 1, 2, 17, 400])
def test_walk_over_checkpoints_equals_brute_force(n):
    rng = random.Random(n)
    turns = [(rng.choice(["user", "assistant", "system", "x"]), "", rng.choice(["", "", "truncated", "blank"])) for _ in range(n)]
    codes = bytes(op11.code_of(r, {"": 0, "blank": 1, "truncated": 3}[f]) for r, _, f in turns)
    edits, state = op11.walk(codes, op11.END, 0)
    assert "".join(op11.LETTER[e] for e in "".join(edits) + op11.closing(state)) == best_edits(turns)[1]
    assert op11.costs(codes, op11.END)[0] == best_edits(turns)[0]
