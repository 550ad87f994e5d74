"""Conversation structure repair: a checkpointed dynamic programme over states and edits.

Turns become `(s?(ua)+)?` by the cheapest edits: Keep 0, Rerole to user or assistant 2, Delete 3 (required for blank and repeated
turns), Insert an empty user or assistant turn 2; a truncated turn that stays adds 1. Four states say what was emitted last
(nothing, s, u, a), and an edit's letter has one target in each, so the ASCII-least of the cheapest edit strings comes from a walk
that takes at each step the least letter that is tight. For that, backward vectors give the least cost from each state on. They
are kept only every square root of n turns and worked out anew block by block while the walk goes forward.

At scale: turns are parted by range of (conversation, turn, ...), so that a conversation of any size spreads over tasks, and each
task holds one run of turns in order. Conversations that lie inside a task are finished there. Only the first and the last of each
task may go on in another: their turns are written down as parts, two a task at most. A part sums up as a matrix of costs
between states; the matrices, two a task, give each part its vector of costs beyond; each part then walks from each of the four
states, and composing the ends says which of these walks holds. Repeated turns are known within a part; between parts of one
conversation, first occurrences meet by their digests. What goes through one task for a whole conversation is its digest only, which
is streamed: SHA-256 is a chain.

Defined cases: a null role or text is one space, so a null text is blank. Null turns come first; of rows alike in turn the order is
by role and a hash of the text, so repeated rows are neighbours. Null conversation ids are a conversation of their own. Empty texts
are blank; very long ones are read whole. Roles count by their first letter, an empty one fits nowhere. An empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from ast import literal_eval
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, saved, table

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or reroled turn leads to, and what it is.
FORCED = (USER, USER, ASSISTANT, USER)
#: The state that a kept turn of initial s, u, a or another leads to.
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 3, 2, 2, 1
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
MUST_GO = 8
#: Edits as the walk writes them (capital U, A: rerole; small: insert) and as they are reported.
LETTER = {"D": "D", "K": "K", "U": "R", "A": "R", "u": "I", "a": "I"}
COST = {"D": DELETE_COST, "K": 0, "R": REROLE_COST, "I": INSERT_COST}
ROLE = {"u": "user", "a": "assistant"}
Vector = tuple[float, float, float, float]


def with_inserts(v: Vector) -> Vector:
    """Costs from each state if turns may be inserted first."""
    u, a = min(v[USER], INSERT_COST + v[ASSISTANT]), min(v[ASSISTANT], INSERT_COST + v[USER])
    return min(v[START], INSERT_COST + u), min(v[SYSTEM], INSERT_COST + u), u, a


#: After the last turn: nothing or a complete exchange is left as it is.
END = with_inserts((0, math.inf, math.inf, 0))


def code_of(role: str, fault: int) -> int:
    """What the programme needs to know of a turn."""
    return MUST_GO if fault in (BLANK, DUPLICATE) else ("sua".find(role[0]) % 4 if role else 3) * 2 + (fault == TRUNCATED)


_STEPS: dict[tuple[int, Vector], Vector] = {}


def _step(code: int, v: Vector) -> Vector:
    if (code, v) not in _STEPS:
        _STEPS[code, v] = _new_step(code, v)
    return _STEPS[code, v]


def _new_step(code: int, v: Vector) -> Vector:
    out = []
    for s in range(4):
        best = DELETE_COST + v[s]
        if code != MUST_GO:
            k, extra = KEPT[s][code >> 1], code & 1
            best = min(best, REROLE_COST + extra + v[FORCED[s]], math.inf if k is None else extra + v[k])
        out.append(best)
    return with_inserts(tuple(out))


def before(code: int, v: Vector) -> Vector:
    """Costs from each state before a turn, from those after it. Only differences matter, and there are few."""
    low = min(v)
    w = _step(code, (v[0] - low, v[1] - low, v[2] - low, v[3] - low))
    return w[0] + low, w[1] + low, w[2] + low, w[3] + low


def costs(codes: bytes, beyond: Vector) -> Vector:
    for c in reversed(codes):
        beyond = before(c, beyond)
    return beyond


def walk(codes: bytes, beyond: Vector, state: int) -> tuple[list[str], int]:
    """The edits before and at each turn, ASCII-least among the cheapest, and the state after them. beyond: costs after the last turn."""
    n = len(codes)
    size = math.isqrt(n) + 1
    marks, v = {n: beyond}, beyond
    for i in range(n - 1, -1, -1):
        v = before(codes[i], v)
        if i % size == 0:
            marks[i] = v
    out = []
    for start in range(0, n, size):
        end = min(start + size, n)
        block = [marks[end]]
        for i in range(end - 1, start - 1, -1):
            block.append(before(codes[i], block[-1]))
        block.reverse()
        for i in range(start, end):
            here, after, code, edits = block[i - start], block[i - start + 1], codes[i], ""
            while True:
                want, forced = here[state], FORCED[state]
                if want == DELETE_COST + after[state]:
                    edits += "D"
                elif want == INSERT_COST + here[forced]:
                    edits, state = edits + "  ua"[forced], forced
                    continue
                elif code != MUST_GO and (k := KEPT[state][code >> 1]) is not None and want == (code & 1) + after[k]:
                    edits, state = edits + "K", k
                else:
                    edits, state = edits + "  UA"[forced], forced
                break
            out.append(edits)
    return out, state


def closing(state: int) -> str:
    """The turns inserted after the last one."""
    return {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}[state]


class Digest:
    """The summary of one conversation from its turns in order and their edits."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.cost, self.letters = [0, 0, 0, 0], 0, 0, []
        self.first = self.last = self.initial = None
        self.turns, self.sha, self.started = 0, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.started else "") + f"{role}:{text}").encode())
        self.started = True

    def add(self, turn: int | None, role: str, text: str, fault: int, edits: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.edit(edits, role, text, fault)

    def edit(self, edits: str, role: str = "", text: str = "", fault: int = SOUND) -> None:
        for e in edits:
            letter = LETTER[e]
            self.letters.append(letter)
            self.cost += COST[letter] + (TRUNCATED_COST if letter in "KR" and fault == TRUNCATED else 0)
            if letter != "D":
                self._put(role if letter == "K" else ROLE[e.lower()], "" if letter == "I" else text)

    def done(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.letters), self.sha.hexdigest()


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
SUMMARY = ("gaps long", "blank long", "duplicate long", "truncated long", "illegal long", "cost long", "audit string", "repaired_sha256 string")
EDITS = ("part long", "pos long", "nth int", "edit string", "turn long", "role string", "text string", "fault int")
_TURN = ("part long", "pos long", "turn long", "role string", "text string", "fault int", "key binary")


def _names(columns: tuple[str, ...]) -> list[str]:
    return [c.split()[0] for c in columns]


def _batches(rows: list[tuple], columns: tuple[str, ...], kind: pa.DataType | None = None, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as batches; the first value of a row is a conversation's id if its kind is given."""
    schema = pa.schema(([("conv_id", kind)] if kind else []) + [(c.split()[0], _ARROW[c.split()[1]]) for c in columns])
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + size], strict=True), schema, strict=True)], schema=schema)


def _edit_rows(part: int, pos: int, edits: str, turn: int | None, role: str, text: str, fault: int) -> Iterator[tuple]:
    for nth, e in enumerate(edits):
        letter = LETTER[e]
        yield part, pos, nth, letter, None if letter == "I" else turn, role if letter in "KD" else ROLE[e.lower()], "" if letter == "I" else text, SOUND if letter == "I" else fault


def _finish(part: int, turns: list[tuple], digest: bool) -> list[tuple]:
    """What a whole conversation gives: its summary, or its edits."""
    edits, state = walk(bytes(code_of(t[3], t[5]) for t in turns), END, START)
    if not digest:
        out = [row for t, e in zip(turns, edits, strict=True) for row in _edit_rows(part, t[1], e, *t[2:6])]
        return out + list(_edit_rows(part, turns[-1][1] + 1, closing(state), None, "", "", SOUND))
    d = Digest()
    for t, e in zip(turns, edits, strict=True):
        d.add(*t[2:6], e)
    d.edit(closing(state))
    return [d.done()]


def _in_order(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault (blank and truncated), parted by range and in order."""
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(solid == "", BLANK).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    rows = turns.withColumn("fault", fault).withColumn("h", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "h", "tie"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")


def _first_pass(turns: DataFrame, digest: bool) -> DataFrame:
    """What finished conversations give, in columns f_..., and the turns of each task's first and last conversation, which have a part."""
    inner = tuple(f"f_{c}" for c in (SUMMARY if digest else EDITS))
    columns, no_inner, no_turn = inner + _TURN, (None,) * len(inner), (None,) * len(_TURN)
    conv = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, own, seen, key, first, n = TaskContext.get().partitionId(), [], [], set(), None, True, 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, turn, role, text, fault in zip(ids, *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if n and i != key:
                    if not first:
                        out += [(key, *row, *no_turn) for row in _finish(2 * task, own, digest)]
                    first, own, seen = False, [], set()
                key, n, digest_of = i, n + 1, None
                if fault != BLANK:
                    digest_of = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode())
                    fault = DUPLICATE if digest_of in seen else fault
                    seen.add(digest_of)
                own.append((2 * task, n, turn, role, text, fault, digest_of if fault != DUPLICATE else None))
                if first:  # its turns need not be kept
                    out.append((key, *no_inner, *own.pop()))
            yield from _batches(out, columns, batch.schema.field(0).type)
            out, kind = [], batch.schema.field(0).type
        if own:
            yield from _batches([(key, *no_inner, 2 * task + 1, *t[1:]) for t in own], columns, kind)

    return _in_order(turns).mapInArrow(run, ", ".join((conv, *columns)))


def _chains(parts: list[tuple[int, object]]) -> dict[int, int]:
    """The first part of each part's conversation. Parts, two a task at most, are numbered in the order of conversations."""
    chain, last = {}, None
    for part, key in sorted(parts, key=lambda p: p[0]):
        chain[part] = chain[last[0]] if last and last[1] == key else part
        last = part, key
    return chain


def _across(edges: DataFrame, chain: dict[int, int]) -> DataFrame:
    """edges with chain, and with repeated turns marked that stand in several parts of a conversation."""
    spark = edges.sparkSession
    edges = edges.join(F.broadcast(spark.createDataFrame(list(chain.items()), "part long, chain long")), "part")
    if len(set(chain.values())) == len(chain):
        return edges.drop("key")
    first = edges.where("key is not null").groupBy("chain", "key").agg(F.min("part").alias("at"), F.max("part").alias("to")).where("at < to").select("chain", "key", "at")
    met = edges.where("key is not null").join(saved(first), ["chain", "key"], "left")
    met = met.withColumn("fault", F.when(F.col("part") > F.col("at"), DUPLICATE).otherwise(F.col("fault"))).drop("at")
    return met.unionByName(edges.where("key is null")).drop("key")


def _by_part(coded: DataFrame, each, columns: tuple[str, ...]) -> DataFrame:
    """each(part, positions, codes, extra) gives rows: of the turns (part, pos, code, extra) of each part in order. A part is what a task held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def given() -> Iterator[pa.RecordBatch]:
            table_ = pa.Table.from_batches(held)
            codes = bytes(table_["code"].to_pylist())
            yield from _batches(each(table_["part"][0].as_py(), table_["pos"].to_pylist(), codes, table_["extra"][0].as_py()), columns)

        for batch in batches:
            part, start = batch.column(0).to_pylist(), 0
            for i in range(1, len(part) + 1):
                if held and part[start] != held[-1]["part"][0].as_py():
                    yield from given()
                    held.clear()
                if i == len(part) or part[i] != part[start]:
                    held.append(batch.slice(start, i - start))
                    start = i
        if held:
            yield from given()

    return coded.repartition("part").sortWithinPartitions("part", "pos").mapInArrow(run, ", ".join(columns))


def _matrix(part: int, pos: list[int], codes: bytes, _: None) -> list[tuple]:
    ends = [tuple(0 if s == t else math.inf for s in range(4)) for t in range(4)]
    return [(part, repr([[None if x == math.inf else x for x in costs(codes, e)] for e in ends]))]


def _walks(part: int, pos: list[int], codes: bytes, beyond: list[int]) -> list[tuple]:
    found = [walk(codes, tuple(beyond), s) for s in range(4)]
    ends = repr([state for _, state in found])
    return [(part, p, *(edits[i] for edits, _ in found), ends if i == len(pos) - 1 else None) for i, p in enumerate(pos)]


def _edge_edits(edges: DataFrame, chain: dict[int, int]) -> DataFrame:
    """edges with edits, those at the end of a conversation included."""
    spark = edges.sparkSession
    initial = F.expr("position(substring(role, 1, 1), 'sua')") - 1
    code = F.when(F.col("fault").isin(BLANK, DUPLICATE), MUST_GO).otherwise(F.when((F.col("role") == "") | (initial < 0), 3).otherwise(initial) * 2 + (F.col("fault") == TRUNCATED).cast("int"))
    coded = edges.select("part", "pos", code.cast("int").alias("code"))
    matrix = {r.part: [[math.inf if x is None else x for x in row] for row in literal_eval(r.costs)] for r in _by_part(coded.withColumn("extra", F.lit(None).cast("int")), _matrix, ("part long", "costs string")).collect()}
    beyond, order, last = {}, sorted(chain), None
    for part in reversed(order):
        v = END if last is None or chain[last] != chain[part] else tuple(min(matrix[last][t][s] + beyond[last][t] for t in range(4)) for s in range(4))
        beyond[part], last = v, part
    given = F.broadcast(spark.createDataFrame([(p, [int(x) for x in v]) for p, v in beyond.items()], "part long, extra array<long>"))
    walked = saved(_by_part(coded.join(given, "part"), _walks, ("part long", "pos long", "e0 string", "e1 string", "e2 string", "e3 string", "ends string")))
    ends = {r.part: literal_eval(r.ends) for r in walked.where("ends is not null").select("part", "ends").collect()}
    starts, closes, state = [], {}, START
    for i, part in enumerate(order):
        state = START if chain[part] == part else state
        starts.append((part, state))
        state = ends[part][state]
        if i + 1 == len(order) or chain[order[i + 1]] != chain[part]:
            closes[part] = closing(state)
    tail = F.broadcast(spark.createDataFrame([(p, s, closes.get(p, "")) for p, s in starts], "part long, state int, closing string"))
    chosen = walked.join(tail, "part").select("part", "pos", F.element_at(F.array("e0", "e1", "e2", "e3"), F.col("state") + 1).alias("edits"), F.when(F.col("ends").isNotNull(), F.col("closing")).otherwise("").alias("closing"))
    return edges.join(chosen, ["part", "pos"])


def _digested(edges: DataFrame) -> DataFrame:
    """The summaries of conversations whose turns, in parts, have their edits. Each is streamed."""
    kind = edges.schema["conv_id"].dataType.simpleString()
    turns = edges.repartition("chain").sortWithinPartitions("chain", "part", "pos").select("conv_id", "chain", "turn", "role", "text", "fault", "edits", "closing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key, d = None, None, None
        for batch in batches:
            out = []
            for i, chain, turn, role, text, fault, edits, closing_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chain != at:
                    if d:
                        out.append((key, *d.done()))
                    at, key, d = chain, i, Digest()
                d.add(turn, role, text, fault, edits)
                d.edit(closing_)
            yield from _batches(out, SUMMARY, batch.schema.field(0).type)
            id_type = batch.schema.field(0).type
        if d:
            yield from _batches([(key, *d.done())], SUMMARY, id_type)

    return turns.mapInArrow(run, ", ".join((f"conv_id {kind}", *SUMMARY)))


def _exploded(edges: DataFrame) -> DataFrame:
    """Each edit of each turn as a row."""
    letters = F.split(F.concat("edits", "closing"), "")
    rows = edges.select("conv_id", "part", "pos", "turn", "role", "text", "fault", F.posexplode(F.filter(letters, lambda e: e != "")).alias("nth", "e"))
    own, forced = F.col("e").isin("D", "K"), F.when(F.lower("e") == "u", "user").otherwise("assistant")
    new = F.col("e").isin("u", "a")
    letter = F.when(own, F.col("e")).when(new, "I").otherwise("R")
    return rows.select("conv_id", "part", "pos", "nth", letter.alias("edit"), F.when(~new, F.col("turn")).alias("turn"), F.when(own, F.col("role")).otherwise(forced).alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"), F.when(new, SOUND).otherwise(F.col("fault")).alias("fault"))


def _solved(conversations: DataFrame, digest: bool, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    with arrow_batches(turns.sparkSession):
        passed = saved(_first_pass(turns, digest))
    columns = SUMMARY if digest else EDITS
    done = passed.where("part is null").select("conv_id", *(F.col(f"f_{c}").alias(c) for c in _names(columns)))
    edges = passed.where("part is not null").select("conv_id", *_names(_TURN))
    parts = edges.groupBy("part").agg(F.first("conv_id").alias("conv_id")).collect()  # two a task at most
    if not parts:
        return done
    chain = _chains([(r.part, r.conv_id) for r in parts])
    edges = _edge_edits(saved(_across(edges, chain)), chain)
    return done.unionByName(_digested(edges) if digest else _exploded(edges).withColumn("part", F.col("part").cast("long")))


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per edit: conv_id; part, pos and nth, the order within a conversation; edit (K, R, D or I); turn, role and text as
    repaired (of D: as they were); fault of the turn. Rows other than D, in order, are the repaired conversation."""
    return _solved(conversations, False, id_col, turn_col, role_col, text_col)


def summaries(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, counts of gaps and faults, cost, audit and repaired_sha256, made of the edits that repair() gives."""
    return _solved(conversations, True, id_col, turn_col, role_col, text_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of conv_id:turn modulo 20."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = summaries(damaged(rows)).withColumnRenamed("conv_id", "id")
    ids = rows.select("conv_id").distinct()
    nothing = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id").na.fill(nothing)
