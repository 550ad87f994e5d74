"""Language-model scores by a probabilistic suffix tree over tokens.

Symbols are tokens: words in lower case and one end token per text, which also stands before the text's start. Contexts are
the last 1 to DEPTH tokens. A context of LEAST occurrences or more is a state of the tree if its next-symbol distribution
diverges (Kullback-Leibler) from that of the context one token shorter, by DIVERGENCE nats a token and DIVERGENCE_SUM in all.
Every next word of a state is kept. A state's distribution is smoothed by an absolute discount whose mass goes to the
distribution of the next shorter state; the root discounts by Good and Turing's estimate, and the discounts' sum is the
probability of an unknown word. A token is scored in the longest state that ends what precedes it. All thresholds are
counts of occurrences, so the tree grows with the training data; neither words nor states are ever collected or broadcast.

Exchanges, all of packed arrays:
1. A task cuts its documents into blocks of about BLOCK_BYTES of text and asks, by range of word hashes, for the counts of
   a block's distinct words. A range adds the counts up, names the words by number, and answers each block.
   Words and their counts are put in order by block and written.
2. A block now knows its base scores. It sends its tokens with their contexts, by the nearest context word: all contexts
   that end in a word, and all that follows them, are in one group, which builds that part of the tree and scores in it.
3. The groups return each document's sums to its block.
A word of more than SHARD_TOKENS occurrences is hot: its tokens are dealt to several groups by the word before it,
so contexts of two words or more stay whole (texts' first tokens have none, and are dealt by themselves and their block); next words of the hot word alone are counted over its groups by a plain
aggregation beforehand, and each group gets the counts that it needs.

Defined cases: a null or empty text is the end token alone. A row is training data if crc32(doc_id as text) mod 7 is not
2 (null: the empty text); without training rows every count is 0 and scores are those of the base. A very long text is one
block, cut at white space while words are hashed. Tied counts number words by their hashes; results do not depend on numbers. Repeated rows each count and are each reported. An empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER_BLANK, arrow_batches, hashed_words, input_bytes, pieces, saved, shards, table

DEPTH, LEAST = 2, 4
#: Nats by which a context's next words differ from the shorter one's: over all occurrences, and for each of its distinct next words.
DIVERGENCE_SUM, DIVERGENCE = 4.0, 0.5
DISCOUNT = 0.75
#: A block has this much text at least, and more in larger inputs: groups become more with the input, so what a block of one size sends to each gets short, and packs worse.
BLOCK_BYTES, MOST_BLOCK_BYTES = 1 << 22, 1 << 25
WORD_SHARD_BYTES, SHARD_TOKENS = 1 << 24, 3 << 18
#: Scores are summed as whole multiples of this, so that sums do not depend on their order.
GRAIN = 2.0**-20
#: Token numbers: the end token (before a text: its start), a word that is not in the training data, no token; words follow.
END, UNKNOWN, NONE, WORDS = 0, 1, 2, 3
#: The next words of a hot word reach a group in so many rows at most: a row each would be an Arrow batch for every two.
HOT_ROWS = 32
#: A hot word has fewer than 2 ** DEAL_BITS groups, and there are fewer than 2 ** (63 - DEAL_BITS) words.
DEAL_BITS = 24


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers of 0 or more in one piece: how many, bytes each as the largest needs, and these byte by byte of all numbers, compressed together."""
    head, planes = [], []
    for a in arrays:
        a = a.astype("<u8")
        size = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        head.append(len(a).to_bytes(5, "little") + bytes([size]))
        planes.append(a.view(np.uint8).reshape(-1, 8).T[:size].tobytes())
    body = b"".join(planes)
    return bytes([len(arrays)]) + b"".join(head) + pa.compress(body, "zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    shape = [(int.from_bytes(data[i : i + 5], "little"), data[i + 5]) for i in range(1, 1 + 6 * data[0], 6)]
    body = np.frombuffer(pa.decompress(data[1 + 6 * data[0] :], sum(n * size for n, size in shape), "zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for n, size in shape:
        wide = np.zeros((n, 8 if size > 3 else 4), np.uint8)
        wide[:, :size] = body[at : at + n * size].reshape(size, n).T
        out.append(wide.view("<i8" if size > 3 else "<i4").reshape(-1))
        at += n * size
    return out


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _steps(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values that ascend within the runs of equal keys, as steps from the one before; the first of each run as it is."""
    out, first = np.diff(values, prepend=0), _runs(keys)
    out[first] = values[first]
    return out


def _summed(keys: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The values of which _steps() has made steps."""
    first, out = _runs(keys), np.cumsum(steps, dtype=np.int64)
    return out - np.repeat(out[first] - steps[first], np.diff(np.append(first, len(keys))))


def _cuts(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of ascending shard numbers: each one, and where its part begins and ends."""
    first = _runs(shard)
    yield from zip(shard[first].tolist(), first.tolist(), [*first[1:].tolist(), len(shard)], strict=False)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


# First exchange: words.


def _requests(batches: Iterator[pa.RecordBatch], n_shards: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Per block: a row of its documents and the places of their words, and per shard its distinct words with their training counts."""
    from pyspark import TaskContext

    part, serial, ids, texts, total, kind = TaskContext.get().partitionId(), 0, [], [], 0, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            size = 64 + (len(t.as_buffer()) if t.is_valid else 0)  # a row costs something too
            if ids and total + size > block_bytes:
                yield _block(f"{part}-{serial}", ids, texts, n_shards, kind)
                serial, ids, texts, total = serial + 1, [], [], 0
            ids.append(i.as_py())
            texts.append(t.as_py() or b"")
            total += size
    if ids:
        yield _block(f"{part}-{serial}", ids, texts, n_shards, kind)


def _block(name: str, ids: list, texts: list[bytes], n_shards: int, kind: pa.DataType) -> pa.RecordBatch:
    held = np.array([is_held_out(i) for i in ids])
    hashes, n_words = [], []
    for x, y in pieces([len(t) for t in texts], 1 << 19):
        h, doc = hashed_words(texts[x:y], LOWER_BLANK)
        hashes.append(h)
        n_words.append(np.bincount(doc, minlength=y - x))
    n_words = np.concatenate(n_words)
    distinct, places = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.bincount(places, np.repeat(~held, n_words), len(distinct)).astype(np.int64)
    shard = (distinct >> np.uint64(32)).astype(np.int64) * n_shards >> 32
    rows = [{"shard": sum(map(ord, name)) % n_shards, "block": name, "ids": ids, "places": packed(held, n_words, places)}]
    rows += [{"shard": s, "block": name, "keys": packed(distinct[i:j], counts[i:j])} for s, i, j in _cuts(shard)]
    schema = pa.schema([("shard", pa.int32()), ("block", pa.string()), ("keys", pa.binary()), ("ids", pa.list_(kind)), ("places", pa.binary())])
    return _batch(rows, schema)


def _answers(rows: pa.Table, n_shards: int, hot: int) -> pa.Table:
    """Of one shard: every block's words with their number and count; the documents as they are; and a row of totals."""
    asks, names = rows.to_pylist(), [k for k in rows.column_names if k != "keys"]
    shard = asks[0]["shard"]
    own = [r for r in asks if r["keys"] is not None]
    asked = [unpacked(r["keys"]) for r in own]
    keys = [k.astype(np.int64).view(np.uint64) for k, _ in asked]
    flat = np.concatenate([np.zeros(0, np.uint64), *keys])
    distinct, where = np.unique(flat, return_inverse=True)
    total = np.bincount(where, np.concatenate([np.zeros(0, np.int64), *(n for _, n in asked)]), len(distinct)).astype(np.int64)
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, -total))] = np.arange(len(distinct))  # frequent words have small numbers
    number = np.where(total > 0, WORDS + rank * n_shards + shard, UNKNOWN)
    ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
    for r, k, end in zip(own, keys, ends.tolist(), strict=True):
        at = where[end - len(k) : end]
        r["numbers"] = packed(number[at], total[at])
    out = [{k: r.get(k) for k in (*names, "numbers")} for r in asks]
    out.append({"shard": shard, "n": int(total.sum()), "v": int((total > 0).sum()), "n1": int((total == 1).sum()), "n2": int((total == 2).sum()), "hot": int((total > hot).sum())})
    fields = [*(rows.schema.field(k) for k in names), ("numbers", pa.binary()), *((k, pa.int64()) for k in ("n", "v", "n1", "n2", "hot"))]
    return pa.Table.from_pylist(out, schema=pa.schema(fields))


_TOTALS = ("n", "v", "n1", "n2", "hot")


def _merged(rows: pa.Table) -> pa.Table:
    """Of one block: its documents with the numbers and counts of its words; totals go on as they are."""
    found = rows.to_pylist()
    if found[0]["block"] is None:
        out = [{k: sum(r[k] for r in found) for k in _TOTALS}]
    else:
        own = [r for r in found if r["ids"] is not None]
        if len(own) != 1:
            raise ValueError(f"{len(own)} lists of documents in block {found[0]['block']}")
        parts = [unpacked(x) for _, x in sorted((r["shard"], r["numbers"]) for r in found if r["numbers"] is not None)]
        out = [own[0] | {"numbers": packed(*(np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1)))}]
    schema = pa.schema([rows.schema.field(k) for k in rows.column_names if k != "shard"])
    return pa.Table.from_pylist([{k: r.get(k) for k in schema.names} for r in out], schema=schema)


class Counts:
    """What is known of the whole training data: tokens, distinct ones, end tokens, and the root's discount."""

    def __init__(self, n: int, v: int, ends: int, n1: int, n2: int) -> None:
        self.n, self.v, self.ends = n, v, ends
        self.discount = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))

    def root(self, total: np.ndarray) -> np.ndarray:
        """Probabilities of tokens by their counts; of 0, that of any unknown word."""
        return np.where(total > 0, np.maximum(total - self.discount, 1e-9), self.discount * self.v) / max(1, self.n)


# Second exchange: tokens in their contexts.


class Block:
    """A block's tokens, ends included: number, count, place of the document, and the numbers of the DEPTH tokens before it."""

    def __init__(self, row: dict, counts: Counts) -> None:
        self.name, self.ids = row["block"], row["ids"]
        (self.held, sizes, places), (number, total) = unpacked(row["places"]), unpacked(row["numbers"])
        self.held = self.held.astype(bool)
        n = len(sizes)
        stop = np.cumsum(sizes + 1) - 1  # where the ends go
        word = np.ones(len(places) + n, bool)
        word[stop] = False
        self.doc = np.repeat(np.arange(n), sizes + 1)
        self.token, self.count = np.full(len(word), END), np.full(len(word), counts.ends)
        self.token[word], self.count[word] = number[places], total[places]
        first = np.repeat(stop - sizes, sizes + 1)
        at = np.arange(len(word))
        self.before = []
        for k in range(1, DEPTH + 1):
            back = at - k
            self.before.append(np.where(back >= first, self.token[np.maximum(back, 0)], np.where(back == first - 1, END, NONE)))
        self.before_count = np.where(at > first, self.count[np.maximum(at - 1, 0)], counts.ends)

    def sums(self, values: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(self.doc[at], values, len(self.ids))


def _groups(block: Block, at: np.ndarray, n_shards: int, hot: int) -> np.ndarray:
    """The groups of the tokens: 0 and up by the nearest context word, below 0 those of hot words, dealt by the word before. Before a text's start is none, so first tokens are dealt by themselves and their block."""
    near, total = block.before[0][at], block.before_count[at]
    scattered = ((near * 0x9E3779B1) & 0xFFFFFFFF) * n_shards >> 32
    by = np.where(near == END, block.token[at] * 31 + zlib.crc32(block.name.encode()), block.before[1][at])
    deal = ((by * 0x85EBCA6B) & 0xFFFFFFFF) * -(-total // hot) >> 32
    return np.where(total > hot, -1 - ((near << DEAL_BITS) | deal), scattered)


def grains(log: np.ndarray) -> np.ndarray:
    """Logarithms of probabilities, as multiples of GRAIN below 0."""
    return np.rint(log / -GRAIN).astype(np.int64)


def _sent(near: np.ndarray, token: np.ndarray, count: np.ndarray, n: np.ndarray, doc: np.ndarray, further: list[np.ndarray]) -> bytes:
    """Ascending pairs of context and next word, the word's count, how often each; and of each occurrence its document with whether it is held out, ascending in its pair, and the further contexts. Small steps go in place of what ascends, and counts once a word."""
    _, first = np.unique(token, return_index=True)
    return packed(_steps(np.zeros(len(near), bool), near), _steps(near, token), count[first], n, _steps(np.repeat(np.arange(len(n)), n), doc), *further)


def _received(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """What _sent() has: near, token, count, doc and the further contexts, of each occurrence."""
    near, token, count, n, doc, *further = unpacked(data)
    near = np.cumsum(near, dtype=np.int64)
    token = _summed(near, token)
    count = count[np.unique(token, return_inverse=True)[1]]
    pair = np.repeat(np.arange(len(n)), n)
    return near[pair], token[pair], count[pair], _summed(pair, doc), further


def _events(batches: Iterator[pa.RecordBatch], counts: Counts, n_shards: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Of each block: what is known of its documents, and its tokens by group."""
    for batch in batches:
        for row in batch.to_pylist():
            yield _events_of(Block(row, counts), batch.schema.field("ids"), counts, n_shards, hot)


def _events_of(block: Block, ids: pa.Field, counts: Counts, n_shards: int, hot: int) -> pa.RecordBatch:
    log = np.log10(counts.root(block.count))
    goes = (block.before[0] != UNKNOWN) & (block.before_count >= LEAST)
    known = {"n_tokens": block.sums(np.ones(len(block.doc))).astype(np.int64), "n_known": block.sums(block.count > 0).astype(np.int64), "bases": block.sums(np.log10(block.count + 1.0)), "scores": block.sums(grains(log) * ~goes).astype(np.int64)}
    at = np.flatnonzero(goes)
    group = _groups(block, at, n_shards, hot)
    order = np.lexsort((block.token[at], block.before[0][at], group))
    at, group = at[order], group[order]
    out = [{"shard": sum(map(ord, block.name)) % n_shards, "block": block.name, "ids": block.ids, "held": packed(block.held)} | {k: v.tobytes() for k, v in known.items()}]
    near, token = block.before[0][at], block.token[at]
    for g, i, j in _cuts(group):
        own = slice(i, j)
        pair = np.flatnonzero(np.concatenate([[True], (near[own][1:] != near[own][:-1]) | (token[own][1:] != token[own][:-1])]))
        of = at[own]
        events = _sent(near[own][pair], token[own][pair], block.count[of][pair], np.diff(np.append(pair, j - i)), block.doc[of] * 2 + block.held[block.doc[of]], [b[of] for b in block.before[1:]])
        out.append({"shard": g, "block": block.name, "events": events})
    fields = [("shard", pa.int64()), ("block", pa.string()), ("events", pa.binary()), ids, *((k, pa.binary()) for k in ("held", *known))]
    return _batch(out, pa.schema(fields))


def _hot_pairs(batches: Iterator[pa.RecordBatch], counts: Counts, n_shards: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Of each block: its distinct pairs of a hot word and the next, by group, with training occurrences and the next word's count."""
    for batch in batches:
        for row in batch.to_pylist():
            yield _hot_pairs_of(Block(row, counts), n_shards, hot)


def _hot_pairs_of(block: Block, n_shards: int, hot: int) -> pa.RecordBatch:
    at = np.flatnonzero(block.before_count > hot)
    group = _groups(block, at, n_shards, hot)
    order = np.lexsort((block.token[at], group))
    at, group = at[order], group[order]
    near, token, count, train = block.before[0][at], block.token[at], block.count[at], ~block.held[block.doc[at]]
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (token[1:] != token[:-1])])) if len(at) else np.zeros(0, np.int64)
    n = np.add.reduceat(train.astype(np.int64), first) if len(at) else first
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (group[first], near[first], token[first], count[first], n)], names=["shard", "near", "token", "count", "n"])


def _shared(pairs: DataFrame) -> DataFrame:
    """shard, total, distinct, gain, words (token and n): of each group of a hot word its next words, counted over all groups of the hot word, in HOT_ROWS rows at most."""
    own = saved(pairs.groupBy("shard", "near", "token").agg(F.max("count").alias("count"), F.sum("n").alias("n")))
    words = own.groupBy("near", "token").agg(F.max("count").alias("count"), F.sum("n").alias("n")).where("n > 0")
    state = words.groupBy("near").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum(F.col("n") * (F.log("n") - F.log("count"))).alias("gain"))
    whole = own.withColumn("n", F.sum("n").over(Window.partitionBy("near", "token")))
    row = F.pmod(F.xxhash64("token"), F.lit(HOT_ROWS)).alias("_row")
    return whole.join(state, "near").groupBy("shard", "total", "distinct", "gain", row).agg(F.collect_list(F.struct("token", "n")).alias("words")).drop("_row")


def _next_words(hot: pa.Table) -> dict[str, np.ndarray]:
    """What _shared() has of one group: token (ascending) and n by next word; total, distinct and gain once."""
    words = pc.list_flatten(hot.column("words")).combine_chunks()
    token, n = (words.field(k).to_numpy(zero_copy_only=False) for k in ("token", "n"))
    order = np.argsort(token)
    return {"token": token[order], "n": n[order]} | {k: hot.column(k).to_numpy()[:1] for k in ("total", "distinct", "gain")}


def probabilities(before: list[np.ndarray], token: np.ndarray, count: np.ndarray, train: np.ndarray, counts: Counts, shared: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Of tokens in their contexts, all with a nearest context word of this group: builds the tree from those in train, and gives each one's probability.

    before: the numbers of the tokens before, nearest first. count: the token's own count. shared: for a hot word, what is
    counted over all its groups; token ascending.
    """
    p = counts.root(count)
    words, word = np.unique(token, return_inverse=True)
    rows, state = np.arange(len(token)), np.zeros(len(token), np.int64)
    above_n, above_total = count, np.full(len(token), counts.n)
    for depth, context in enumerate(before):
        there = (context[rows] != UNKNOWN) & (context[rows] != NONE)
        rows, state, above_n, above_total = (x[there] for x in (rows, state, above_n, above_total))
        if not len(rows):
            break
        _, begin, state = np.unique(state * (int(context.max()) + 1) + context[rows], return_index=True, return_inverse=True)
        _, first, entry = np.unique(state * len(words) + word[rows], return_index=True, return_inverse=True)
        own, of, trained = len(begin), state[first], train[rows]
        n, total = np.bincount(entry[trained], minlength=len(first)), np.bincount(state[trained], minlength=own)
        if depth == 0 and shared is not None:
            n = shared["n"][np.searchsorted(shared["token"], token[rows][first])]
            total, distinct, gain = (np.full(own, shared[k][0]) for k in ("total", "distinct", "gain"))
        else:
            met = np.flatnonzero(n > 0)
            distinct = np.bincount(of[met], minlength=own)
            gain = np.bincount(of[met], n[met] * (np.log(n[met]) - np.log(above_n[first][met])), own)
        gain = gain - total * (np.log(np.maximum(total, 1)) - np.log(np.maximum(above_total[begin], 1)))
        kept = (total >= LEAST) & (gain >= DIVERGENCE_SUM + DIVERGENCE * distinct)
        on = np.flatnonzero(kept[state])
        at, s, total_ = rows[on], state[on], total[state[on]]
        p[at] = np.maximum(n[entry[on]] - DISCOUNT, 0) / total_ + DISCOUNT * distinct[s] / total_ * p[at]
        deeper = total[state] >= LEAST
        above_n, above_total = n[entry][deeper], total[state][deeper]
        rows, state = rows[deeper], state[deeper]
    return p


_KNOWN = ("n_tokens", "n_known", "bases", "scores")


def _scored(rows: pa.Table, counts: Counts, hot: pa.Table | None = None) -> pa.Table:
    """Of one group: each block's sums of log10 probabilities by document; and what is known of documents, as it is."""
    found = rows.to_pylist()
    own = [r for r in found if r["events"] is not None]
    out = [{k: r.get(k) for k in ("block", "ids", "held", *_KNOWN)} for r in found if r["ids"] is not None]
    if own:
        parts = [_received(r["events"]) for r in own]
        near, token, count = (np.concatenate([p[k] for p in parts]) for k in range(3))
        docs = [p[3] for p in parts]
        further = [np.concatenate([p[4][k] for p in parts]) for k in range(DEPTH - 1)]
        del parts
        shared = None
        if hot is not None and hot.num_rows:
            shared = _next_words(hot)
        grain = grains(np.log10(probabilities([near, *further], token, count, np.concatenate(docs) & 1 == 0, counts, shared)))
        end = 0
        for r, d in zip(own, docs, strict=True):
            there, at = np.unique(d >> 1, return_inverse=True)
            out.append({"block": r["block"], "sums": packed(there, np.bincount(at, grain[end : end + len(d)]))})
            end += len(d)
    fields = [("block", pa.string()), ("sums", pa.binary()), *(rows.schema.field(k) for k in ("ids", "held", *_KNOWN))]
    return pa.Table.from_pylist(out, schema=pa.schema(fields))


# Third exchange: back to the documents.


def _combined(rows: pa.Table) -> pa.Table:
    """Of one block: the documents with their scores."""
    found = rows.to_pylist()
    own = [r for r in found if r["ids"] is not None]
    if len(own) != 1:
        raise ValueError(f"{len(own)} lists of documents in block {found[0]['block']}")
    r = own[0]
    grain = np.frombuffer(r["scores"], np.int64).copy()
    for x in found:
        if x["sums"] is not None:
            there, sums = unpacked(x["sums"])
            grain[there] += sums
    columns = [pa.array(r["ids"], rows.schema.field("ids").type.value_type), pa.array(unpacked(r["held"])[0].astype(bool))]
    columns += [np.frombuffer(r[k], t) for k, t in (("n_tokens", np.int64), ("n_known", np.int64), ("bases", np.float64))]
    return pa.table([*columns, grain * -GRAIN], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    block_bytes and shard_tokens: how much text a block, and how many tokens a group has, about; results do not depend on them."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    size, ends = rows.agg(input_bytes("text"), F.count_if(training)).first()
    n_shards, hot = max(1, min(shards(spark), size >> 20), size // WORD_SHARD_BYTES), max(1, shard_tokens)
    block_bytes = block_bytes or min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, int(250 * size**0.5)))
    documents = f"ids array<{kind}>, places binary"
    words = f"block string, {documents}, numbers binary, {', '.join(f'{k} long' for k in _TOTALS)}"
    asked = rows.mapInArrow(lambda batches: _requests(batches, n_shards, block_bytes), f"shard int, block string, keys binary, {documents}")
    answers = asked.groupBy("shard").applyInArrow(lambda rows: _answers(rows, n_shards, hot), f"shard int, {words}")
    with arrow_batches(spark):
        answers = saved(answers.groupBy("block").applyInArrow(_merged, words))
    n, v, n1, n2, hot_words = (x or 0 for x in answers.agg(*(F.sum(k) for k in _TOTALS)).first())
    counts = Counts(n + ends, v + (ends > 0), ends, n1, n2)
    n_groups = max(1, min(shards(spark), size >> 20), 2 * counts.n // shard_tokens)
    blocks = answers.where("block is not null").drop(*_TOTALS)
    known = f"ids array<{kind}>, held binary, n_tokens binary, n_known binary, bases binary, scores binary"
    events = blocks.mapInArrow(lambda batches: _events(batches, counts, n_groups, hot), f"shard long, block string, events binary, {known}").groupBy("shard")
    schema = f"block string, sums binary, {known}"
    with arrow_batches(spark, 2):  # a row is a whole block
        if hot_words or ends > hot:
            pairs = blocks.mapInArrow(lambda batches: _hot_pairs(batches, counts, n_groups, hot), "shard long, near long, token long, count long, n long")
            scored = events.cogroup(saved(_shared(pairs)).groupBy("shard")).applyInArrow(lambda rows, shared: _scored(rows, counts, shared), schema)
        else:
            scored = events.applyInArrow(lambda rows: _scored(rows, counts), schema)
        out = saved(scored.groupBy("block").applyInArrow(_combined, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"))
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(counts.n + counts.v + 1.0)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") if counts.n else base).alias("score"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
