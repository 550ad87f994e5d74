"""Removal of repeated 100-byte strings by a partitioned sparse suffix array.

Anchors: in every window of LENGTH bytes, the place whose GRAM bytes have the least hash (the leftmost of equals) is its anchor; equal
windows have it at the same place, so windows can only be equal if their anchors' grams are. About one place in thirty
is an anchor; the suffixes that start at anchors are the array.

Tokens of a suffix: its first eight bytes, its gram, and the string that the anchor's windows cover (128 bits of hash, over
its bytes). Splitters over all three, from a bounded sample of anchors, range-partition the suffixes, so that neither common
beginnings nor common grams gather in a bucket. A bucket sorts its suffixes by these tokens, one after the other inside ties only,
and compares neighbours: of those alike in all tokens the first by (doc_id, start) stays and the others are marked. Whole
copies end here.

The others may still share windows with suffixes of the same gram. Those whose gram has another string in their bucket, or
reaches the bucket's boundary, come back with their bytes: a Bloom filter of their places, sized by their number and of
128 MB at most, lets them through, and may only err towards sending. They are range-partitioned by (first bytes, gram), so that
a gram's suffixes meet in one bucket, which sorts suffixes by multikey quicksort (eight bytes at a time, going on inside ties only)
and the reversed prefixes likewise, and compares neighbours: the lengths of their common beginnings give, for each distance
between window and anchor, the classes of equal windows. In each class the first by (doc_id, start) stays and the others are
marked.

Before it sends anything, a task marks the strings of a chunk of texts that stand earlier in the chunk: a passage that a
third of all rows share costs one string per chunk, and marks.

Finally the marks meet their documents, shard by shard, and each byte under a marked window goes. Buckets and shards are as many
as the input's bytes ask for.

Defined cases: null or empty texts have no bytes; texts under LENGTH bytes keep all; a very long text is one chunk. doc_id
names a document: rows alike in doc_id and text are one document, reported for each row; rows of one doc_id with different
texts follow each other by a hash of the text. Null doc_ids count as
-2**63. Copies that tie in all of this are one document. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RangeHash, arrow_batches, input_bytes, mix, pieces, saved, shards, table

LENGTH, GRAM = 100, 40
CHUNK_BYTES = 1 << 19
#: Bits of the filter for each place, and of the whole at most, as a power of two.
PLACE_BITS, MOST_FILTER_BITS, SLICE_BITS = 8, 30, 16
#: Input bytes for each bucket and shard, and documents in the sample for splitters.
BUCKET_BYTES, SAMPLE = 1 << 23, 4000
_REACH = LENGTH - GRAM


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows within texts: their runs of one anchor. Anchor, first and last window of each run, hash of the anchor's gram."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    grams = len(buf) - GRAM + 1
    hashes = RangeHash(buf)(np.arange(grams), np.arange(GRAM, len(buf) + 1))
    bits = max(1, int(len(buf)).bit_length())
    low = np.uint64((1 << bits) - 1)
    least = (hashes & ~low) | np.arange(grams, dtype=np.uint64)
    width, want = 1, _REACH + 1
    while width < want:  # minima over ever wider windows
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    anchor = (least & low).astype(np.int64)
    text = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + LENGTH <= ends[text]
    change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])]))
    last = np.append(change[1:], n) - 1
    ok = inside[change]
    first, last = change[ok], last[ok]
    return anchor[first], first, last, hashes[anchor[first]]


def _joined(batch: pa.RecordBatch, column: int):
    """Chunks of the batch's texts: first row, next chunk's first row, their bytes in one array, and where each ends."""
    texts = [t or b"" for t in batch.column(column).to_pylist()]
    for a, b in pieces([len(t) for t in texts], CHUNK_BYTES):
        yield a, b, np.frombuffer(b"".join(texts[a:b]), np.uint8), np.cumsum([len(t) for t in texts[a:b]])


def _leading(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | buf[at + k]
    return out


def _sampled(batches: Iterator[pa.RecordBatch], per_text: int = 16) -> Iterator[pa.RecordBatch]:
    """Tokens of some anchors of each text: first bytes, gram, first half of the string's hash."""
    for batch in batches:
        for _, _, buf, ends in _joined(batch, 0):
            at, first, last, gram = anchors(buf, ends)
            some = np.sort(np.argsort(mix(gram))[: per_text * len(ends)])
            names = _named_strings(buf, at[some], first[some], last[some])
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (_leading(buf, at[some]), gram[some], names[:, 0])], names=["lead", "gram", "string"])


def _named_strings(buf: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """128 bits for the bytes that each anchor's windows cover, and for where in them the anchor is."""
    view = memoryview(buf)
    digests = b"".join([xxhash.xxh3_128_digest(view[f:e]) for f, e in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)])
    out = np.frombuffer(digests, np.uint64).reshape(-1, 2).copy()
    out[:, 0] += (at - first).astype(np.uint64)
    return out


class Splitters:
    """Tokens of suffixes that part the buckets, ascending."""

    def __init__(self, rows: list[tuple[int, ...]], buckets: int) -> None:
        rows = sorted(set(rows))
        cut = sorted({i * len(rows) // buckets for i in range(1, buckets)}) if rows else []
        self.tokens = np.array([rows[i] for i in cut], np.uint64).reshape(len(cut), len(rows[0]) if rows else 1)

    def __call__(self, *tokens: np.ndarray) -> np.ndarray:
        """Buckets: how many splitters are not above."""
        first = self.tokens[:, 0] if len(self.tokens) else np.zeros(0, np.uint64)
        low, high = (np.searchsorted(first, tokens[0], side=s) for s in ("left", "right"))
        out = low.astype(np.int64)
        for lead in np.unique(tokens[0][high > low]):  # first tokens that are a splitter's too
            at = np.flatnonzero(tokens[0] == lead)
            for j in range(low[at[0]], high[at[0]]):
                above, same = np.zeros(len(at), bool), np.ones(len(at), bool)
                for x, t in zip(tokens[1:], self.tokens[j, 1:], strict=False):
                    above |= same & (x[at] > t)
                    same &= x[at] == t
                out[at] += above | same
        return out


def _shard(doc: np.ndarray, text_hash: np.ndarray, n: int) -> np.ndarray:
    """As _SHARD in SQL: copies of a text spread by their ids."""
    return (np.mod(text_hash, 1 << 31) + np.mod(doc, 1 << 31)) % n


_SHARD = "cast(pmod(pmod(hash, 2147483648L) + pmod(doc, 2147483648L), {n}L) as int)"
_MARKS = [("shard", pa.int32()), ("slice", pa.int32()), ("data", pa.binary())]
_MARKS_SQL = "shard int, slice int, data binary"


def _packed(doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray, windows: np.ndarray, n: int) -> list[tuple[int, None, bytes]]:
    """Runs of marked windows by shard of documents: doc, hash, first window and number of windows."""
    columns = np.stack([np.asarray(x, np.int64) for x in (doc, text_hash, start, windows)], axis=1)
    shard = _shard(columns[:, 0], columns[:, 1], n)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n + 1))
    return [(s, None, columns[order[a:b]].tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(fields)})


class PlaceFilter:
    """A Bloom filter of one hash, whose bits are as many as PLACE_BITS for each place asks for."""

    def __init__(self, bits: int) -> None:
        self.bits, self.data = bits, np.zeros(1 << (bits - 3), np.uint8)

    def through(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be in it."""
        at = keys >> np.uint64(64 - self.bits)
        return np.flatnonzero((self.data[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1)


def _place(doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of a place in the corpus."""
    return mix(mix(doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + text_hash.astype(np.uint64)) + start.astype(np.uint64))


_CLASSES = [("bucket", pa.int32()), ("lead", pa.int64()), ("gram", pa.int64()), ("string", pa.int64()), ("string2", pa.int64()), ("doc", pa.int64()), ("hash", pa.int64()), ("start", pa.int64()), ("windows", pa.int32())]
_CLASSES_SQL = "bucket int, lead long, gram long, string long, string2 long, doc long, hash long, start long, windows int"
_STRINGS = [("bucket", pa.int32()), ("doc", pa.int64()), ("hash", pa.int64()), ("start", pa.int64()), ("left", pa.int32()), ("windows", pa.int32()), ("bytes", pa.binary())]


def _runs(batches: Iterator[pa.RecordBatch]):
    """Per chunk the strings around anchors: bytes, document, hash of its text, place, anchor, windows, gram."""
    for batch in batches:
        doc_ids, text_hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for a, _, buf, ends in _joined(batch, 2):
            at, first, last, gram = anchors(buf, ends)
            text = np.searchsorted(ends, first, side="right")
            start = first - np.concatenate([[0], ends[:-1]])[text] if len(text) else first
            if len(text):
                yield buf, doc_ids[a + text], text_hashes[a + text], start, at, first, last, gram


def _classes(batches: Iterator[pa.RecordBatch], splitters: Splitters, n: int) -> Iterator[pa.RecordBatch]:
    """Suffixes as tokens, by bucket; those whose string stands earlier in the same chunk too go without them, as marks."""
    for buf, doc, text_hash, start, at, first, last, gram in _runs(batches):
        names = _named_strings(buf, at, first, last)
        order = np.lexsort((start, text_hash, doc, names[:, 1], names[:, 0], gram))
        doc, text_hash, start, gram, names, at, windows = (x[order] for x in (doc, text_hash, start, gram, names, at, last - first + 1))
        head = np.concatenate([[True], (gram[1:] != gram[:-1]) | (names[1:] != names[:-1]).any(axis=1)])
        leader = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        later = (doc != doc[leader]) | (text_hash != text_hash[leader]) | (start != start[leader])
        lead = _leading(buf, at[head])
        bucket = splitters(lead, gram[head], names[head, 0]).astype(np.int32)
        nothing = pa.nulls(int(later.sum()), pa.int64())
        columns = [k for k, _ in _CLASSES]
        tokens = (lead.view(np.int64), gram[head].view(np.int64), *(names[head, i].copy().view(np.int64) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, *tokens, doc[head], text_hash[head], start[head], windows[head].astype(np.int32))], names=columns)
        yield pa.RecordBatch.from_arrays([pa.array(np.mod(doc[later], n).astype(np.int32)), *[nothing] * 4, *(pa.array(x[later]) for x in (doc, text_hash, start, windows.astype(np.int32)))], names=columns)


def token_sort(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by their tokens, further ones only where all before are equal; and of neighbours in it, how many tokens they share."""
    order = np.argsort(tokens[0], kind="stable")
    common = np.zeros(max(0, len(order) - 1), np.int64)
    for depth, x in enumerate(tokens):
        if depth:
            same = common == depth
            if not same.any():
                break
            tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            group = np.cumsum(np.concatenate([[True], ~same]))[tied]
            part = order[tied]
            order[tied] = part[np.lexsort((x[part], group))]
        alike = common == depth
        common[alike] += x[order[1:][alike]] == x[order[:-1][alike]]
    return order, common


def _first_of_classes(rows: pa.Table, n: int) -> pa.Table:
    """Of one bucket: marks on all suffixes alike but the first; and the places of the first ones whose gram has other strings, or reaches the bucket's boundary."""
    met = rows.filter(pc.is_null(rows.column("gram")))
    rows = rows.filter(pc.is_valid(rows.column("gram")))
    marks = [np.stack([met.column(k).to_numpy().astype(np.int64) for k in ("doc", "hash", "start", "windows")])]
    places = np.zeros(0, np.uint64)
    if len(rows):
        tokens = [rows.column(k).to_numpy().view(np.uint64) for k in ("lead", "gram", "string", "string2")]
        doc, text_hash, start, windows = (rows.column(k).to_numpy() for k in ("doc", "hash", "start", "windows"))
        order, common = token_sort(tokens)
        doc, text_hash, start, windows = (x[order] for x in (doc, text_hash, start, windows))
        number = np.cumsum(np.concatenate([[0], common < len(tokens)]))
        order = np.lexsort((start, text_hash, doc, number))  # within a class the first in the corpus leads
        doc, text_hash, start, windows = (x[order] for x in (doc, text_hash, start, windows))
        head = np.concatenate([[True], common < len(tokens)])
        leader = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        later = (doc != doc[leader]) | (text_hash != text_hash[leader]) | (start != start[leader])  # rows alike are one document
        marks.append(np.stack([x[later].astype(np.int64) for x in (doc, text_hash, start, windows)]))
        group = np.cumsum(np.concatenate([[0], common < 2]))  # of one gram
        several = np.bincount(group, head)[group] > 1
        several |= (group == 0) | (group == group[-1])
        lead = head & several
        places = _place(doc[lead], text_hash[lead], start[lead])
    return _table([*_packed(*np.concatenate(marks, axis=1), n), (None, 0, places.tobytes())], _MARKS)


def _strings(batches: Iterator[pa.RecordBatch], places: PlaceFilter, splitters: Splitters) -> Iterator[pa.RecordBatch]:
    """Strings with their bytes, by bucket of the suffixes at their anchors: those that the filter lets through."""
    for buf, doc, text_hash, start, at, first, last, gram in _runs(batches):
        keep = places.through(_place(doc, text_hash, start))
        if len(keep):
            raw, bucket = buf.tobytes(), splitters(_leading(buf, at[keep]), gram[keep])
            columns = bucket.astype(np.int32), doc[keep], text_hash[keep], start[keep], (at - first)[keep].astype(np.int32), (last - first + 1)[keep].astype(np.int32), [raw[f:e] for f, e in zip(first[keep].tolist(), (last + LENGTH)[keep].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _STRINGS, strict=True)], names=[k for k, _ in _STRINGS])


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """The order of byte strings of equal length, a multiple of eight: by eight bytes at a time, further ones only where all before are equal."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    same = words[order[1:], 0] == words[order[:-1], 0]
    for k in range(1, words.shape[1]):
        if not same.any():
            break
        tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        group = np.cumsum(np.concatenate([[True], ~same]))[tied]
        part = order[tied]
        order[tied] = part[np.lexsort((words[part, k], group))]
        same[same] = words[order[1:][same], k] == words[order[:-1][same], k]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of neighbours in the order: how many leading bytes are equal."""
    differ = rows[order[1:]] != rows[order[:-1]]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in strings), np.uint8).reshape(len(strings), width)


def _marks(rows: pa.Table, shards_: int) -> pa.Table:
    """Of one bucket: the windows that start earlier too."""
    doc, text_hash, start, left, windows = (rows.column(k).to_numpy() for k in ("doc", "hash", "start", "left", "windows"))
    anchor = start + left
    order = np.lexsort((anchor, text_hash, doc))
    d, h, x = doc[order], text_hash[order], anchor[order]
    if len(order):  # rows alike are one document
        order = order[np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (x[1:] != x[:-1])])]
    doc, text_hash, anchor, left, windows = (v[order] for v in (doc, text_hash, anchor, left.astype(np.int64), windows.astype(np.int64)))
    strings = [rows.column("bytes")[int(i)].as_py() for i in order]
    n = len(strings)
    suffixes = _matrix([s[k:] for s, k in zip(strings, left.tolist(), strict=True)], -(-LENGTH // 8) * 8)
    prefixes = _matrix([s[:k][::-1] for s, k in zip(strings, left.tolist(), strict=True)], -(-(_REACH + 1) // 8) * 8)
    by_suffix, by_prefix = multikey_sort(suffixes), multikey_sort(prefixes)
    suffix_common, prefix_common = common_prefixes(suffixes, by_suffix), common_prefixes(prefixes, by_prefix)

    def classes(by: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[by] = np.concatenate([[0], np.cumsum(common < depth)])
        return out

    marked = np.zeros((n, _REACH + 3), bool)  # by distance from window to anchor, with an unmarked column at either side
    for o in range(_REACH + 1):
        own = np.flatnonzero((o <= left) & (left - o < windows))
        if len(own) > 1:
            key = classes(by_suffix, suffix_common, LENGTH - o)[own] * (n + 1) + classes(by_prefix, prefix_common, o)[own]
            later = np.ones(len(own), bool)
            later[np.unique(key, return_index=True)[1]] = False
            marked[own[later], o + 1] = True
    edge = np.diff(marked.astype(np.int8), axis=1)
    r, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return _table(_packed(doc[r], text_hash[r], anchor[r] - (high - 1), high - low, shards_), _MARKS)


def _removed(start: np.ndarray, windows: np.ndarray, n: int) -> np.ndarray:
    """Which bytes lie under marked windows."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + windows - 1 + LENGTH, -1)
    return np.cumsum(step[:n]) > 0


def _place_filter(known: DataFrame) -> PlaceFilter:
    """Of the places in column data. The driver holds the filter's bits, and not the places."""
    total = known.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    out = PlaceFilter(max(SLICE_BITS, min(MOST_FILTER_BITS, (total // 8 * PLACE_BITS).bit_length())))
    shift, size = 64 - out.bits, 1 << (SLICE_BITS - 3)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                bit = np.unique((np.frombuffer(data.as_buffer(), np.uint64) >> np.uint64(shift)).astype(np.int64))
                part = bit >> SLICE_BITS
                for k in np.unique(part):
                    own = (bit[part == k] & ((1 << SLICE_BITS) - 1)).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["slice", "data"])

    def joined(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << SLICE_BITS, np.uint8)
        for x in rows.column("data"):
            bits[np.frombuffer(x.as_buffer(), np.uint16)] = 1
        return pa.table({"slice": pa.array([rows.column("slice")[0].as_py()], pa.int32()), "data": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    for r in known.select("data").mapInArrow(sliced, "slice int, data binary").groupBy("slice").applyInArrow(joined, "slice int, data binary").toLocalIterator():
        out.data[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["data"], np.uint8)
    return out


def marked_runs(docs: DataFrame, n: int) -> DataFrame:
    """shard, data: runs of marked windows, by one of n shards of documents; of docs with doc and hash (longs that name a text) and text (binary)."""
    spark = docs.sparkSession
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.where(F.expr(f"pmod(xxhash64(hash, doc, 11), 1000000) < {math.ceil(share * 1_000_000)}")).select("text")
    sample = [tuple(x % (1 << 64) for x in r) for r in some.mapInArrow(_sampled, "lead long, gram long, string long").collect()]  # SAMPLE texts, a few anchors each
    by_string, by_gram = Splitters(sample, n), Splitters([x[:2] for x in sample], n)
    classes = docs.mapInArrow(lambda b: _classes(b, by_string, n), _CLASSES_SQL).repartition(n, "bucket")
    firsts = saved(classes.groupBy("bucket").applyInArrow(lambda rows: _first_of_classes(rows, n), _MARKS_SQL))
    places = spark.sparkContext.broadcast(_place_filter(firsts.where("shard is null")))
    strings = docs.mapInArrow(lambda b: _strings(b, places.value, by_gram), "bucket int, doc long, hash long, start long, left int, windows int, bytes binary").repartition(n, "bucket")
    marks = strings.groupBy("bucket").applyInArrow(lambda rows: _marks(rows, n), _MARKS_SQL)
    return marks.unionByName(firsts.where("shard is not null")).select("shard", "data")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_bytes: kept, the bytes that stay, too."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("_t").alias("hash"), F.col("_t").cast("binary").alias("text"))
    n = max(shards(docs.sparkSession), rows.agg(input_bytes("text")).first()[0] // BUCKET_BYTES)
    with arrow_batches(docs.sparkSession):
        marks = saved(marked_runs(rows.select("doc", "hash", "text"), n))
    shard = F.expr(_SHARD.format(n=n))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 if with_bytes else 4]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(types)]

    def finish(own: pa.Table, runs: pa.Table) -> pa.Table:
        found = np.concatenate([np.zeros((0, 4), np.int64), *(np.frombuffer(x.as_py(), np.int64).reshape(-1, 4) for x in runs.column("data"))])
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        begin = np.flatnonzero(np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])) if len(found) else np.zeros(0, np.int64)
        where = {(int(found[i, 0]), int(found[i, 1])): (i, j) for i, j in zip(begin, np.append(begin[1:], len(found)), strict=False)}
        out = []
        for doc, text_hash, text in zip(*(own.column(k) for k in ("doc", "hash", "text")), strict=True):
            text = text.as_py()
            i, j = where.get((doc.as_py(), text_hash.as_py()), (0, 0))
            gone = _removed(found[i:j, 2], found[i:j, 3], len(text)) if j else np.zeros(0, bool)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if j else text
            spans = np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1) if j else 0
            out.append((len(text), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest(), kept))
        return pa.table([own.column("doc_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names=["doc_id", *names])

    both = rows.withColumn("shard", shard).repartition(n, "shard").groupBy("shard").cogroup(marks.repartition(n, "shard").groupBy("shard"))
    return both.applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
