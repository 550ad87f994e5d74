"""SentencePiece encoding and decoding with a given vocabulary, by a batched numpy Viterbi.

The vocabulary's model is of the BPE kind, whose scores rank merges; a path of greatest summed score is not what the
merges give. The lattice therefore scores transitions instead: two pieces may follow each other only if merging the
characters of both gives just these two. Merges inside a part of a text are those of the part alone, so exactly one
piece can end the best path at each place, and the path found is the merges' own result. Words of equal length advance
together: at each end place and piece length, hashes of the substrings of all words probe the sorted keys of the
pieces, and a maximum over the allowed ones stores the backpointers. A pair's verdict is worked out once by merging its
few characters and kept. Characters without a piece become their UTF-8 bytes.

Texts are cut where no merge can reach: at a blank, and between two characters that stand side by side in no piece.

Defined cases: a null or empty text has no tokens and decodes to the empty text. Decoding undoes encoding exactly, save that
U+2581, which the vocabulary uses for a blank, comes back as one. Invalid bytes decode to U+FFFD. Of paths of equal
score (ties) the one with the earlier merge wins, as in the library. A very long text, or word, is encoded whole. Repeated rows
are each encoded; an empty table gives no rows; other columns, whatever their names, are not read. No tokenizer is trained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean, mix, pieces, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Texts are encoded in pieces of so many bytes, or one text.
CHUNK_BYTES = 1 << 21
_CACHE = 500_000
#: Verdicts on pairs of pieces that a codec keeps.
_PAIRS = 4_000_000
_M = 0x9E3779B97F4A7C15 | 1
_NEVER = -float("inf")


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, end to end."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)[: len(start)], size) + np.arange(size.sum())


def read_model(path: str = MODEL) -> list[tuple[str, float, str]]:
    """Piece, score and kind (normal, byte or other) by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]) -> None:
        self.size = len(vocabulary)
        self.score = {p: s for p, s, k in vocabulary if k == "normal"}
        self.ids = {p: i for i, (p, _, k) in enumerate(vocabulary) if k == "normal"}
        self.names = [p for p, _, _ in vocabulary]
        self.bytes = np.zeros(256, np.int32)
        self.raw = [p.replace(BLANK, " ").encode() if k == "normal" else b"" for p, _, k in vocabulary]
        for i, (p, _, k) in enumerate(vocabulary):
            if k == "byte":
                self.bytes[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece goes on after a blank")
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.longest = max(map(len, self.ids), default=1)
        keys = {}
        for p, i in self.ids.items():
            h = 0
            for c in p:
                h = (h * _M + self._symbol(ord(c))) % (1 << 64)
            keys.setdefault((h + len(p) * 0x51ED27) % (1 << 64), []).append(i)
        hashed = mix(np.array(list(keys), np.uint64))
        order = np.argsort(hashed)
        self.keys, self.key_ids = hashed[order], np.array([v[0] for v in keys.values()], np.int64)[order]
        self.codes = np.zeros((self.size, self.longest), np.uint32)
        for p, i in self.ids.items():
            self.codes[i, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        self.span = self.size + 0x110000
        self.spelled: dict[int, np.ndarray] = {}
        self._forget_pairs()
        self.beside_keys = np.sort(np.array([(ord(a) << 21) | ord(b) for a, b in self.beside] or [-1], np.int64))
        self._forget()

    def _forget(self) -> None:
        """Empties the memory of words (word_at: place in word_start and word_size) and of units (by hash); both point into the pool."""
        self.word_at: dict[str, int] = {}
        self.word_start, self.word_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.unit_keys, self.unit_start, self.unit_size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _forget_pairs(self) -> None:
        self.pair_keys, self.pair_ok = np.array([np.iinfo(np.int64).max]), np.zeros(1, bool)  # the last is a guard

    @staticmethod
    def _symbol(c):
        return c * 0x2545F4914F6CDD1D % (1 << 64) if isinstance(c, int) else c.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)

    def _stays(self, text: str, cut: int) -> bool:
        """Whether merging (best score first, the leftmost of equals) makes two symbols of text that meet at cut; at 0: one symbol."""
        at, score = list(text), self.score
        ends = list(range(1, len(at) + 1))
        scores = [score.get(a + b, _NEVER) for a, b in zip(at, at[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == _NEVER:
                break
            i = scores.index(best)
            if ends[i] == cut:
                return False
            at[i : i + 2] = [at[i] + at[i + 1]]
            del ends[i], scores[i]
            if i:
                scores[i - 1] = score.get(at[i - 1] + at[i], _NEVER)
            if i < len(scores):
                scores[i] = score.get(at[i] + at[i + 1], _NEVER)
        return len(at) == (2 if cut else 1)

    def _name(self, symbol: int) -> str:
        return self.names[symbol] if symbol < self.size else chr(symbol - self.size)

    def _allowed(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Whether symbol may follow before (-1: the start)."""
        keys = (before + 1) * self.span + symbol
        at = np.searchsorted(self.pair_keys[:-1], keys)
        missing = self.pair_keys[at] != keys
        if missing.any():
            new, ok = np.unique(keys[missing]), []
            for k in new.tolist():
                a, b = divmod(k, self.span)
                parts = ([self._name(a - 1)] if a else []) + [self._name(b)]
                ok.append(self._stays("".join(parts), len(parts[0]) if a else 0))
            where = np.searchsorted(self.pair_keys, new)
            self.pair_keys, self.pair_ok = np.insert(self.pair_keys, where, new), np.insert(self.pair_ok, where, ok)
            at = np.searchsorted(self.pair_keys[:-1], keys)
        return self.pair_ok[at]

    def _paths(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of units of one length (code points by row), end to end, and how many each has."""
        n, size = code.shape
        sums, powers = np.zeros((n, size + 1), np.uint64), [np.uint64(pow(_M, k, 1 << 64)) for k in range(self.longest + 1)]
        for i in range(size):
            sums[:, i + 1] = sums[:, i] * np.uint64(_M) + self._symbol(code[:, i])
        last, back = np.full((n, size + 1), -1, np.int64), np.zeros((n, size + 1), np.int32)
        probes: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(size + 1)]
        for k in range(1, min(size, self.longest) + 1):
            h = mix((sums[:, k:] - sums[:, :-k] * powers[k] + np.uint64(k * 0x51ED27)).T.ravel())
            at = np.searchsorted(self.keys[:-1], h)
            hit = np.flatnonzero(self.keys[at] == h) if k > 1 else np.arange(len(h))
            symbol = self.key_ids[at[hit]]
            end, row = np.divmod(hit, n)
            same = (self.codes[symbol, :k] == np.lib.stride_tricks.sliding_window_view(code, k, axis=1)[row, end]).all(axis=1)
            if k == 1:
                symbol = np.where(same & (self.keys[at] == h), symbol, self.size + code.T.ravel().astype(np.int64))
            else:
                symbol, end, row = symbol[same], end[same], row[same]
            cuts = np.searchsorted(end, np.arange(size - k + 2))
            for e in range(size - k + 1):
                if cuts[e] < cuts[e + 1]:
                    probes[e + k].append((k, row[cuts[e] : cuts[e + 1]], symbol[cuts[e] : cuts[e + 1]]))
        for end in range(1, size + 1):
            rows, symbol = (np.concatenate([p[i] for p in probes[end]]) for i in (1, 2))
            k = np.repeat([p[0] for p in probes[end]], [len(p[1]) for p in probes[end]])
            allowed = np.where(self._allowed(last[rows, end - k], symbol), k, 0)
            np.maximum.at(back[:, end], rows, allowed)
            best = (allowed > 0) & (allowed == back[rows, end])
            last[rows[best], end] = symbol[best]
        end, rows, parts, step = np.full(n, size), np.arange(n), [], 0
        while len(rows):  # back from the ends, all units together
            parts.append((rows, np.full(len(rows), -step), last[rows, end[rows]]))
            end[rows] -= back[rows, end[rows]]
            rows, step = rows[end[rows] > 0], step + 1
        row, place, symbol = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((place, row))
        row, symbol = row[order], symbol[order]
        for u in np.unique(symbol[symbol >= self.size]).tolist():
            self.spelled[u] = self.bytes[list(chr(u - self.size).encode())]
        if (symbol >= self.size).any():
            expanded = [self.spelled[u] if u >= self.size else np.array([u], np.int32) for u in symbol.tolist()]
            row, symbol = np.repeat(row, [len(x) for x in expanded]), np.concatenate(expanded)
        return symbol.astype(np.int32), np.bincount(row, minlength=n)

    def _learn(self, words: list[str]) -> None:
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]])
        pair = (code[:-1] << 21) | code[1:]
        cut = np.ones(len(code), bool)
        cut[1:] = self.beside_keys[np.minimum(np.searchsorted(self.beside_keys, pair), len(self.beside_keys) - 1)] != pair
        cut[begins] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(code))
        up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(code), _M, np.uint64)]))
        down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(code), pow(_M, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self._symbol(code) * down[:-1])])
        key = mix((sums[end] - sums[start]) * up[end] + (end - start).astype(np.uint64))
        distinct, first = np.unique(key, return_index=True)
        new = first[~np.isin(distinct, self.unit_keys, assume_unique=True)]
        by_size = new[np.argsort(end[new] - start[new], kind="stable")]
        sizes, ids, counts, keys = end[by_size] - start[by_size], [], [], []
        for size in np.unique(sizes):
            own = by_size[sizes == size]
            step = max(1, (1 << 20) // (int(size) + 1))
            for i in range(0, len(own), step):
                flat, n = self._paths(code[start[own[i : i + step]][:, None] + np.arange(size)].astype(np.uint32))
                ids.append(flat)
                counts.append(n)
                keys.append(key[own[i : i + step]])
        if keys:
            counts, keys = np.concatenate(counts), np.concatenate(keys)
            starts = len(self.pool) + np.concatenate([[0], np.cumsum(counts)[:-1]])
            self.pool = np.concatenate([self.pool, *ids])
            all_keys = np.concatenate([self.unit_keys, keys])
            order = np.argsort(all_keys)
            self.unit_keys = all_keys[order]
            self.unit_start, self.unit_size = np.concatenate([self.unit_start, starts])[order], np.concatenate([self.unit_size, counts])[order]
        at = np.searchsorted(self.unit_keys, key)
        tokens = self.pool[_spread(self.unit_start[at], self.unit_size[at])]
        size = np.add.reduceat(self.unit_size[at], np.searchsorted(start, begins))
        self.word_start = np.concatenate([self.word_start, len(self.pool) + np.concatenate([[0], np.cumsum(size)[:-1]])])
        self.word_size, self.pool = np.concatenate([self.word_size, size]), np.concatenate([self.pool, tokens])
        self.word_at.update(zip(words, range(len(self.word_at), len(self.word_at) + len(words)), strict=True))

    @staticmethod
    def split(text: str) -> list[str]:
        """Words with the blanks before them; the text gets a blank in front."""
        if not text:
            return []
        if "  " not in text and text[0] != " " and text[-1] != " " and BLANK not in text:
            return [BLANK + w for w in text.split(" ")]
        out, blanks = [], 1
        for w in text.replace(BLANK, " ").split(" "):
            if w:
                out.append(BLANK * blanks + w)
                blanks = 0
            blanks += 1
        return [*out, BLANK * (blanks - 1)] if blanks > 1 else out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids, and where each text's begin and the last's end."""
        split = [self.split(t or "") for t in texts]
        flat = [w for ws in split for w in ws]
        new = list(set(flat).difference(self.word_at))
        if len(self.word_at) + len(new) > _CACHE:
            self._forget()
            new = list(set(flat))
        if len(self.pair_keys) > _PAIRS:
            self._forget_pairs()
        if new:
            self._learn(new)
        at = np.fromiter(map(self.word_at.__getitem__, flat), np.int64, len(flat))
        size = self.word_size[at]
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        words_at = np.concatenate([[0], np.cumsum([len(ws) for ws in split], dtype=np.int64)]).astype(np.int64)
        return self.pool[_spread(self.word_start[at], size)], ends[words_at]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join(map(raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def kept_codec(held: dict) -> Codec:
    """The codec of a broadcast {"vocabulary": ...}. It stays there, with the words it knows, so that a worker's later tasks find it."""
    if "codec" not in held:
        held["codec"] = Codec(held["vocabulary"])
    return held["codec"]


def tokenize(docs: DataFrame, text_col: str = "text", model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, and: ids array<int>, n_tokens, decoded_sha256 (of the text that the ids decode to), round_trip (it is the text)."""
    shared = docs.sparkSession.sparkContext.broadcast({"vocabulary": read_model(model)})
    rows = docs.select(*keep, F.col(text_col).alias(fresh("text")[0]))
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["ids array<int>", "n_tokens long", "decoded_sha256 string", "round_trip boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_codec(shared.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(len(keep))), 0).to_pylist()
            for a, b in pieces(sizes, CHUNK_BYTES):
                texts = batch.column(len(keep)).slice(a, b - a).to_pylist()
                ids, at = codec.encode(texts)
                back = [codec.decode(ids[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                columns = [
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                    pa.array([t == (o or "") for t, o in zip(back, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), *columns], names=[*keep, "ids", "n_tokens", "decoded_sha256", "round_trip"])

    return rows.mapInArrow(lean(run), schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"))
