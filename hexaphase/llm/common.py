"""What the operators share: tables, the shared folder, white space, and hashes of words as arrays."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, and its complement, as Java regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.translate tables: A-Z to lower case; and also all white space to one blank.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LOWER_BLANK = bytes(32 if c in b"\t\n\v\f\r" else LOWER[c] for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = getattr(shared_dir, "own", None) or f"file://{tempfile.mkdtemp(prefix='hexaphase-')}"
        shared_dir.own = where
    return where


_WRITTEN: list[str] = []


def clean(spark: SparkSession) -> int:
    """Deletes the tables that saved() wrote since the last call, once what was made of them is written elsewhere; how many."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def saved(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df, written once to the shared folder as Parquet and read back: its lineage is cut, and lost executors cost nothing. It is read without vectored I/O, whose threads would each keep buffers outside the heap as large as their largest read."""
    path = f"{shared_dir(df.sparkSession)}/hexaphase-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.option("parquet.hadoop.vectored.io.enabled", "false").schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Inside, batches between the JVM and Python hold rows rows at most: whole texts in them are in memory twice. Afterwards the session is as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) > rows or int(before) <= 0:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Gives memory that this process has freed back to the system: Spark keeps Python workers for later stages, with all they ever held at once."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow(), in a worker that gives back what earlier tasks and this one have freed."""

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return given


def input_bytes(text_col: str) -> Column:
    """Aggregate: how many bytes the texts have."""
    return F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("long")


def fresh(*names: str) -> list[str]:
    """Column names that no table of a caller has."""
    tag = uuid.uuid4().hex
    return [f"{name}_{tag}" for name in names]


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


#: Keys that make up more than one in this many rows join by broadcast: no more than this many can.
HOT_KEYS = 4096


def join_keyed(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined with keyed, whose keys are distinct, on keys; weight: how many rows have the key. Hot keys are broadcast, so that none gathers in a task."""
    hot = keyed.agg(F.sum(weight)).first()[0] or 0
    heavy = keyed.where(F.col(weight) > hot / HOT_KEYS).drop(weight)
    light = keyed.where(F.col(weight) <= hot / HOT_KEYS).drop(weight)
    if hot < HOT_KEYS:  # every key would be hot, and there are few rows
        return rows.join(keyed.drop(weight), keys, how)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light.hint("merge"), keys, how)
    return rows.join(F.broadcast(heavy), keys).unionByName(rest)


def shards(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit hangs on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class RangeHash:
    """Hashes of any byte ranges of a buffer from prefix sums modulo 2**64; equal bytes have equal hashes wherever they stand."""

    _powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, buf: np.ndarray) -> None:
        n = len(buf) + 1
        if RangeHash._powers is None or len(RangeHash._powers[0]) < n:
            size = 1 << int(n - 1).bit_length()
            one = np.ones(1, np.uint64)
            up = np.concatenate([one, np.full(size - 1, _MULT, np.uint64)])
            down = np.concatenate([one, np.full(size - 1, _INV, np.uint64)])
            RangeHash._powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.up, down = RangeHash._powers
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_TABLE[buf] * down[: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[end] + (end - start).astype(np.uint64))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without white space."""
    solid = np.empty(len(buf) + 2, np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashed_words(texts: list[bytes], to: bytes, slice_bytes: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, translated by the table to, and each one's text. Hashes are made in slices that end between words."""
    joined = np.frombuffer(b"\n".join(texts).translate(to), np.uint8)
    start, end = word_bounds(joined)
    hashes, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + slice_bytes, side="right")))
        a = start[i]
        hashes[i:j] = RangeHash(joined[a : end[j - 1]])(start[i:j] - a, end[i:j] - a)
        i = j
    return hashes, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")


def pieces(sizes: list[int], limit: int):
    """Ranges of consecutive items whose sizes sum to about limit, one item at least in each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
