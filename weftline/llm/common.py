"""Shared pieces: written tables in the cluster's shared folder, and NumPy kernels over whole Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTES_AT_ONCE = 2 << 20


def scratch(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is named, a local one does for a local master only: executors elsewhere would write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or f"file://{tempfile.gettempdir()}/weftline-checkpoints"


#: Whole texts travel in Arrow batches, so these hold fewer rows than by default.
STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_LOCK, _ENTERED = threading.Lock(), {}  # sessions inside step_settings: how often, and the settings before


@contextlib.contextmanager
def step_settings(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside are removed when each write ends, so that disk holds one step at a time; Arrow batches are small. Queries that run at once share the settings: the last one to leave restores them."""
    with _LOCK:
        times, before = _ENTERED.get(id(spark), (0, {k: spark.conf.get(k, None) for k in STEP}))
        _ENTERED[id(spark)] = (times + 1, before)
        for k, v in STEP.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _LOCK:
            times, before = _ENTERED.pop(id(spark))
            if times > 1:
                _ENTERED[id(spark)] = (times - 1, before)
            else:
                for k, v in before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_REMEMBERED: dict[str, dict] = {}


def remembered(name: str) -> dict:
    """What an operator remembers in this Python worker from task to task."""
    return _REMEMBERED.setdefault(name, {})


def forget(but: str | None) -> None:
    for name, known in _REMEMBERED.items():
        if name != but:
            known.clear()


def tidy(run: Callable, keep: str | None = None) -> Callable:
    """A function over Arrow batches that starts without what other operators remember, and gives memory back to the system when its task ends: Python workers live on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keep)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and any executor may be lost."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    with step_settings(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stashed = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that no plan reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._stashed)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


HASHES = 1 << 62


def sampled(rows: DataFrame, rate: Column | float, by: list[str], most: int) -> DataFrame:
    """Distinct (by, text) of rows, chosen by a hash of the text with the given rate, `most` at the most: those with the least hashes. Copies count once; what is shuffled is about `most` rows a task at worst."""
    hashed = rows.withColumn("_hash", F.xxhash64("text").bitwiseAND(HASHES - 1)).where(F.col("_hash") < rate * F.lit(float(HASHES)))
    distinct = hashed.groupBy(*by, "_hash").agg(F.first("text").alias("text"))
    return distinct.orderBy("_hash", *by).limit(most).select(*by, "text")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and n + 1 offsets into it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind) if column.type != kind else column
    column = column.fill_null("" if kind == pa.large_string() else b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(offsets: np.ndarray, most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` bytes each, or one row that is longer."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and for each row (n + 1) the number of words before it."""
    word = ~space[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = offsets[:-1][offsets[:-1] < len(buf)]
    first[at] = word[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = word[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: a polynomial modulo 2**64 with odd base, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    most = int(length.max())
    inside = np.arange(int(starts[0]), int(ends[-1]), dtype=np.int64)
    gap = np.diff(starts, append=ends[-1])
    inside -= np.repeat(starts, gap)
    value = buf[starts[0] : ends[-1]].astype(np.uint64)
    value += np.uint64(1)
    value *= powers(max(most, int(gap.max())))[inside]
    value[inside >= np.repeat(length, gap)] = 0
    out = np.add.reduceat(value, starts - starts[0])
    out += length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; position i covers words[i : i + k]."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power = np.zeros(n, np.uint64), powers(k, np.uint64(0xA0761D6478BD642F))
    for i in range(k):
        out += words[i : i + n] * power[i]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = w - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
