"""What the corpus operators share: staged tables, Arrow batches in small chunks, vectorised words and hashes.

Hashes are 64 bits wide. They name strings (words, shingles, byte windows); the chance that two different
strings of a corpus of 10^12 strings share a name and thereby change a result is of the order of 10^-3 over the
whole corpus, and every pair that an operator reports is verified on more than one such name or on the text.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles at a time; a longer single document is a chunk of its own.
CHUNK_BYTES = 1 << 18
#: Bytes of one Arrow batch between Spark and its Python workers, which stand beside the executor's heap.
BATCH_BYTES = 4 << 20

_roots: dict[int, str] = {}
_scopes: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where it is unset and Spark is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = _roots.get(-1)
    if at is None:
        at = _roots[-1] = tempfile.mkdtemp(prefix="skyframe-")
    return at


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may have ended before the interpreter
        return


def stage(df: DataFrame, name: str, *, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor costs nothing.

    The table goes when the interpreter ends or when :func:`drop_stage` is called with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skyframe-{uuid.uuid4().hex[:12]}-{name}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skyframe_path = path
    atexit.register(_forget, spark, path)
    for made in _scopes:
        made.append(out)
    return out


def drop_stage(*staged: DataFrame) -> None:
    """Deletes staged tables; shuffle files of the jobs that wrote them go as soon as the driver has forgotten these."""
    for df in staged:
        _delete(df.sparkSession, df._skyframe_path)
    if staged:
        forget_shuffles(staged[0].sparkSession)


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files of jobs that have ended go when the driver collects its garbage, which it may not do for long."""
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame, name: str) -> DataFrame:
    """:func:`stage`, and the shuffle files of the job that wrote it go before the next job writes its own."""
    out = stage(df, name)
    for _ in range(2):  # listeners hold a job for a moment after its end
        forget_shuffles(df.sparkSession)
        time.sleep(0.3)
    return out


@contextmanager
def temporary() -> Iterator[Callable[..., None]]:
    """Drops the tables staged inside when it ends, but for those given to the function that it hands out."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield lambda *staged: kept.extend(staged)
    finally:
        _scopes.remove(made)
    drop_stage(*(t for t in made if all(t is not k for k in kept)))


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, where the session leaves them at Spark's own size: texts differ too much for a bound by rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("bB")) > BATCH_BYTES and spark.sparkContext.getConf().get(name) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def whole_number_key(docs: DataFrame, key: str) -> Column:
    """The key as a long; other types would lose their order or their values."""
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"the key {key} must be a whole number, not {docs.schema[key].dataType.simpleString()}")
    return docs[key].cast("long")


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


# --- Arrow ---------------------------------------------------------------------------------------------------------


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[i, j)`` of a string or binary column with their bytes and their offsets in them (null: no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    release()


def release() -> None:
    """Gives freed memory back to the system: Python workers live on from task to task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A list column: row i holds ``values[ends[i-1]:ends[i]]``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


# --- hashes and words ----------------------------------------------------------------------------------------------

_U = np.uint64
_rng = np.random.default_rng(20_240_601)
BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = int(_rng.integers(0, 1 << 62)) * 2 + 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All but ASCII letters and digits and bytes beyond ASCII: what surrounds a word does not change it.
ALNUM_SEPARATOR = np.ones(256, bool)
ALNUM_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i = 0..n."""
    if len(_powers[0]) <= n:
        m = max(n + 1, CHUNK_BYTES + 1)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with hash of data[a:b] = mix((S[b] - S[a]) * BASE^-a)."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, q = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * q[starts])


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, ...]:
    """Starts, ends, row and hash of every word: the longest runs of bytes that are no ``separator``, A-Z lower-cased."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = np.unique(offsets)
    first[edges[edges < n]] = inside[edges[edges < n]]
    last[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, row, span_hash(prefix_sums(LOWER[data]), starts, ends)


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each place on, and the places that have n words of one row."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:m].copy()
    for k in range(1, n):
        out = out * _U(0x9E3779B97F4A7C15) + h[k : k + m]
        out ^= out >> _U(29)
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(out[at]), at
