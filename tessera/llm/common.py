"""Shared helpers: shared-folder tables, Arrow text buffers, word and shingle hashing."""

from __future__ import annotations

import atexit
import ctypes
import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCRATCH: list[tuple[SparkSession, str]] = []

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where it is unset, a local folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            remove(spark, path)
        except Exception:  # the JVM is already gone
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def send(spark: SparkSession, value: object, keep: bool = True) -> Callable[[], object]:
    """Broadcast a value together with its class; the function returned gives it on a worker (without `keep` the worker reads it again at each call)."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load() -> object:
        found = pickle.loads(sent.value)
        if not keep and vars(sent).get("_path"):
            vars(sent).pop("_value", None)
        return found

    return load


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Gives freed memory back to the system when a task's partition is done: workers are reused, by other stages too."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not glibc
                pass

    return wrapped


ARROW_ROWS = 1000
"""Rows an Arrow batch in these operators: texts may be long, and a batch is held by Spark and by the worker at once."""


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over batches of at most ARROW_ROWS rows (a setting of the session), leaving no freed memory with the worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(tidy(run), schema)


def unused(name: str, taken: list[str]) -> str:
    """The name, with underscores added until no column has it (Spark's names ignore case)."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and the n + 1 offsets; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_binary())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64, len(arr) + 1, arr.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """Slices of a batch with about `most` text bytes each (a longer single text stays whole)."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n) + 64
    if len(sizes) > start:
        yield batch.slice(start, len(sizes) - start)


def once(key: tuple, make: Callable[[], object]) -> object:
    """A value made once a process. It is kept in `sys`: functions that travel by value bring their own module globals."""
    memo = vars(sys).setdefault("_tessera_memo", {})
    if key not in memo:
        memo[key] = make()
    return memo[key]


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    return lower, white, np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ASCII-only lower-casing, white space of [\\x20\\x09-\\x0D], and a random 64-bit number a byte."""
    return once(("bytes",), _byte_tables)


_P = 0x9E3779B97F4A7C15 | 3
_P_INV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Stafford's variant 13)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


KEPT_POWERS = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; one table a base is kept, longer ones are made when asked for."""
    return once(("powers", base), lambda: _powers(base, KEPT_POWERS))[:n] if n <= KEPT_POWERS else _powers(base, n)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z: (hash, start, end, word offsets a text)."""
    lower, white, table = byte_tables()
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    low = lower[data] if fold else data
    solid = ~white[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[low] * powers(_P, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers(_P_INV, n)[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words a text, in order and with repeats; shorter texts give one run of all their words."""
    counts = np.diff(at)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    if not len(hashes):
        return np.empty(0, np.uint64), offsets
    mult = [np.uint64(x) for x in powers(0xD1342543DE82EF95, width)]
    pad = np.concatenate([hashes, np.zeros(width, np.uint64)])
    first = np.repeat(at[:-1] - offsets[:-1], n) + np.arange(offsets[-1])
    out = np.zeros(len(first), np.uint64)
    long = np.repeat(counts >= width, n)
    left = np.repeat(at[1:], n) - first
    for j in range(width):
        use = pad[first + j] * mult[j]
        out += use if long.all() else np.where(long | (j < left), use, np.uint64(0))
    return mix(out + np.where(long, np.uint64(width), np.minimum(left, width).astype(np.uint64))), offsets
