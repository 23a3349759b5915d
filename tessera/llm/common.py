"""Shared pieces: scratch tables in the shared folder, bounded slices of Arrow batches, vectorised hashing of text."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy pass handles; its temporaries take about forty times this.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch between Spark and its workers, in sessions that name no bound (Spark's own is about 64 MB).
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SCRATCH: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only where driver and executors are one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="tessera-")
        shared_dir.own = found
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table; call it only when no result that was built on one is still to be computed."""
    while _SCRATCH:
        delete_path(spark, _SCRATCH.pop()[1])


_STAGES: list[tuple[SparkSession, str]] = []


def stage(f: Callable) -> Callable:
    """A pipeline stage f(spark, docs, sf_dir): scratch tables of the stages before it are deleted when it begins.

    A stage's result is to be written before the next one begins; tables that docs itself reads stay.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read, kept = docs.inputFiles() if _STAGES else [], []
        while _STAGES:
            made = _STAGES.pop()
            if any(made[1].removeprefix("file:").strip("/") in x for x in read):
                kept.append(made)
            elif made in _SCRATCH:
                _SCRATCH.remove(made)
                delete_path(*made)
        first = len(_SCRATCH)
        out = f(spark, docs, sf_dir)
        _STAGES.extend([*kept, *_SCRATCH[first:]])
        return out

    return run


@atexit.register
def _at_exit() -> None:
    for spark, path in _SCRATCH:
        try:
            delete_path(spark, path)
        except Exception:  # the JVM may be gone already
            return


#: Makes Spark delete the shuffle files of a write when it is over, instead of when the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes Parquet to the shared folder and reads it again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that nothing to be computed reads any more."""
    for table in tables:
        delete_path(table.sparkSession, table._scratch)


_REMEMBERED: dict[str, Callable] = {}


def remembered(f: Callable) -> Callable:
    """functools.cache for what a worker opens once; it goes when the worker turns to a task that has no use for it."""
    _REMEMBERED[f.__name__] = functools.cache(f)
    return _REMEMBERED[f.__name__]


def settle(keep: tuple[str, ...]) -> None:
    """Forgets all remembered things but those named and gives freed memory back to the system."""
    stale = [f for name, f in _REMEMBERED.items() if name not in keep and f.cache_info().currsize]
    for f in stale:
        f.cache_clear()
    if stale:
        gc.collect()
    Hasher.shrink()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_worker(run: Callable, *keep: str) -> Callable:
    """run for mapInArrow; workers live on from one operator to the next, so each task settles before and after itself.

    Batches are bounded in bytes where the session names no bound (it keeps the one set here, as results are computed
    later than they are asked for): executors hold two of them for each running task.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(keep)
        yield from run(batches)
        settle(keep)

    return task


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df has not, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most ``limit`` bytes of ``column``, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = _offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and the offset of each text (null: empty), n + 1 values."""
    offsets = _offsets(column) if len(column) else np.zeros(1, np.int64)
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        assert not len(sizes) or int(sizes.sum()) == int(offsets[-1] - offsets[0])
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """64-bit hash of any byte range in constant time: prefix sums of mixed bytes times powers, modulo 2^64.

    Equal strings have equal hashes wherever they stand, also in other batches.
    """

    _bytes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _up = _down = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        if n >= len(Hasher._up):
            size = max(n * 5 // 4, 1 << 16)
            Hasher._up, Hasher._down = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self._bytes[raw] * self._up[:n], out=self.prefix[1:])

    @classmethod
    def shrink(cls) -> None:
        """Drops the tables of powers; the next text makes them anew."""
        cls._up = cls._down = np.ones(1, np.uint64)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.prefix[end] - self.prefix[start]
        out *= self._down[start]
        return mix(out ^ ((end - start).astype(np.uint64) * _M2))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+``, and the index of its text; words never cross texts."""
    ink = ~_SPACE[raw]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = ink[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = ink[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of ``size`` words; a text of 1 to size - 1 words has one shingle, of all its words."""
    count = np.bincount(doc, minlength=n_docs)
    top = len(hashes) - size + 1
    if top > 0:
        value = hashes[:top].copy()
        for k in range(1, size):
            value *= np.uint64(_BASE)
            value += hashes[k : k + top]
        whole = doc[:top] == doc[size - 1 :]
        value, owner = mix(value[whole]), doc[:top][whole]
    else:
        value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(count)])
        more = []
        for d in short:
            v = np.uint64(count[d])
            for h in hashes[begin[d] : begin[d + 1]]:
                v = mix(np.array([v ^ h], dtype=np.uint64))[0]
            more.append(v)
        value, owner = np.concatenate([value, np.array(more, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


def distinct_by_doc(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value), sorted by owner, then value."""
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], owner[keep]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1, for all i, one after another."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(np.asarray(start, np.int64) - (ends - length), length)


def binary_array(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column over one buffer."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data)])


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Most rows (of a few numbers each) that a broadcast may have; beyond it the same join goes by a shuffle.
BROADCAST_ROWS = 2_000_000


def broadcast_if_small(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """keys (already written, a few numbers a row) with a broadcast hint if a count shows that it is small."""
    from pyspark.sql import functions as F

    return F.broadcast(keys) if keys.count() <= limit else keys


#: Rows that one row is made into at a time.
COPIES = 4096


def deal_copies(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Each of rows as often as its column ``count`` says, numbered from 0 in ``name``; rows of many copies are dealt out in runs of COPIES."""
    from pyspark.sql import functions as F

    run = free_name(rows, "run")
    few = rows.where(F.col(count).between(1, COPIES)).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    runs = rows.where(F.col(count) > COPIES).withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / COPIES))))
    spread = runs.repartition(default_partitions(rows.sparkSession), *runs.columns)
    last = F.least((F.col(run) + 1) * COPIES, F.col(count)) - 1
    many = spread.withColumn(name, F.explode(F.sequence(F.col(run) * COPIES, last))).drop(run)
    return few.unionByName(many)
