"""What the operators of this subpackage share: the shared folder, written tables, words of a text."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


# ------------------------------------------------------------------ storage
def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as in local tests, a
    temporary folder is made and set.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="pipewright-")
    atexit.register(shutil.rmtree, where.removeprefix("file://"), ignore_errors=True)
    spark.sparkContext.setCheckpointDir(where)
    return where


def new_folder(spark: SparkSession, label: str) -> str:
    """URI of a folder of its own for one run; nothing is made yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    The table is deleted when the driver ends, or by ``forget``. ``few``: rows are small against what they
    are made from; AQE then puts them into as many files as their size asks for.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if few else df
    where = new_folder(spark, label)
    df.write.parquet(where)
    _file_system(spark, where).deleteOnExit(_path(spark, where))
    back = spark.read.schema(df.schema).parquet(where)
    back.settled_in = where
    return back


def _path(spark: SparkSession, where: str):
    return spark._jvm.org.apache.hadoop.fs.Path(where)


def _file_system(spark: SparkSession, where: str):
    return _path(spark, where).getFileSystem(spark._jsc.hadoopConfiguration())


def forget(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    _file_system(df.sparkSession, df.settled_in).delete(_path(df.sparkSession, df.settled_in), True)


def open_fs(uri: str):
    """(file system, path) of a URI, on driver and executors alike."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ memory
def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on, and beside others, after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_LARGE: list[Callable] = []


def large(cached: Callable) -> Callable:
    """A cached function whose results take so much memory that only tasks that use it find them in their worker."""
    _LARGE.append(cached)
    return cached


def let_go(uses: Callable | None = None) -> None:
    """Drop what earlier tasks of this worker left in the large caches, but for the one in use."""
    others = [c for c in _LARGE if c is not uses and c.cache_info().currsize]
    for cached in others:
        cached.cache_clear()
    if others:
        give_back()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: Callable | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives memory back about every half second and at its end, and holds no large cache but the one it uses."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(uses)
        last = time.monotonic()
        for out in run(batches):
            yield out
            if time.monotonic() - last > 0.5:
                give_back()
                last = time.monotonic()
        give_back()

    return task


# ------------------------------------------------------------------ Arrow
def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (data[:0], np.zeros(1, np.int64))


def slices(offsets: np.ndarray, most: int):
    """Runs (first, after) of rows of about ``most`` bytes; a longer row is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


# ------------------------------------------------------------------ words
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words ``[^\\x20\\x09-\\x0D]+`` of some texts, and the first word of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    inner = offsets[:-1][np.diff(offsets) > 0]
    before[inner] = False
    after[inner[1:] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, over all bytes of each."""
    length = ends - starts
    out = np.zeros(len(starts), np.uint64)
    order = np.argsort(255 - np.minimum(length, 255).astype(np.uint8), kind="stable")  # a radix sort; long words are hashed one by one
    s, n = starts[order], length[order]
    long = int(np.searchsorted(-n, -48, "left")) if len(n) else 0  # words of 48 bytes and more
    h = np.full(len(s), 0x9E3779B97F4A7C15, np.uint64)
    raw = data.tobytes() if long else b""
    for k in range(long):
        h[k] = int.from_bytes(hashlib.blake2b(raw[s[k] : s[k] + n[k]], digest_size=8).digest(), "little")
    left = -n[long:]
    for j in range(int(n[long]) if long < len(n) else 0):
        c = long + int(np.searchsorted(left, -j, "left"))
        h[long:c] = (h[long:c] ^ data[s[long:c] + j]) * np.uint64(0x9FB21C651E98DF25)
        h[long:c] ^= h[long:c] >> np.uint64(29)
    out[order] = mix(h ^ n.astype(np.uint64))
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
