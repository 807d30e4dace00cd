"""What the operators share: stored intermediate tables, byte views of text columns, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are turned into numpy arrays at once; one longer document is taken alone.
CHUNK_BYTES = 1 << 20
#: ASCII white space that ends a word: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_K1, _K2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a temporary one is set if driver and tasks are one process; on a cluster
    it has to be named, since executors don't see each other's temporary folders."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def store(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage is cut, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more, and let Spark drop the shuffle files of plans that are gone."""
    spark = None
    for f in frames:
        path = getattr(f, "_stored", None) if f is not None else None
        if path:
            spark = f.sparkSession
            _delete(spark, path)
    gc.collect()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def bucketed(df: DataFrame, key: str, name: str) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, bucketed by ``key``, so that joins on it don't move it; dropped at the end."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(n, key).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        _delete(spark, path)


def whole_texts(spark: SparkSession, rows: int = 2000) -> None:
    """Rows of whole texts go to Python in smaller batches than the default, which is meant for narrow rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    whole_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frugal(run):
    """A batch function whose worker gives its freed memory back to the system when the task ends: idle workers hold none."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` has at most ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float))
        at, ends = 0, np.cumsum(sizes)
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0.0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    a = pc.fill_null(column, "").cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _K1
    h = (h ^ (h >> np.uint64(27))) * _K2
    return h ^ (h >> np.uint64(31))


_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
_power: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2**64 and of its inverse."""
    if not len(_power.get("up", ())) > n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for key, b in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _power[key] = np.multiply.accumulate(p)
    return _power["up"], _power["down"]


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE) -> np.ndarray:
    """Running sums from which span_hash takes the hash of any stretch of bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from start to end, the same wherever they stand."""
    down = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _K2)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``; no word crosses a row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row of each word, and the number of words before each row (rows + 1 values)."""
    starts, ends, row = words(data, off)
    h = span_hash(prefix_hash(data, BYTE_LOWER if lower else BYTE), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return h, row, np.searchsorted(row, np.arange(len(off)))


class KeyTable:
    """Open hashing of 64-bit keys; find() gives the row of each key, or -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, size: int = 0):
        size = size or 1 << max(4, int(np.ceil(np.log2(2.5 * max(1, len(keys))))))
        self.keys, self.values, self.shift = keys, values, np.uint64(64 - int(size).bit_length() + 1)
        self.slots = np.full(size, -1, np.int32)
        self.held = np.zeros(size, np.uint64)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free][::-1]] = left[free][::-1]
            self.held[at[free][::-1]] = keys[left[free][::-1]]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) % size

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        got, held = self.slots[at], self.held[at]
        open_ = np.flatnonzero((got >= 0) & (held != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slots)
            got[open_] = self.slots[at[open_]]
            open_ = open_[(got[open_] >= 0) & (self.held[at[open_]] != keys[open_])]
        return got
