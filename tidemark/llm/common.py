"""Shared pieces of the training-data operators: scratch tables, Arrow text access, word hashing.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. In UTF-8 these bytes never occur inside a
longer code point, so working on bytes gives the same words as working on characters.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch: few enough that a batch of long texts is small, enough that its cost is spread.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
_SHIPPED: set[str] = set()
#: Folders of scratch tables of this process, by application.
_ROOTS: dict[str, set[str]] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that they need no path of their own to it.

    Arrow batches take the sizes of ARROW, which results need until they are computed, unless the session has sizes of its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        package = Path(__file__).resolve().parents[1]
        to = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(to)
    for key, value in ARROW.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Has a setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder of the cluster for intermediate tables: spark.checkpoint.dir; on one machine a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "tidemark-scratch")
    return base.rstrip("/")


def release(spark: SparkSession) -> None:
    """Deletes all scratch tables that this process made in the application; results that read them can't be computed any more."""
    for root in _ROOTS.pop(spark.sparkContext.applicationId, set()):
        _delete(spark, root)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the shared folder of the cluster.

    Tables written here survive the loss of any executor. Those that a result is read from stay until `release`, or the end of the
    driver's process; all others are dropped by the operator that made them.
    """

    #: Bytes of the source that stand behind each file of a table at least.
    FILE = 8 << 20

    def __init__(self, spark: SparkSession, name: str, source: DataFrame | None = None):
        ship(spark)
        self.names: set[str] = set()
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _ROOTS.setdefault(spark.sparkContext.applicationId, set()).add(self.root)
        self.most_files = self._most_files(source)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _most_files(self, source: DataFrame | None) -> int | None:
        """Files that a table is worth: four a core, or more if the source is larger. Many small ones only cost the store."""
        if source is None:
            return None
        size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return max(4 * self.spark.sparkContext.defaultParallelism, min(size // self.FILE, 1 << 20))

    def put(self, df: DataFrame, name: str, codec: str = "uncompressed") -> DataFrame:
        """Writes df and returns it as read again: lineage ends here.

        Most such tables hold hashes and ids, which don't compress; a codec's buffers outside the heap would cost executors
        memory for nothing. Texts take "zstd".

        Shuffle files go as soon as the table is written; else those that only the ended lineage needed would stay on disk until
        the driver's heap fills up.
        """
        self.names.add(name)
        out = df if self.most_files is None else df.coalesce(self.most_files)
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            out.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        for name in self.names - set(names):
            self.drop(name)

    def drop(self, name: str) -> None:
        self.names.discard(name)
        _delete(self.spark, self.path(name))


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes of a text; null gives no bytes."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string or binary column without nulls, and the row offsets into them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about `most` text bytes; a longer text is a slice of its own."""
    at = batch.schema.get_field_index(column)
    _, offsets = text_column(batch.column(at))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def trim() -> None:
    """Hands freed memory back to the system, so that a Python worker kept for later tasks stays small."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None


def per_slice(df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow that calls work on bounded slices, so memory follows the slice and not the batch."""

    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out
        trim()

    return df.mapInArrow(run, schema)


# --- word hashes -------------------------------------------------------------------------------------------

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
#: Longer words are hashed with BLAKE2b: polynomial hashes modulo a power of two have constructed collisions.
LONG_WORD = 255


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(seed)) | _U(1)


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK + 1, base & (2**64 - 1), _U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        byte = constants(256, 7)
        lower = byte.copy()
        lower[ord("A") : ord("Z") + 1] = byte[ord("a") : ord("z") + 1]
        _TABLES.update(up=_powers(_BASE), down=_powers(pow(_BASE, -1, 2**64)), byte=byte, lower=lower)
    return _TABLES


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each text where its words begin in that list."""
    t = _tables()
    values = t["lower" if lower else "byte"]
    hashes, begins = [], []
    with np.errstate(over="ignore"):
        for first, last in _pieces(data, offsets):
            part = data[first:last]
            inside = ~SPACE[part]
            before = np.empty(len(part) + 1, bool)
            before[0], before[1:] = False, inside
            cut = offsets[np.searchsorted(offsets, first, "right") : np.searchsorted(offsets, last, "left")] - first
            start = inside & ~before[:-1]
            start[cut] = inside[cut]
            end = inside.copy()
            end[:-1] &= ~inside[1:] | False
            end[cut - 1] = inside[cut - 1]
            s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
            total = np.empty(len(part) + 1, _U)
            total[0] = 0
            np.cumsum(values[part] * t["up"][: len(part)], out=total[1:])
            h = (total[e] - total[s]) * t["down"][s]
            length = (e - s).astype(_U)
            h = mix(h + length * _U(0xD6E8FEB86659FD93))
            for k in np.flatnonzero(e - s > LONG_WORD):
                word = part[s[k] : e[k]].tobytes()
                h[k] = int.from_bytes(hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest(), "little")
            hashes.append(h)
            begins.append(s + first)
    h = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    where = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return h, np.searchsorted(where, offsets)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most _CHUNK bytes that end at a text's end or at white space (a longer word is cut by force never)."""
    first, n = 0, len(data)
    while first < n:
        last = min(first + _CHUNK, n)
        if last < n:
            k = int(np.searchsorted(offsets, last, "right")) - 1
            if offsets[k] > first:
                last = int(offsets[k])
            else:
                gaps = np.flatnonzero(SPACE[data[first:last]])
                if len(gaps):
                    last = first + int(gaps[-1]) + 1
                else:  # one word longer than a chunk: take all of it
                    stop = int(offsets[k + 1])
                    gaps = np.flatnonzero(SPACE[data[last:stop]])
                    last = last + int(gaps[0]) if len(gaps) else stop
                    _grow(last - first)
        yield first, last
        first = last


def _grow(n: int) -> None:
    t = _tables()
    if len(t["up"]) <= n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            out = np.full(n + 1, base & (2**64 - 1), _U)
            out[0] = 1
            with np.errstate(over="ignore"):
                t[name] = np.multiply.accumulate(out)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words of one text; of the whole sequence if it has fewer than k words."""
    n = len(h)
    if n == 0:
        return h
    c = constants(max(k, 1), 11)
    with np.errstate(over="ignore"):
        if n < k:
            total = _U(n) * _U(0xA24BAED4963EE407) + np.sum(h * c[:n], dtype=_U)
            return mix(np.array([total], _U))
        total = h[: n - k + 1] * c[0]
        for j in range(1, k):
            total = total + h[j : n - k + 1 + j] * c[j]
        return mix(total)
