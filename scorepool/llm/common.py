"""Plumbing shared by the corpus operators: scratch tables, Arrow slices, word and window hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by a Python worker, in bytes. A longer text makes a slice of its own.
SLICE_BYTES = 2 << 20

_own_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where that is unset, a folder of this process on a local
    master (tests); on a cluster an error, as its machines share no local folder."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="scorepool-")
        atexit.register(shutil.rmtree, _own_root, True)
    return f"file://{_own_root}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the scratch tables written so far and says how many there were. Frames that read them can't be used afterwards."""
    hadoop = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in _written]
    _written.clear()
    return sum(p.getFileSystem(hadoop).delete(p, True) for p in paths)


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which release() deletes."""
    _written.append(scratch_path(spark, name))
    return _written[-1]


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there, so a lost executor costs only its own tasks.

    The table stays until release() is called, as the frame returned is lazy.
    """
    spark = df.sparkSession
    path = scratch_table(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def crc_bucket(col, mod: int):
    """crc32 of doc_id as text, mod a small number; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod).cast("int")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy runs of rows whose texts hold at most limit bytes together."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, first = np.cumsum(size), 0
    while first < batch.num_rows:
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and each text's bounds in them; null counts as empty."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], wide)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


# --- hashes -----------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SOLID = (~_SPACE).tobytes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _byte_values()
_STRETCH = 1 << 19


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    n, inverse = 1 << bits, pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        out.append(p)
    return out[0], out[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all bits of x."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def looked_up(data: np.ndarray, table: bytes) -> np.ndarray:
    """The mark of each byte in a table of 256 marks; read only."""
    return np.frombuffer(data.tobytes().translate(table), bool)


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a slice of texts: 64-bit hashes, byte bounds, and each text's range of words."""

    def __init__(self, array: pa.Array, lower: bool, hashed: bool = True):
        self.data, self.offsets = utf8(array)
        if lower and len(self.data):
            self.data = _LOWER[self.data]
        data, n = self.data, len(self.data)
        solid = looked_up(data, _SOLID)
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        bound = self.offsets[(self.offsets < n)]
        first[bound] = solid[bound]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        bound = self.offsets[self.offsets > 0] - 1
        last[bound] = solid[bound]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.start, self.offsets)
        if hashed:
            self.hash = self.hashes()

    def hashes(self) -> np.ndarray:
        """Polynomial sums, a stretch of words at a time, so that tables of powers stay small."""
        out, at = np.empty(len(self.start), np.uint64), 0
        while at < len(out):
            low = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, low + _STRETCH, side="right")))
            n = int(self.end[to - 1]) - low
            power, inverse = _powers(max(_STRETCH.bit_length() - 1, (n - 1).bit_length()))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data[low : low + n]] * power[:n], out=sums[1:])
            start, end = self.start[at:to] - low, self.end[at:to] - low
            out[at:to] = (sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)
            at = to
        return mix64(out)

    def text(self, doc: int) -> bytes:
        return self.data[self.offsets[doc] : self.offsets[doc + 1]].tobytes()


_STEP = 0xA0761D6478BD642F


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes; positions near the end, where no run fits, are absent."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, size, out, done = words, 1, None, 0
    rest = k
    while rest:  # runs of 1, 2, 4 ... words put together
        if rest & 1:
            part = have[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(_STEP, size, 1 << 64)) + part
            done += size
        rest >>= 1
        if rest:
            have = have[: len(have) - size] * np.uint64(pow(_STEP, size, 1 << 64)) + have[size:]
            size *= 2
    return mix64(out + np.uint64(k))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
