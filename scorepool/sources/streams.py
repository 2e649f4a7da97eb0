"""Files opened in the tasks and read in chunks, whatever their size."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20
#: Stores that tasks open by themselves: a local or mounted folder, Hadoop's file system, and object stores.
SCHEMES = ("file", "hdfs", "viewfs", "s3", "s3a", "gs", "abfs", "abfss")


def opens(path: str) -> bool:
    """Whether tasks can open a path by themselves. Other stores are read by Spark's own readers, whole files as values of up to 2 GB."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return scheme is None or scheme[1].lower() in SCHEMES


@contextmanager
def opened(path: str):
    """A file that can be read and sought, through Arrow's file systems."""
    from pyarrow import fs

    if (local := re.sub(r"^file:/+", "/", path)).startswith("/"):
        store, name = fs.LocalFileSystem(), local
    else:
        store, name = fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))
    with store.open_input_file(name) as f:
        yield f


def chunks(f, start: int = 0, end: int | None = None, size: int | None = None) -> Iterator[bytes]:
    """The bytes [start, end) of an open file, a chunk at a time."""
    f.seek(start)
    left, size = (f.size() if end is None else end) - start, size or CHUNK_BYTES
    while left > 0 and (held := f.read(min(size, left))):
        yield held
        left -= len(held)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below root, empty ones too, which Spark's readers leave out; no content is read. Tasks of this frame
    hold files of about the same size together."""
    frame = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    names = [(re.sub(r"^file:/+", "file:/", unquote(p)),) for p in frame.inputFiles()]
    files = frame.select("path", "length")
    empty = spark.createDataFrame(names, "path string").join(files.select("path"), "path", "left_anti")
    return files.unionByName(empty.select("path", F.lit(0).cast("long").alias("length")))


def hashed(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of files (path, length): each is read once, by one task, chunk by chunk. A file whose size has changed
    since it was listed is an error."""

    def run(batches):
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                digest, n = hashlib.sha256(), 0
                with opened(path) as f:
                    for held in chunks(f):
                        digest.update(held)
                        n += len(held)
                if n != length:
                    raise ValueError(f"{path} has {n} bytes, not {length}")
                yield pa.RecordBatch.from_pylist([{"path": path, "length": n, "sha256": digest.hexdigest()}])

    return files.select("path", "length").mapInArrow(run, "path string, length long, sha256 string")


def hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of all files below root (or of the one file that it names)."""
    if opens(root):
        return hashed(listed(spark, root))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    empty = listed(spark, root).where("length = 0").withColumn("sha256", F.sha2(F.lit("").cast("binary"), 256))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")).unionByName(empty)
