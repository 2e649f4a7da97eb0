"""Results taken in as they arrive, each sample once, and tables replaced by snapshots that are there wholly or not at all."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scorepool.operators.quality import upsert

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_of_each(rows: DataFrame, key: str = "sample_key") -> DataFrame:
    """A stream without rows whose key has come before; blank keys are dropped. The keys seen are kept as state, dealt by key over the
    executors and saved with the query's checkpoint: neither the target nor earlier input is read again."""
    named = rows.where(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "")
    return named.dropDuplicates([key])


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str = "sample_key") -> StreamingQuery:
    """Takes in all result files that are there, then stops; a later call goes on where this one ended.

    The target's list of files is committed batch by batch, so a batch that is run again after a failure replaces what it wrote and
    readers of the target (spark.read.parquet) see whole batches only.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    rows = first_of_each(spark.readStream.schema(schema).json(source), key)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


# --- snapshots ----------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()), held


def _marker(number: int) -> str:
    return f"commit-{number:010d}"


def _folder(spark: SparkSession, target: str, number: int) -> str | None:
    """The folder that a version's marker names; null while the marker is being written."""
    store, marker = _files(spark, f"{target}/{_marker(number)}")
    source = store.open(marker)
    try:
        name = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()
    return f"{target}/{name}" if re.fullmatch(r"snapshot-[0-9a-f]{32}", name) else None


def version(spark: SparkSession, target: str) -> int:
    """The last version that was committed; 0 where there is none."""
    store, root = _files(spark, target)
    names = [s.getPath().getName() for s in store.listStatus(root)] if store.exists(root) else []
    numbers = sorted((int(m[1]) for n in names if (m := re.fullmatch(r"commit-(\d{10})", n))), reverse=True)
    return next((n for n in numbers if _folder(spark, target, n)), 0)


def read_snapshot(spark: SparkSession, target: str, number: int | None = None) -> DataFrame:
    """A version of the table, the last one unless another is named."""
    number = version(spark, target) if number is None else number
    if not number:
        raise ValueError(f"nothing is committed in {target}")
    return spark.read.parquet(_folder(spark, target, number))


def commit_snapshot(rows: DataFrame, target: str, base: int) -> int:
    """Writes rows as version base + 1 and commits it by creating one small marker file, which no other writer can have created: a
    snapshot that was begun from an older version is an error and never replaces a newer one. Until its marker is whole, a version
    doesn't exist for readers; a writer that died while writing it leaves an empty marker, which an error names, to be removed."""
    spark, name = rows.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    rows.write.parquet(f"{target}/{name}")
    store, marker = _files(spark, f"{target}/{_marker(base + 1)}")
    if version(spark, target) != base or store.exists(marker):
        raise RuntimeError(f"{target} has moved on from version {base}: {_marker(base + 1)} exists")
    out = store.create(marker, False)  # fails if another writer was faster
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    return base + 1


def upsert_snapshot(rows: DataFrame, target: str, keys: list[str]) -> int:
    """Rows by key into the table: a new one replaces an old one, and doing it twice gives the same rows. Returns the version."""
    spark = rows.sparkSession
    base = version(spark, target)
    merged = upsert(read_snapshot(spark, target, base), rows, keys) if base else rows.dropDuplicates(keys)
    return commit_snapshot(merged, target, base)
