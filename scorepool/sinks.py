"""Sinks: JSON lines, ordered results, wide CSV tables, Markdown reports, guarded manifests."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(value) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def _store(path: str):
    """The file system of a path, any that Spark writes to, and the path in it."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()), held


def write_text(path: str, text: str) -> None:
    """One small file, written by way of Spark's file systems, so that it lies beside the tables whatever store they are in."""
    store, held = _store(path)
    out = store.create(held, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(path: str) -> str | None:
    """A small file's text; null if there is none."""
    store, held = _store(path)
    if not store.exists(held):
        return None
    source = store.open(held)
    try:
        return bytes(SparkSession.getActiveSession()._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def write_json(path: str, value) -> None:
    write_text(path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Appending adds a batch of files at a time, never a row."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_results(rows: DataFrame, path: str) -> None:
    """All results in order of video and sample."""
    write_jsonl(rows.orderBy("video_id", "sample_key"), path)


#: Columns that failure rows keep, of those there are.
FAILURE_COLUMNS = ("sample_key", "video_id", "valid_slots", "full_pool", "slots", "sampling")


def failures(results: DataFrame, expected: int = 4) -> DataFrame:
    """Samples with fewer valid slots than expected, with what tells why."""
    kept = [c for c in FAILURE_COLUMNS if c in results.columns]
    return results.where(F.coalesce(F.col("valid_slots"), F.lit(0)) < expected).select(*kept, (F.lit(expected) - F.coalesce(F.col("valid_slots"), F.lit(0))).alias("missing_slots"))


def write_status(path: str, status: str, **facts) -> None:
    """The run's status file."""
    write_json(path, {"status": status} | facts)


def wide(summary: DataFrame, row: str, column: str, value: str, order: list[str]) -> DataFrame:
    """Long statistics with one column for each of `order`."""
    return summary.groupBy(row).pivot(column, order).agg(F.first(value))


def write_csv(rows: DataFrame, path: str) -> None:
    """A small report table as one file."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def number(value, digits: int = 4) -> str:
    return "n/a" if value is None else f"{value:.{digits}f}"


def markdown(title: str, columns: list[str], rows: list) -> str:
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    lines += ["| " + " | ".join(number(v) if isinstance(v, float) or v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def write_analysis(folder: str, summary: DataFrame, selections: DataFrame, efficiency: DataFrame) -> None:
    """The analysis bundle: selections as JSON lines, two CSV tables, a JSON summary and a Markdown report. summary (as of
    reports.main_table) and efficiency are report-sized."""
    write_jsonl(selections, f"{folder}/selections.jsonl")
    write_csv(summary, f"{folder}/main_results.csv")
    write_csv(efficiency, f"{folder}/efficiency.csv")
    rows = summary.orderBy("method").collect()
    write_json(f"{folder}/summary.json", [r.asDict() for r in rows])
    write_text(f"{folder}/summary.md", markdown("Candidate pool analysis", summary.columns, [list(r) for r in rows]))


def write_once(rows: DataFrame, path: str, source: str | None = None, overwrite: bool = False) -> None:
    """A manifest that never replaces its source, and an earlier file only if told to."""
    if source is not None and os.path.abspath(source) == os.path.abspath(path):
        raise ValueError("the output would replace its source")
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def guard_protocol(path: str, manifest: dict, resume: bool) -> str:
    """Writes a protocol manifest with its fingerprint; on resuming, an earlier one with another fingerprint is an error."""
    own = fingerprint(manifest)
    earlier = read_text(path) if resume else None
    if earlier is not None and json.loads(earlier).get("protocol_fingerprint") != own:
        raise ValueError("the protocol has changed since the run began")
    write_json(path, manifest | {"protocol_fingerprint": own})
    return own


def checkpoint_manifest(files: DataFrame, model_id: str, revision: str, root_name: str) -> dict:
    """A model folder's manifest with its own hash; files is the listing with sizes and hashes."""
    rows = [r.asDict() for r in files.orderBy("path").collect()]
    held = {"kind": "checkpoint", "model_id": model_id, "revision": revision, "root_name": root_name, "file_count": len(rows), "total_bytes": sum(r["size_bytes"] for r in rows), "files": rows}
    return held | {"identity_sha256": fingerprint(held)}


def check_manifest(manifest: dict) -> None:
    held = {k: v for k, v in manifest.items() if k != "identity_sha256"}
    if fingerprint(held) != manifest.get("identity_sha256"):
        raise ValueError("the manifest's own hash differs")
    if held["file_count"] != len(held["files"]) or held["total_bytes"] != sum(f["size_bytes"] for f in held["files"]):
        raise ValueError("the manifest's totals differ")


def portable(path: str) -> str:
    """A project-relative path; absolute ones and those with .. are errors."""
    if os.path.isabs(path) or ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"not a project-relative path: {path}")
    return path.replace("\\", "/")
