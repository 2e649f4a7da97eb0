"""Content fingerprints: one hash of a table's rows, whatever their order and partitioning, and of a run's whole protocol.

Each row has a SHA-256 of its fields; the eight 32-bit numbers of those are added up over the rows, and the sums are hashed with the
number of rows. Sums merge, so tasks send eight numbers for each group, and equal multisets of rows alone have equal sums but for chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorepool.sinks import fingerprint
from scorepool.sources.streams import hashes

_WORDS = 8


def row_digest(*columns: Column) -> Column:
    """SHA-256 (hex) of a row's fields: `-` for null, else the text's number of UTF-8 bytes, `:` and the text. No two rows of the same
    columns have the same preimage."""
    texts = [c.cast("string") for c in columns]
    each = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*each).cast("binary"), 256)


def table_fingerprint(rows: DataFrame, columns: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, rows, fingerprint) of the multiset of rows in each group; repeated rows count each time. columns: which ones, in that order
    (all, by name, if none are given); nested ones as JSON. Without `by` an empty table has one row too."""
    names = columns or tuple(sorted(c for c in rows.columns if c not in by))
    kinds = dict(rows.dtypes)
    values = [F.to_json(F.col(f"`{c}`")) if kinds[c].startswith(("struct", "array", "map", "variant")) else F.col(f"`{c}`") for c in names]
    digest = rows.select(*by, row_digest(*values).alias("_d"))
    words = [F.sum(F.conv(F.substring("_d", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"_{k}") for k in range(_WORDS)]
    sums = digest.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *words)
    told = F.concat_ws(",", F.col("rows").cast("string"), *[F.coalesce(F.col(f"_{k}"), F.lit(0)).cast("decimal(38,0)").cast("string") for k in range(_WORDS)])
    return sums.select(*by, "rows", F.sha2(told.cast("binary"), 256).alias("fingerprint"))


def fingerprint_of(rows: DataFrame, columns: tuple[str, ...] = ()) -> dict:
    """The fingerprint of a whole table."""
    return table_fingerprint(rows, columns).first().asDict()


def source_fingerprint(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...] = (".py",)) -> dict:
    """Of the source files below some folders: each one's path (from its folder's parent) and hash, and the fingerprint of them all.
    Folders of compiled files are left out. No file at all is an error."""
    out: dict[str, str] = {}
    for root in roots:
        base = root.rstrip("/")
        parent = base.rsplit("/", 1)[-1]
        inner = F.regexp_extract("path", rf"/({parent}/.*)$", 1) if parent else F.col("path")
        found = hashes(spark, base).select(inner.alias("path"), "sha256").where(~F.contains("path", F.lit("__pycache__")))
        ends = F.lit(False)
        for s in suffixes:
            ends = ends | F.endswith("path", F.lit(s))
        out |= {r["path"]: r["sha256"] for r in found.where(ends).collect()}  # a program's files
    if not out:
        raise ValueError(f"no source files below {roots}")
    return {"files": dict(sorted(out.items())), "fingerprint": fingerprint(out)}


def protocol_manifest(payload: dict, annotations: DataFrame, source_roots: list[str], expected_files: tuple[str, ...] = ()) -> dict:
    """The manifest of a run: its settings, the fingerprint of the annotation rows and the hashes of the program's files, all of which its
    own fingerprint covers. expected_files: paths that the program must consist of, no fewer and no more."""
    sources = source_fingerprint(annotations.sparkSession, source_roots)
    if expected_files and sorted(expected_files) != list(sources["files"]):
        raise ValueError(f"source files differ: {sorted(set(expected_files) ^ set(sources['files']))[:20]}")
    held = {"settings": payload, "annotations": fingerprint_of(annotations), "sources": sources}
    return {"protocol_fingerprint": fingerprint(held), "scientific_payload": held}


def changed(earlier: dict, now: dict) -> list[str]:
    """Which parts of two manifests differ: settings, annotations, and source files by name."""
    a, b = earlier["scientific_payload"], now["scientific_payload"]
    out = [f"settings.{k}" for k in sorted(a["settings"].keys() | b["settings"].keys()) if a["settings"].get(k) != b["settings"].get(k)]
    out += ["annotations"] if a["annotations"] != b["annotations"] else []
    files, others = a["sources"]["files"], b["sources"]["files"]
    return out + [f"sources.{f}" for f in sorted(files.keys() | others.keys()) if files.get(f) != others.get(f)]
