"""File-backed sources: checkpoints, media paths, frames, configuration, earlier results."""

from __future__ import annotations

import io
import json
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorepool.constants import VIDEO_SUFFIXES
from scorepool.operators.quality import blank_or_repeated
from scorepool.sources.frames import arrays
from scorepool.sources.streams import hashes, listed

_SKIPPED = r"(^|/)(\.cache|\.git|__pycache__)/|(^|/)\.DS_Store$|\.(lock|tmp)$"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths below root, relative, with sizes; no content is read."""
    return listed(spark, root).select(_relative(root).alias("path"), F.col("length").alias("size_bytes"))


def _relative(root: str):
    base = re.sub(r"^file:/+", "/", root).rstrip("/")
    return F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), f"^{re.escape(base)}/", "")


def checkpoint_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, sha256) of a model folder, without caches, locks and temporary files. Files of any size are hashed chunk by
    chunk where they are read."""
    found = hashes(spark, root).select(_relative(root).alias("path"), F.col("length").alias("size_bytes"), "sha256")
    return found.where(~F.col("path").rlike(_SKIPPED))


def manifest_audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files of a manifest that are missing or differ: (path, issue)."""
    both = manifest.join(files.select("path", F.col("size_bytes").alias("_n"), F.col("sha256").alias("_h")), "path", "left")
    issue = F.when(F.col("_n").isNull(), F.lit("missing")).when(F.col("_n") != F.col("size_bytes"), F.lit("size")).when(F.col("_h") != F.col("sha256"), F.lit("sha256"))
    return both.select("path", issue.alias("issue")).where("issue is not null")


def resolve_paths(samples: DataFrame, files: DataFrame, roots: list[str], search_dirs: list[str] | None = None) -> DataFrame:
    """samples (video_id, lookup_id, explicit_path) with video_path.

    An explicit local path is kept if absolute, else taken under the first root that has it, else under the first root. Without one,
    roots x folders x stems x suffixes are tried in order, then a folder of that name. files: (path) of all roots, absolute.
    """
    dirs = search_dirs or [""]
    local = (F.col("explicit_path") != "") & ~_is_remote("explicit_path")
    stem = F.regexp_replace("lookup_id", r"\.[^.]*$", "")
    stems = F.array_distinct(F.when(F.contains("lookup_id", F.lit(".")), F.array("lookup_id", stem)).otherwise(F.array("lookup_id")))
    under = F.array(*[F.concat(F.lit(r.rstrip("/") + "/"), F.col("explicit_path")) for r in roots]) if roots else F.array().cast("array<string>")
    bases = F.array(*[F.lit("/".join(x for x in (r.rstrip("/"), d) if x)) for r in roots for d in dirs]) if roots else F.array().cast("array<string>")
    names = F.flatten(F.transform(stems, lambda s: F.concat(*[F.array(F.concat(s, F.lit(x))) for x in VIDEO_SUFFIXES])))
    guesses = F.flatten(F.transform(bases, lambda b: F.transform(names, lambda n: F.concat_ws("/", b, n))))
    tries = F.when(local & F.startswith("explicit_path", F.lit("/")), F.array("explicit_path")).when(local, under).when(F.col("lookup_id") != "", guesses).otherwise(F.array().cast("array<string>"))
    known = files.select(F.col("path").alias("_try")).unionByName(files.select(F.regexp_replace("path", "/[^/]*$", "").alias("_try"))).distinct().withColumn("_hit", F.lit(True))
    # the tries tell everything the search depends on, so rows that have the same ones share a result
    own = samples.withColumn("_tries", tries).withColumn("_row", F.coalesce(F.array_join("_tries", "\0"), F.lit("")))
    tried = own.select("_row", "_tries").distinct().select("_row", F.posexplode("_tries").alias("_at", "_try")).join(known, "_try")
    found = tried.groupBy("_row").agg(F.min(F.struct("_at", "_try")).alias("_f")).select("_row", F.col("_f._try").alias("_found"))
    fallback = F.when(local, F.get("_tries", F.lit(0)))
    return own.join(found, "_row", "left").withColumn("video_path", F.coalesce("_found", fallback, F.lit(""))).drop("_row", "_tries", "_found")


def _is_remote(name: str):
    from scorepool.sources.annotations import remote

    return remote(F.col(name))


def npz_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame_pos, height, width, pixels) of NPZ archives; a broken one ends the job (frames.load_frames tells them apart)."""

    def read(batches):
        for batch in batches:
            rows = [(name, i, f.shape[0], f.shape[1], f.tobytes()) for name, content in zip(batch["path"], batch["content"], strict=True) for i, f in enumerate(arrays(io.BytesIO(content)))]
            yield pd.DataFrame(rows, columns=["path", "frame_pos", "height", "width", "pixels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, frame_pos int, height int, width int, pixels binary")


def image_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame_pos, content): images of a folder in order of path."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(jpg|jpeg|png|webp|bmp)$"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.select("path", (F.row_number().over(Window.partitionBy(folder).orderBy("path")) - 1).alias("frame_pos"), "content")


def expand_env(value):
    """$NAME and ${NAME} in every string of a configuration; a string that is only an unset variable becomes empty."""
    if isinstance(value, dict):
        return {k: expand_env(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v) for v in value]
    if isinstance(value, str):
        out = os.path.expandvars(value)
        return "" if re.fullmatch(r"\$(\w+|\{\w+\})", out) else out
    return value


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return expand_env(json.load(f))


def unique_paths(roots: list[str], base: str = "") -> list[str]:
    return list(dict.fromkeys(os.path.normpath(os.path.join(base, r)) for r in roots if r))


def read_results(spark: SparkSession, path: str, schema, rebuilt: Column | None = None) -> DataFrame:
    """Earlier result rows. A blank key is taken from `rebuilt`, where given; one that stays blank or repeats is an error."""
    rows = spark.read.schema(schema).json(path)
    if rebuilt is not None:
        key = F.coalesce(F.nullif(F.trim("sample_key"), F.lit("")), rebuilt)
        rows = rows.withColumn("sample_key", key)
    if bad := blank_or_repeated(rows, "sample_key").orderBy("sample_key").limit(5).collect():
        raise ValueError(f"blank or repeated sample keys: {[r['sample_key'] for r in bad]}")
    return rows
