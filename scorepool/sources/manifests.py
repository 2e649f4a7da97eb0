"""Annotated manifests: every row with its two reference points and where they come from, or an error and no manifest."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorepool.constants import ALIASES, REFERENCE_FLAGS, REFERENCE_PREFIXES, REFERENCE_PROTOCOL, REFERENCE_TEMPLATES, WRAPPER_KEYS
from scorepool.sinks import fingerprint, write_json, write_once
from scorepool.sources.streams import hashes

#: What a field lookup for a manifest takes as missing.
_EMPTY = (None, "", [], {})
#: Failures named in an error.
PREVIEW = 20


def first_of(row: dict, names):
    """The first value under the names that is not empty, with its name; ("", "") if there is none."""
    for name in names:
        value = row.get(name)
        if not any(type(value) is type(e) and value == e for e in _EMPTY):
            return name, value
    return "", ""


def plain(value) -> str:
    """Text of a loosely typed value: lists by spaces, mappings as key: value, the rest stripped."""
    if value is None:
        return ""
    if isinstance(value, list):
        return " ".join(map(plain, value))
    if isinstance(value, dict):
        return " ".join(f"{k}: {plain(v)}" for k, v in value.items())
    return str(value).strip()


def annotate(raw: str, answer: str) -> tuple[str | None, str | None]:
    """A row with its reference points, or why it can't have them. `answer` is the sample's, with any selector resolved."""
    row = json.loads(raw)
    source = {name: first_of(row, ALIASES[name]) for name in ("question", "answer", "correct_choice", "choices")}
    answer_field = source["answer"][0] or source["correct_choice"][0]
    question, told = plain(source["question"][1]).strip(), answer.strip()
    if row.get("semantic_points"):
        return None, "canonical semantic_points already exist"
    if not question or not told:
        return None, ("question" if not question else "answer") + " is blank"
    selector = plain(row.get(answer_field))
    if isinstance(source["choices"][1], (list, dict)) and source["choices"][0] and len(selector) == 1 and selector.isalpha() and told.upper() == selector.upper():
        return None, "answer selector was not expanded"
    points = [f"{prefix.rstrip()} {text}" for prefix, text in zip(REFERENCE_PREFIXES, (question, told), strict=True)]
    origin = {"protocol": REFERENCE_PROTOCOL, "reference_usage": "evaluation_only"} | dict.fromkeys(REFERENCE_FLAGS, False)
    origin |= {"question_source_field": source["question"][0], "answer_source_field": answer_field, "choice_source_field": source["choices"][0], "resolved_answer_text": answer, "reference_templates": list(REFERENCE_TEMPLATES)}
    return json.dumps(row | {"semantic_points": points, "semantic_point_provenance": origin}, ensure_ascii=False), None


@F.pandas_udf(T.StructType([T.StructField("annotated", T.StringType()), T.StructField("issue", T.StringType())]))
def _annotated(raw: pd.Series, answer: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([annotate(r, a or "") for r, a in zip(raw, answer, strict=True)], columns=["annotated", "issue"])


def annotated(samples: DataFrame) -> DataFrame:
    """samples (raw, video_id, answer ...) to video_id, annotated and issue. Row and sample are one row, so nothing is zipped."""
    return samples.select("video_id", _annotated("raw", "answer").alias("x")).select("video_id", "x.*")


def build_manifest(samples: DataFrame) -> DataFrame:
    """The annotated rows (raw), all or none: an error names the first failures by video."""
    rows = annotated(samples)
    failed = rows.where("issue is not null")
    if bad := failed.orderBy("video_id", "issue").limit(PREVIEW).collect():
        raise ValueError(f"no reference points for {failed.count()} rows: " + "; ".join(f"{r['video_id']}: {r['issue']}" for r in bad))
    return rows.select(F.col("annotated").alias("raw"))


def protocol(dataset: str, source: str, source_sha256: str) -> dict:
    """What a manifest states about how its references were made."""
    held = {"name": REFERENCE_PROTOCOL, "dataset": dataset, "source_manifest": source, "source_manifest_sha256": source_sha256, "semantic_points_per_sample": len(REFERENCE_PREFIXES)}
    held |= {"construction": "deterministic_template_from_official_qa_annotations", "reference_templates": list(REFERENCE_TEMPLATES), "reference_usage": "evaluation_only"}
    return held | dict.fromkeys(REFERENCE_FLAGS, False)


def source_sha256(spark: SparkSession, path: str) -> str:
    return hashes(spark, path).first()["sha256"]


def wrapper_key(spark: SparkSession, path: str) -> str | None:
    """The key under which a JSON file holds its rows; null for a plain list."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    held = [F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")).startswith("ARRAY"), F.lit(k)) for k in WRAPPER_KEYS]
    return whole.select(F.coalesce(*held)).first()[0]


def write_manifest(samples: DataFrame, path: str, dataset: str, source: str, overwrite: bool = False) -> dict:
    """The manifest's rows as JSON lines at `path`, and `path`.protocol.json; returns the summary. Never replaces its source."""
    spark = samples.sparkSession
    own = protocol(dataset, source.rsplit("/", 1)[-1], source_sha256(spark, source))
    rows = build_manifest(samples)
    write_once(rows.select(F.parse_json("raw").alias("row")).select("row"), path, source, overwrite)
    write_json(f"{path.rstrip('/')}.protocol.json", own | {"wrapper_key": wrapper_key(spark, source), "fingerprint": fingerprint(own)})
    n = spark.read.json(path, schema="row string").count()
    return {"dataset": dataset, "source_manifest": own["source_manifest"], "source_manifest_sha256": own["source_manifest_sha256"], "reference_protocol": REFERENCE_PROTOCOL, "samples": n} | {
        "semantic_points_per_sample": len(REFERENCE_PREFIXES), "total_semantic_points": n * len(REFERENCE_PREFIXES)}
