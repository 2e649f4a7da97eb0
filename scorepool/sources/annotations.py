"""Annotation sources: JSON lines, JSON with or without a wrapper, CSV, Parquet; rows become typed samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorepool.constants import ALIASES, WRAPPER_KEYS
from scorepool.sources import loose
from scorepool.sources.elements import elements
from scorepool.sources.streams import opens

RAW = "raw string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One raw JSON text for each non-blank line, read split by split."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("raw"))


def read_json(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Rows of JSON files: a list, a list under the first known wrapper key, or a lone object. Many tasks read one file, each the
    elements that begin in its part.

    strict: an object without a known list is an error, and so is a row that is no object. A scalar file always is one.
    """
    if opens(path):
        rows = elements(spark, path, WRAPPER_KEYS, alone=not strict).select(F.parse_json("value").alias("v"))
    else:
        rows = _whole_json(spark, path, strict)
    if strict:
        ok = F.schema_of_variant("v").startswith("OBJECT")
        rows = rows.select(F.when(ok, F.col("v")).otherwise(F.raise_error(F.lit("a row is not an object")).cast("variant")).alias("v"))
    return rows.select(F.to_json("v").alias("raw"))


def _whole_json(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """The rows of files in a store that only Spark's readers open: a task for each file."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    wrapped = [F.when(F.schema_of_variant(F.variant_get("v", f"$.{k}", "variant")).startswith("ARRAY"), F.variant_get("v", f"$.{k}", "array<variant>")) for k in WRAPPER_KEYS]
    alone = F.raise_error(F.lit("no known list in the object")).cast("array<variant>") if strict else F.array(F.col("v"))
    rows = (
        F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>"))
        .when(kind.startswith("OBJECT"), F.coalesce(*wrapped, alone))
        .otherwise(F.raise_error(F.lit("neither a list nor an object")).cast("array<variant>"))
    )
    return whole.select(F.explode(rows).alias("v"))


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header, every value a string, byte order mark dropped. Where no value has a line break, multi_line=False lets
    one file be read by many tasks."""
    frame = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    return frame.select(F.to_json(F.struct(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in frame.columns])).alias("raw"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame.select(F.to_json(F.struct(*frame.columns)).alias("raw"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """By suffix; anything else is an error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    readers = {"jsonl": read_jsonl, "json": read_json, "csv": read_csv, "parquet": read_parquet}
    if suffix not in readers:
        raise ValueError(f"unsupported annotation format: {path}")
    return readers[suffix](spark, path)


def to_samples(rows: DataFrame) -> DataFrame:
    """Typed samples with their raw text, all in native expressions. Rows that are no JSON object end the job."""
    numbered = [f"option{i}" for i in range(26)]
    names = dict.fromkeys(n for k, held in ALIASES.items() if not k.startswith("subtitle_") for n in (*held, *numbered))
    raw = F.when(F.col("raw").rlike(r"^\s*\{"), F.col("raw")).otherwise(F.raise_error(F.lit("a row is not an object")).cast("string"))
    read = rows.select("raw", loose.texts(raw, names).alias("t"), loose.variants(raw, names).alias("v"))
    found = read.select(
        "raw", *[loose.first_of("t", "v", held).alias(k) for k, held in ALIASES.items() if not k.startswith("subtitle_")],
        F.expr("array(" + ", ".join(f"named_struct('present', v.{n} IS NOT NULL, 'value', named_struct('text', t.{n}, 'kind', substring(to_json(v.{n}), 1, 1)))" for n in numbered) + ")").alias("numbered"),
    )
    plain = ("video_id", "video_path", "lookup_id", "question", "answer", "correct_choice", "category", "target_audience", "closing_summary")
    values = F.array(*[F.struct(f"{n}.text", f"{n}.kind") for n in plain])
    subtitles = loose.subtitles(F.col("subtitle"), ALIASES["subtitle_text"], ALIASES["subtitle_start"])
    spoken = [F.when(loose.truthy(F.col(n)), loose.stated(F.col(n))) for n in ("caption", "prompt")]
    # One row for one, as a generator: a filter on a sample's field is not pushed below it, where it would repeat what reads the row.
    said = found.select("raw", F.inline(F.array(F.struct(
        F.transform(values, loose.plain).alias("texts"),
        loose.strip(F.concat_ws(" ", spoken[0], F.nullif(subtitles, F.lit("")), spoken[1])).alias("caption"),
        loose.number(F.col("duration")).alias("duration"), loose.listed(F.col("semantic_points")).alias("semantic_points"), F.coalesce("semantic_points.name", F.lit("")).alias("semantic_point_source_field"),
        loose.options(F.col("choices"), F.col("numbered")).alias("option_pairs"),
    ))))
    told = said.select(*[c for c in said.columns if c != "texts"], *[F.col("texts")[i].alias(n) for i, n in enumerate(plain)], loose.options_text(F.col("option_pairs")).alias("option_list")).withColumn("selector", F.when(F.col("answer") != "", F.col("answer")).when(F.size("option_pairs") > 0, F.col("correct_choice")).otherwise(""))
    asked = F.when((F.col("question") != "") & (F.col("option_list") != ""), F.concat("question", F.lit(" Options: "), "option_list")).otherwise(F.col("question"))
    return told.select(
        "raw", "video_id", F.col("video_path").alias("explicit_path"), "lookup_id", "caption", asked.alias("question"), chosen(F.col("selector"), F.col("option_pairs")).alias("answer"),
        "category", "duration", "semantic_points", "semantic_point_source_field", "target_audience", "closing_summary",
    )


def checked_samples(samples: DataFrame) -> DataFrame:
    """samples, after an error for none at all or for blank ids (the first ten are named)."""
    blank = samples.where(F.col("video_id") == "").select("raw").orderBy("raw").limit(10).collect()
    if blank:
        raise ValueError(f"samples without an id: {[r['raw'][:80] for r in blank]}")
    if samples.isEmpty():
        raise ValueError("no samples")
    return samples


def context_text(s: DataFrame) -> Column:
    return _joined(s, ("question", "caption", "category", "target_audience"))


def reference_text(s: DataFrame) -> Column:
    return _joined(s, ("caption", "answer", "closing_summary"))


def _joined(s: DataFrame, names) -> Column:
    return F.concat_ws(" ", *[F.nullif(s[n], F.lit("")) for n in names])


# --- native forms of the same rules, for typed columns ----------------------------------------------------------


def first_non_blank(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def first_non_blank_name(**values: Column) -> Column:
    return F.coalesce(*[F.when(v.isNotNull() & (v != ""), F.lit(n)) for n, v in values.items()], F.lit(""))


def chosen(selector: Column, options: Column) -> Column:
    """The option (key, text) that a letter, a number or a key selects, without its label; the selector itself where it selects none.

    Options without keys are numbered from 0, A being 0 too. The label is the selecting letter, or the key in upper case.
    """
    letter = F.when(selector.rlike(r"^\p{L}$"), F.upper(selector))
    by_place = F.coalesce(F.ascii(letter) - 65, selector.try_cast("int"))
    with_key = lambda key: F.get(F.filter(options, lambda o: o["key"] == key), F.lit(0))
    keyed = F.exists(options, lambda o: o["key"].isNotNull())
    plain_key, upper_key = with_key(selector), with_key(F.upper(selector))
    text = F.when(~keyed, F.get(options, F.when(by_place >= 0, by_place))["text"]).otherwise(F.coalesce(plain_key["text"], upper_key["text"]))
    label = F.when(keyed & plain_key.isNull(), F.upper(selector)).otherwise(letter)
    own = F.concat(F.lit(r"\Q"), F.replace(label, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    form = F.concat(F.lit(r"(?i)^\s*(?:"), own, F.lit(r"\s*[-.):]\s+|[\[(]\s*"), own, F.lit(r"\s*[\])]\s*[-.):]?\s*)(?=\S)"))
    bare = F.when(label.isNull(), text).otherwise(F.regexp_replace(text, form, F.lit("")))
    return F.when((selector == "") | text.isNull(), selector).otherwise(bare)


def lettered(options: Column) -> Column:
    """`A. x B. y`: blanks are left out but keep their letter."""
    text = F.transform(options, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", ""))
    part = F.transform(text, lambda t, i: F.when(t != "", F.concat(F.char(F.lit(65) + i), F.lit(". "), t)))
    return F.array_join(F.array_compact(part), " ")


def split_list(text: Column) -> Column:
    """Non-blank parts of a JSON list of strings, else of a string delimited by , ; / and their wide forms."""
    stripped = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    parsed = F.when(stripped.startswith("[") & stripped.endswith("]"), F.from_json(stripped, "array<string>"))
    parts = F.coalesce(parsed, F.split(stripped, "[,，;；/、]"))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def remote(url: Column) -> Column:
    """Has a scheme or starts with //, and is no Windows drive."""
    t = F.trim(url)
    return ~t.rlike(r"^[A-Za-z]:[\\/]") & (t.startswith("//") | t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"))


def reference_points(samples: DataFrame) -> DataFrame:
    """samples with the two formal reference points; blank context or answer is an error of the row, kept as `issue`."""
    context, answer = F.trim("question"), F.trim("answer")
    issue = F.when(context == "", F.lit("question is blank")).when(answer == "", F.lit("answer is blank"))
    return samples.withColumn("reference_points", F.array(F.concat(F.lit("Evidence context: "), context), F.concat(F.lit("Expected answer: "), answer))).withColumn("issue", issue)
