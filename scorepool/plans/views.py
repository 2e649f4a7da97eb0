"""The engine's canonical tables over the star-schema tables, as DataFrames and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorepool.functions.text import ends_sentence, english_word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample x candidate 1..4 with validity, cluster, reward, rep, csr: every fourth document begins a sample."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    sample = F.floor(F.col("doc_id") / 4).cast("long")
    valid = (F.coalesce("quality", F.lit(1)) == 1) & (sample % 13 != 5)
    return d.join(l, "doc_id", "left").select(
        sample.alias("sample_key"), (sample % 40).alias("video_id"), (F.col("doc_id") % 4 + 1).cast("int").alias("candidate_index"), F.col("doc_id").alias("candidate_id"), valid.alias("valid"),
        F.when(valid, ((F.col("doc_id") * F.col("doc_id")) % 7).cast("double") / 8).alias("reward"),
        F.when(valid, (F.col("n_chars") % 16).cast("double") / 16).alias("rep"),
        F.when(valid, F.when(F.coalesce("toxic", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("csr"), "text",
    )


SLOTS = """slots_v AS (
SELECT CAST(floor(d.doc_id / 4) AS BIGINT) AS sample_key, CAST(floor(d.doc_id / 4) AS BIGINT) % 40 AS video_id,
 CAST(d.doc_id % 4 + 1 AS INT) AS candidate_index, d.doc_id AS candidate_id,
 coalesce(l.quality, 1) = 1 AND floor(d.doc_id / 4) % 13 <> 5 AS valid,
 CASE WHEN coalesce(l.quality, 1) = 1 AND floor(d.doc_id / 4) % 13 <> 5 THEN CAST((d.doc_id * d.doc_id) % 7 AS DOUBLE) / 8 END AS reward,
 CASE WHEN coalesce(l.quality, 1) = 1 AND floor(d.doc_id / 4) % 13 <> 5 THEN CAST(d.n_chars % 16 AS DOUBLE) / 16 END AS rep,
 CASE WHEN coalesce(l.quality, 1) = 1 AND floor(d.doc_id / 4) % 13 <> 5 THEN CASE WHEN coalesce(l.toxic, 0) = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS csr, d.text
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate timelines, a row for each segment: conversations with 6-second turns, some shifted and some empty."""
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    return c.select(
        F.col("conv_id").alias("candidate_id"), (turn + 1).cast("int").alias("segment_index"),
        ((turn * 6).cast("double") + F.when((F.col("conv_id") % 7 == 0) & (turn > 0), 1).otherwise(0)).alias("start"),
        ((turn * 6).cast("double") + F.when((F.col("conv_id") % 11 == 0) & (turn == 1), 0).otherwise(6)).alias("end"),
        F.col("text").alias("narration"), (turn == F.max("turn").over(Window.partitionBy("conv_id"))).alias("is_summary"),
    )


def timelines(spark: SparkSession, sf_dir: str, words: bool = True) -> DataFrame:
    """(candidate_id, segments): each candidate's ordered segments, of bounded number."""
    s = segments(spark, sf_dir)
    count = english_word_count("narration") if words else F.lit(0)
    s = s.withColumn("words", count).withColumn("complete", F.coalesce(ends_sentence(F.col("narration")), F.lit(False)))
    row = F.struct("segment_index", "start", "end", "words", "complete", "narration", "is_summary")
    return s.groupBy("candidate_id").agg(F.array_sort(F.collect_list(row)).alias("segments"))


TIMELINE = """timeline_v AS (
SELECT conv_id AS candidate_id, CAST(turn + 1 AS INT) AS segment_index,
 CAST(turn * 6 AS DOUBLE) + CASE WHEN conv_id % 7 = 0 AND turn > 0 THEN 1 ELSE 0 END AS s,
 CAST(turn * 6 AS DOUBLE) + CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN 0 ELSE 6 END AS e,
 text AS narration, turn = max(turn) OVER (PARTITION BY conv_id) AS is_summary,
 len(regexp_extract_all(strip_accents(text), '[A-Za-z]+(?:[''’-][A-Za-z]+)?')) AS words,
 regexp_matches(regexp_replace(text, '\\s+$', ''), '[.!?]["'']?$') AS complete
FROM conversations)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    order = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("sample_key"), order.alias("frame_pos"), "vec_id", "embedding")


FRAMES = """frames_v AS (
SELECT label AS sample_key, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_pos, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("sample_key"), F.col("event_id").alias("attempt_id"), (F.col("event_id") % 4 + 1).cast("int").alias("candidate_index"),
        F.when(F.col("event_type") == "error", "endpoint_error").when(F.col("event_type") == "purchase", "accepted").otherwise("parse_rejected").alias("status"),
        F.col("value").alias("request_seconds"), (F.col("event_id") % 97).alias("input_tokens"), (F.col("event_id") % 53).alias("output_tokens"), "ts", "props",
    )


ATTEMPTS = """attempts_v AS (
SELECT user_id AS sample_key, event_id AS attempt_id, CAST(event_id % 4 + 1 AS INT) AS candidate_index,
 CASE event_type WHEN 'error' THEN 'endpoint_error' WHEN 'purchase' THEN 'accepted' ELSE 'parse_rejected' END AS status,
 value AS request_seconds, event_id % 97 AS input_tokens, event_id % 53 AS output_tokens, ts, props FROM events)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a reference text each: the benchmark item at doc_id modulo the number of items."""
    items = table(spark, sf_dir, "benchmark")
    total = items.agg(F.count(F.lit(1)).alias("_total"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text").crossJoin(F.broadcast(total))  # one row
    return d.join(items.select("item_id", F.col("text").alias("reference")), F.col("item_id") == F.col("doc_id") % F.col("_total"), "left").select("doc_id", "text", "reference")
