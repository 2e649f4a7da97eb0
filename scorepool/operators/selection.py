"""Selection among a sample's candidates: argmax, fixed first candidate, per-metric bounds, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorepool.constants import LOWER_IS_BETTER, PREFIX_METHODS


def best_of(slots: DataFrame, key: str = "sample_key", index: str = "candidate_index", score: str = "reward") -> DataFrame:
    """The valid slot of highest score of each sample; among equals the lowest index. Scores count as rounded to six places."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.bround(score, 6).desc(), F.col(index).asc()))
    return slots.where("valid").withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def direct(slots: DataFrame, index: str = "candidate_index") -> DataFrame:
    """Candidate 1 where it is valid; never another in its place."""
    return slots.where(F.col("valid") & (F.col(index) == 1))


def _methods(methods: dict[str, int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(p).alias("prefix")) for m, p in methods.items()]))


def by_method(slots: DataFrame, methods: dict[str, int] | None = None, index: str = "candidate_index") -> DataFrame:
    """Each slot once for every method whose prefix holds it; a narrow explode instead of a join with the method table."""
    named = slots.withColumn("_m", _methods(methods or PREFIX_METHODS)).where(F.col(index) <= F.col("_m.prefix"))
    return named.select("*", F.col("_m.method").alias("method")).drop("_m")


def selections(slots: DataFrame, metrics: tuple[str, ...], methods: dict[str, int] | None = None, key: str = "sample_key") -> DataFrame:
    """For every sample and method one row: the selected candidate's metrics, null where none is valid, and the prefix's valid count.

    One grouping by sample serves both: no join back to the list of samples.
    """
    named = by_method(slots, methods)
    order = F.struct((-F.bround("reward", 6)).alias("_r"), F.col("candidate_index").alias("_i"), F.col("candidate_id"), *[F.col(m) for m in metrics])
    picked = named.groupBy("method", key).agg(F.min(F.when(F.col("valid"), order)).alias("p"), F.count_if("valid").alias("valid_slots"), F.count(F.lit(1)).alias("slots"))
    return picked.select("method", key, "valid_slots", "slots", F.col("p.candidate_id").alias("candidate_id"), *[F.col(f"p.{m}").alias(m) for m in metrics])


def upper_bound(slots: DataFrame, metrics: tuple[str, ...], key: str = "sample_key") -> DataFrame:
    """Rows (key, metric, value, candidate_id): the best value of each metric by itself, among equals the first candidate's."""
    long = slots.where("valid").select(key, "candidate_index", "candidate_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(m in LOWER_IS_BETTER).alias("low")) for m in metrics])).alias("x"))
    signed = F.when(F.col("x.low"), -F.col("x.value")).otherwise(F.col("x.value"))
    rank = F.row_number().over(Window.partitionBy(key, "x.metric").orderBy(signed.desc(), F.col("candidate_index")))
    return long.withColumn("_rank", rank).where("_rank = 1").select(key, "x.metric", "x.value", "candidate_id")


def prefix_sums(rows: DataFrame, value: str, key: str = "sample_key", order: tuple[str, ...] = ("candidate_index",)) -> DataFrame:
    running = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(value).over(running))
