"""Grouped statistics: conditional and effective means, efficiency percentiles, attempt roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorepool.constants import LOWER_IS_BETTER
from scorepool.operators.quantiles import exact_quantiles


def effective(metric: str) -> Column:
    """The metric with failures imputed as the worst value."""
    return F.coalesce(F.col(metric), F.lit(1.0 if metric in LOWER_IS_BETTER else 0.0))


def summarize_methods(picked: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Per method: counts, rates, conditional means over successes and effective means over all samples."""
    ok = F.col("candidate_id").isNotNull()
    means = [c for m in metrics for c in (F.avg(m).alias(f"cond_{m}"), F.avg(effective(m)).alias(f"eff_{m}"))]
    return picked.groupBy("method").agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.avg(ok.cast("int")).alias("success_rate"),
        F.count_if(F.col("valid_slots") == F.col("slots")).alias("exact_prefix"), F.avg("valid_slots").alias("mean_valid_slots"), *means,
    )


def histogram(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def value_counts(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(value).cast("string"), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def mean_or_zero(x: str) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def efficiency(rows: DataFrame, keys: tuple[str, ...], by: tuple[str, ...] = (), total: bool = True) -> DataFrame:
    """Per group and key: mean, exact median and 95th percentile (linear interpolation), and the total. Values must not be negative; a
    key without values has nulls. Ranks are selected from counts, so that no task holds a group's values."""
    checked = lambda k: F.when(F.col(k).cast("double") < 0, F.raise_error(F.lit("an efficiency value is negative"))).otherwise(F.col(k).cast("double"))
    held = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(k).alias("key"), checked(k).alias("value")) for k in keys])))
    group = (*by, "key")
    out = exact_quantiles(held, group, "value", {"median": 0.5, "p95": 0.95}, more=(F.avg("value").alias("mean"), F.sum("value").alias("total")))
    return out.select(*group, "mean", "median", "p95", *(["total"] if total else []))


def method_efficiency(slots: DataFrame, sums: tuple[str, ...], methods: dict[str, int], key: str = "sample_key", index: str = "candidate_index") -> DataFrame:
    """Per sample and method the sums over the method's first slots, all methods in one aggregation."""
    cols = [F.coalesce(F.sum(F.when(F.col(index) <= p, F.col(s))), F.lit(0)).alias(f"{m}__{s}") for m, p in methods.items() for s in sums]
    wide = slots.groupBy(key).agg(*cols)
    return wide.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("method"), *[F.col(f"{m}__{s}").cast("double").alias(s) for s in sums]) for m in methods])).alias("x")).select(key, "x.*")


def rollup(attempts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Attempts of a slot: number, seconds, tokens, and the terminal reason."""
    return attempts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("request_seconds").alias("seconds"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.array_sort(F.collect_set("status")).alias("statuses"),
    ).withColumn("reason", terminal_reason(F.col("statuses"))).drop("statuses")


def transports(attempts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Of attempts with an array of transports (status, request_seconds, backoff_seconds_after): requests, failed ones, and seconds.
    An attempt without any was sent once, in its own request_seconds."""
    held = F.coalesce("transports", F.array().cast("array<struct<status: string, request_seconds: double, backoff_seconds_after: double>>"))
    add = lambda f: F.aggregate(held, F.lit(0.0), lambda s, x: s + F.coalesce(f(x), F.lit(0.0)))
    none = F.size(held) == 0
    return attempts.groupBy(*by).agg(
        F.sum(F.when(none, 1).otherwise(F.size(held))).alias("requests"), F.sum(F.size(F.filter(held, lambda x: x["status"] != "success"))).alias("failed_requests"),
        F.sum(F.when(none, F.coalesce("request_seconds", F.lit(0.0))).otherwise(add(lambda x: x["request_seconds"]))).alias("request_seconds"), F.sum(add(lambda x: x["backoff_seconds_after"])).alias("backoff_seconds"),
    )


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """How many attempts there are by status and by prompt kind: rows (what, value, n)."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for c in ("status", "prompt_kind")]))
    return attempts.select(named.alias("x")).groupBy("x.what", "x.value").agg(F.count(F.lit(1)).alias("n"))


def terminal_reason(statuses: Column) -> Column:
    """accepted, or which failures used up a slot's attempts."""
    failed = F.array_distinct(F.array_remove(statuses, "accepted"))
    return (
        F.when(F.array_contains(statuses, "accepted"), F.lit("accepted"))
        .when((F.size(failed) == 1) & F.array_contains(failed, "endpoint_error"), F.lit("endpoint_errors_only"))
        .when((F.size(failed) == 1) & F.array_contains(failed, "parse_rejected"), F.lit("parse_rejections_only"))
        .otherwise(F.lit("mixed_failures"))
    )


def peaks(attempts: DataFrame, by: str, last: str, order: str, most: tuple[str, ...], flag: Column) -> DataFrame:
    """Of each group the metadata of its last attempt, maxima with a floor of 0, whether any attempt has the flag, and how many there are."""
    latest = F.max(F.struct(F.col(order), F.col(last))).getField(last)
    return attempts.groupBy(by).agg(latest.alias("last"), *[F.coalesce(F.greatest(F.max(m), F.lit(0)), F.lit(0)).alias(f"max_{m}") for m in most], F.bool_or(flag).alias("any_flag"), F.count(F.lit(1)).alias("n"))


def pool_integrity(slots: DataFrame, key: str = "sample_key", expected: int = 4) -> DataFrame:
    """One row: slots, valid slots, samples, samples with a full pool, and its rate."""
    per = slots.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("v"))
    return per.agg(
        F.sum("n").alias("slots"), F.sum("v").alias("valid_slots"), F.count(F.lit(1)).alias("samples"),
        F.count_if((F.col("v") == expected) & (F.col("n") == expected)).alias("full_pools"),
        F.avg(((F.col("v") == expected) & (F.col("n") == expected)).cast("int")).alias("full_pool_rate"),
    )
