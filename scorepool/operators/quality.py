"""Integrity checks as queries: violations are rows, or the first failing message of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorepool.constants import CANDIDATES, IDENTITY_TOLERANCE, LOWER_IS_BETTER, REFERENCE_PREFIXES, ROW_TOLERANCE


def first_issue(*checks: tuple[Column, str]) -> Column:
    """The message of the first condition that holds; null if none does. A null condition counts as failing to hold."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for bad, message in checks])


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))


def unit(x: Column) -> Column:
    return finite(x) & x.between(0, 1)


def missing(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(observed.select(key), key, "left_anti")


def unexpected(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    return missing(observed, expected, key)


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def blank_or_repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that are null, blank or repeated, with their counts."""
    name = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")).alias(key)
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col(key) == ""))


def pending(samples: DataFrame, existing: DataFrame, key: str = "sample_key") -> DataFrame:
    """Samples still to run."""
    return samples.join(existing.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; a new one replaces an old one."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_age"))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_age", "_rank")


def in_enumeration_order(rows: DataFrame, **orders: list[str]) -> DataFrame:
    """Sorted by each column's place in its list; unlisted values last, then by value."""
    place = [c for name, values in orders.items() for c in (F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(name)), F.lit(0)), F.lit(1 << 30)), F.col(name))]
    return rows.orderBy(*place)


def slot_mismatches(slots: DataFrame, candidates: DataFrame, key: str = "sample_key") -> DataFrame:
    """Slots said to be valid without a candidate, and candidates without a valid slot: (key, candidate_index, issue)."""
    said = slots.where("valid").select(key, "candidate_index", F.lit(True).alias("_s"))
    held = candidates.select(key, "candidate_index", F.lit(True).alias("_c"))
    both = said.join(held, [key, "candidate_index"], "full_outer")
    issue = F.when(F.col("_c").isNull(), F.lit("slot_without_candidate")).when(F.col("_s").isNull(), F.lit("candidate_without_slot"))
    return both.select(key, "candidate_index", issue.alias("issue")).where("issue is not null")


def slot_order_issues(slots: DataFrame, key: str = "sample_key", expected: int = CANDIDATES) -> DataFrame:
    """Samples whose candidate indices are not exactly 1 to `expected`."""
    got = slots.groupBy(key).agg(F.array_sort(F.collect_list("candidate_index")).alias("indices"))
    return got.where(F.col("indices") != F.sequence(F.lit(1), F.lit(expected))).select(key)


def usage_issue(row_in: Column, row_out: Column, total: Column) -> Column:
    return first_issue(
        (row_in.isNull() | row_out.isNull() | total.isNull(), "usage is incomplete"),
        ((row_in < 0) | (row_out < 0) | (total < 0), "usage is negative"),
        (total != row_in + row_out, "total differs from input plus output"),
    )


def rollup_issue(slots: DataFrame, rolled: DataFrame, keys: list[str], tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Slots whose stated attempts, seconds or tokens differ from their attempts' sums: (keys, issue)."""
    both = slots.join(rolled.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("attempts", "seconds", "input_tokens", "output_tokens")]), keys, "full_outer")
    issue = first_issue(
        (F.col("attempts").isNull(), "attempts without a slot"),
        (F.col("_attempts").isNull(), "slot without attempts"),
        (F.col("attempts") != F.col("_attempts"), "attempt count differs"),
        (F.abs(F.col("seconds") - F.col("_seconds")) > tolerance, "seconds differ"),
        ((F.col("input_tokens") != F.col("_input_tokens")) | (F.col("output_tokens") != F.col("_output_tokens")), "tokens differ"),
    )
    return both.select(*keys, issue.alias("issue")).where("issue is not null")


def numbering_issues(attempts: DataFrame, keys: list[str], number: str = "attempt") -> DataFrame:
    """Groups whose attempts are not numbered 1, 2, 3 ... once each."""
    got = attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(number).alias("d"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    return got.where("d <> n or lo <> 1 or hi <> n").select(*keys)


def prompt_issues(attempts: DataFrame, keys: list[str], base_hash: str, retry_hash: str) -> DataFrame:
    """Groups in which the first attempt lacks the base prompt's hash or a later one the retry prompt's."""
    want = F.when(F.col("attempt") == 1, F.lit(base_hash)).otherwise(F.lit(retry_hash))
    return attempts.where(~F.col("prompt_sha256").eqNullSafe(want)).select(*keys).distinct()


def ordering_violations(slots: DataFrame, picked: DataFrame, key: str = "sample_key") -> DataFrame:
    """Samples whose first candidate has a higher effective reward than the one picked (rows of key and reward): none, if selection is right."""
    first = slots.where("candidate_index = 1").select(key, F.coalesce("reward", F.lit(0.0)).alias("_first"))
    return picked.select(key, F.coalesce("reward", F.lit(0.0)).alias("_picked")).join(first, key).where(F.col("_first") > F.col("_picked") + 1e-12).select(key)


def identity_gap(conditional: Column, effective: Column, success_rate: Column, metric: str) -> Column:
    """How far the effective mean is from conditional * success (plus failures, where lower is better)."""
    expected = F.coalesce(conditional, F.lit(0.0)) * success_rate
    if metric in LOWER_IS_BETTER:
        expected = expected + (1 - success_rate)
    return F.abs(effective - expected)


def identity_issues(summary: DataFrame, metrics: tuple[str, ...], tolerance: float = IDENTITY_TOLERANCE) -> DataFrame:
    issue = first_issue(*[(identity_gap(F.col(f"cond_{m}"), F.col(f"eff_{m}"), F.col("success_rate"), m) > tolerance, f"{m} breaks the identity") for m in metrics])
    return summary.select("method", issue.alias("issue")).where("issue is not null")


def reference_issue(points: Column, provenance: Column, protocol: str) -> Column:
    """Why a row's reference points break the contract: two texts with fixed prefixes, the protocol, and three flags that are false."""
    strip = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")
    text = [strip(F.get(points, F.lit(i))) for i in range(len(REFERENCE_PREFIXES))]
    checks = [(points.isNull() | (F.size(points) != len(REFERENCE_PREFIXES)), "semantic_points must contain exactly two strings")]
    checks.append((text[0].eqNullSafe(F.lit("")) | text[1].eqNullSafe(F.lit("")), "semantic_points contains an empty point"))
    for t, prefix in zip(text, REFERENCE_PREFIXES, strict=True):
        checks.append((~F.startswith(t, F.lit(prefix)) | (strip(F.substring(t, F.lit(len(prefix) + 1), F.length(t))) == ""), f"semantic point does not follow `{prefix}...`"))
    checks.append((provenance.isNull(), "semantic_point_provenance is missing"))
    checks.append((~provenance["protocol"].eqNullSafe(F.lit(protocol)), "per-row reference protocol is invalid"))
    for flag in ("reference_enters_generation", "reference_enters_reward", "reference_enters_candidate_selection"):
        checks.append((~provenance[flag].eqNullSafe(F.lit(False)), f"{flag} must be false"))
    return first_issue(*checks)


def check_points(samples: DataFrame, issue: Column, preview: int = 5) -> None:
    """An error for samples without points of their own field, then for ones whose points have an issue; the first are named."""
    for bad, what in ((F.coalesce(F.size("semantic_points"), F.lit(0)) <= 0, "lack reference points"), (F.coalesce(F.col("semantic_point_source_field") != "semantic_points", F.lit(True)), "take their points from another field"), (issue.isNotNull(), "have invalid reference points")):
        found = samples.where(bad)
        if first := found.select("video_id", issue.alias("issue")).orderBy("video_id").limit(preview).collect():
            raise ValueError(f"{found.count()} samples {what}: " + "; ".join(r["video_id"] + (f": {r['issue']}" if r["issue"] else "") for r in first))


def run_audit(expected: DataFrame, results: DataFrame, key: str = "sample_key") -> DataFrame:
    """One row: expected, observed, missing, unexpected and duplicate keys, rows with an issue, and eligibility."""
    want = expected.select(key).distinct().withColumn("_e", F.lit(1))
    have = results.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count("issue").alias("_bad"))
    both = want.join(have, key, "full_outer")
    out = both.agg(
        F.count("_e").alias("expected"), F.coalesce(F.sum("_n"), F.lit(0)).alias("observed"), F.count_if(F.col("_n").isNull()).alias("missing"),
        F.count_if(F.col("_e").isNull()).alias("unexpected"), F.count_if(F.col("_n") > 1).alias("duplicates"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("row_issues"),
    )
    return out.withColumn("eligible", (F.col("missing") + F.col("unexpected") + F.col("duplicates") + F.col("row_issues") == 0) & (F.col("expected") > 0))
