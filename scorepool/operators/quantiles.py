"""Exact quantiles of large groups by distributed selection.

No task holds a group's values. Counts by value range tell which narrow range holds each wanted rank (more passes split it again); what
is left of it is counted value by value, and the ranks are read off the running counts. Each step is an aggregation that is summed
before it is shuffled; a count by range yields at most BINS rows for each group and bracket, whatever the size of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges that a bracket is split into.
BINS = 4096


def joined_groups(rows: DataFrame, small: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """rows with the columns of small, which has a row for each group; null group keys are groups too."""
    renamed = small.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in small.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(renamed if by else F.broadcast(renamed), on, how).drop(*[f"_by_{c}" for c in by])


def _bin(value: Column, low: Column, high: Column) -> Column:
    """Which of BINS equal ranges of [low, high] holds a value: never decreasing in the value, also beside infinities and NaN (the greatest)."""
    return F.when(value >= high, BINS - 1).otherwise(F.least(F.lit(BINS - 1), F.nanvl(F.floor((value - low) / (high - low) * BINS).cast("double"), F.lit(0.0)).cast("int")))


def _picked(counts: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """Of counts (by, ranks, below, order, n, ...) the row that holds each rank, with below moved up to where it begins."""
    so_far = Window.partitionBy(*by, "ranks", "below").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counts.withColumn("_end", F.col("below") + F.sum("n").over(so_far)).withColumn("below", F.col("_end") - F.col("n"))
    held = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("_end")))
    return ends.withColumn("ranks", held).where(F.size("ranks") > 0).drop("_end")


def _narrowed(rows: DataFrame, brackets: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Brackets (by, ranks, below, low, high) narrowed to those of their BINS ranges that hold a rank, down to the least and greatest value."""
    inside = _inside(rows, brackets, by).withColumn("bin", _bin(F.col("value"), F.col("low"), F.col("high")))
    counts = inside.groupBy(*by, "ranks", "below", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return _picked(counts, by, "bin").select(*by, "ranks", "below", "low", "high")


def _inside(rows: DataFrame, brackets: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Each value once for each bracket of its group that holds it. A group's brackets are one row."""
    held = brackets.groupBy(*by).agg(F.collect_list(F.struct("ranks", "below", "low", "high")).alias("brackets"))
    hits = F.filter("brackets", lambda b: (F.col("value") >= b["low"]) & (F.col("value") <= b["high"]))
    return joined_groups(rows, held, by).select(*by, "value", F.inline(hits))


def exact_quantiles(rows: DataFrame, by: tuple[str, ...], value: str, shares: dict[str, float], passes: int = 1, more: tuple[Column, ...] = ()) -> DataFrame:
    """(by, n, more, one column for each share): exact quantiles with linear interpolation between neighbouring ranks.

    Nulls are not counted; a group without values has n 0 and null quantiles; NaN is greater than all. shares maps names of columns to
    shares of 1; more are other aggregates of the groups, made in the same step. More passes narrow the brackets further; the
    result is the same with any number.
    """
    held = rows.select(*by, *[c for c in rows.columns if c not in (*by, "value")], F.col(value).cast("double").alias("value"))
    spans = held.groupBy(*by).agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), *more)
    values = held.select(*by, "value").where("value is not null")
    places = [(F.lit(s) * (F.col("n") - 1)) for s in shares.values()]
    wanted = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
    brackets = spans.where("n > 0").select(*by, wanted.alias("ranks"), F.lit(0).cast("long").alias("below"), "low", "high")
    for _ in range(passes):
        brackets = _narrowed(values, brackets, by)
    last = _inside(values, brackets, by).groupBy(*by, "ranks", "below", "value").agg(F.count(F.lit(1)).alias("n"))
    each = _picked(last, by, "value").select(*by, F.explode("ranks").alias("rank"), "value")
    found = each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    both = joined_groups(spans.drop("low", "high"), found, by, "left")

    def between(place: Column) -> Column:
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        a, b = F.col("at")[low], F.col("at")[high]
        return F.when(low == high, a).otherwise((high - place) * a + (place - low) * b)

    kept = [c for c in both.columns if c not in (*by, "at")]
    return both.select(*by, *kept, *[between(p).alias(name) for name, p in zip(shares, places, strict=True)])
