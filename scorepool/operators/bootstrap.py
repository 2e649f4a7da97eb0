"""Cluster bootstrap of pooled means, with draws that are functions of (seed, replicate, cluster).

Each replicate weighs each cluster by a Poisson number of mean 1, read off a hash. That approximates drawing n of n clusters with
replacement (the number drawn varies about n, which shows with few clusters) and needs no list of clusters, no order and no generator. Every task draws for the clusters it holds, only weighted sums for each replicate
leave it, and a lost task draws the same again. The same hashes in SQL give the same intervals.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorepool.constants import BOOTSTRAP_REPLICATES, BOOTSTRAP_SEED
from scorepool.functions.text import held_once
from scorepool.operators.stats import effective

#: Replicates that share a hash: eight hexadecimal digits of the 64 for each.
PER_HASH = 8


def poisson_steps() -> list[int]:
    """A 32-bit number that reaches the first k of these steps stands for a Poisson number (mean 1) of at least k."""
    steps, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        step = math.floor(total * 2**32)
        if step >= 2**32 or (steps and step == steps[-1]):
            return steps
        steps.append(step)
        k += 1


def cluster_weights(cluster: Column, replicates: int, seed: int) -> Column:
    """array<struct<replicate int, w int>> of a cluster: its weight in every replicate. A null cluster is one like others."""
    name = F.coalesce(F.concat(F.lit(":"), cluster.cast("string")), F.lit("-"))

    def block(b: Column) -> Column:
        digits = F.sha2(F.concat(F.lit(f"{seed}:"), b.cast("string"), name).cast("binary"), 256)
        part = lambda d: F.transform(F.sequence(F.lit(0), F.lit(PER_HASH - 1)), lambda k: F.struct((b * PER_HASH + k).alias("replicate"), F.conv(F.substring(d, 8 * k + 1, F.lit(8)), 16, 10).cast("long").alias("h")))
        return held_once(digits, part)

    def weight(h: Column) -> Column:
        w = F.lit(0)
        for n, step in enumerate(poisson_steps(), 1):
            w = F.when(h >= step, n).otherwise(w)
        return w

    blocks = F.sequence(F.lit(0), F.lit(max(0, -(-replicates // PER_HASH) - 1)))
    drawn = F.filter(F.flatten(F.transform(blocks, block)), lambda x: x["replicate"] < max(0, replicates))
    return F.transform(drawn, lambda x: F.struct(x["replicate"].alias("replicate"), weight(x["h"]).alias("w")))


def interval(counts: np.ndarray, sums: np.ndarray, replicates: int, rng: np.random.Generator) -> list[float]:
    """The percentile interval (2.5, 97.5) of the pooled mean over clusters that one generator draws with replacement, rounded to six
    places: for a single in-memory list of clusters, where figures are to be compared with such a sequence of draws.

    No clusters give zeros; one cluster or no replicates give the mean twice, without a draw.
    """
    n = len(counts)
    if not n or counts.sum() == 0:
        return [0.0, 0.0]
    if replicates <= 0 or n == 1:
        mean = round(float(sums.sum() / counts.sum()), 6)
        return [mean, mean]
    draws = np.empty(replicates)
    for k in range(replicates):
        own = rng.integers(0, n, size=n)
        draws[k] = sums[own].sum() / counts[own].sum()
    low, high = np.percentile(draws, [2.5, 97.5])
    return [round(float(low), 6), round(float(high), 6)]


def cluster_sums(picked: DataFrame, metrics: Iterable[str], cluster: str) -> DataFrame:
    """Per method and cluster: rows, and for each metric the count and sum over successes and the sum with failures imputed."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        aggs += [F.count(m).alias(f"n_{m}"), F.coalesce(F.sum(m), F.lit(0.0)).alias(f"cond_{m}"), F.sum(effective(m)).alias(f"eff_{m}")]
    return picked.groupBy("method", F.col(cluster).cast("string").alias("cluster")).agg(*aggs)


def replicate_sums(sums: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Of rows of cluster_sums: (method, replicate, weighted sums), summed in each task before they are shuffled."""
    drawn = sums.withColumn("_x", F.explode(cluster_weights(F.col("cluster"), replicates, seed)))
    values = [c for c in sums.columns if c not in ("method", "cluster")]
    return drawn.groupBy("method", F.col("_x.replicate").alias("replicate")).agg(*[F.sum(F.col(c) * F.col("_x.w")).alias(c) for c in values])


def cluster_intervals(picked: DataFrame, metrics: tuple[str, ...], cluster: str, methods: tuple[str, ...], replicates: int = BOOTSTRAP_REPLICATES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Rows (method, metric, estimand, low, high): the percentile interval (2.5, 97.5) of each pooled mean, to six places.

    A metric without successes has a null conditional interval. No rows of a method give an effective one of zeros; one cluster, or
    replicates <= 0, give the mean twice. A replicate in which every cluster weighs 0 has no mean and doesn't count.
    """
    spark = picked.sparkSession
    sums = cluster_sums(picked, metrics, cluster)
    pairs = [(m, e, f"n_{m}" if e == "conditional" else "n", f"{e[:4] if e == 'conditional' else 'eff'}_{m}") for m in metrics for e in ("conditional", "effective")]

    def long(rows: DataFrame, *others: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(e).alias("estimand"), F.col(n).cast("double").alias("n"), F.col(v).alias("v")) for m, e, n, v in pairs])
        return rows.select("method", *others, F.explode(each).alias("x")).select("method", *others, "x.*").where("n > 0")

    keys = ["method", "metric", "estimand"]
    whole = long(sums, "cluster").groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"), (F.sum("v") / F.sum("n")).alias("mean"))
    drawn = long(replicate_sums(sums, replicates, seed), "replicate").withColumn("m", F.col("v") / F.col("n"))
    ends = drawn.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))  # `replicates` values
    wanted = spark.createDataFrame([(method, m, e) for method in methods for m, e, _, _ in pairs], "method string, metric string, estimand string")
    both = wanted.join(whole, keys, "left").join(ends, keys, "left")
    none = F.when(F.col("estimand") == "effective", 0.0)
    end = lambda k: F.round(F.when(F.col("clusters").isNull(), none).when((F.col("clusters") == 1) | F.col("p").isNull(), F.col("mean")).otherwise(F.col("p")[k]), 6)
    return both.select(*keys, end(0).alias("low"), end(1).alias("high"))
