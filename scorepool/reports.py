"""Report tables and their Markdown: main results, efficiency, one run's metrics, and the matrix of datasets and models."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorepool.constants import LOWER_IS_BETTER
from scorepool.operators import contracts
from scorepool.operators.stats import effective
from scorepool.sinks import markdown, write_json, write_text

BOUND = "metric_wise_upper_bound"
LABELS = {"direct": "First candidate", "best_of_4": "Best of four", BOUND: "Metric-wise bound"}


def bound_summary(slots: DataFrame, metrics: tuple[str, ...], key: str = "sample_key") -> DataFrame:
    """The summary row of the metric-wise bound: each metric's best value of any valid candidate, by sample, then over all samples."""
    best = lambda m: (F.min if m in LOWER_IS_BETTER else F.max)(F.when(F.col("valid"), F.col(m))).alias(m)
    per = slots.groupBy(key).agg(F.count_if("valid").alias("_n"), F.count(F.lit(1)).alias("_of"), *[best(m) for m in metrics])
    means = [c for m in metrics for c in (F.avg(m).alias(f"cond_{m}"), F.avg(effective(m)).alias(f"eff_{m}"))]
    return per.agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(F.col("_n") > 0).alias("ok"), F.avg((F.col("_n") > 0).cast("int")).alias("success_rate"), F.count_if(F.col("_n") == F.col("_of")).alias("exact_prefix"), *means
    ).select(F.lit(BOUND).alias("method"), "*")


def main_table(summary: DataFrame, bound: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """A row for each method and one for the bound: counts, rates, conditional and effective means (17 columns for six metrics)."""
    columns = [
        "method", F.col("requested").alias("requested_samples"), F.col("ok").alias("successful_samples"), F.col("success_rate").alias("selection_success_rate"),
        (F.col("exact_prefix") / F.col("requested")).alias("complete_requested_prefix_rate"),
        *[F.col(f"cond_{m}").alias(f"conditional_{m}") for m in metrics], *[F.col(f"eff_{m}").alias(f"effective_{m}") for m in metrics],
    ]
    return summary.select(*columns).unionByName(bound.select(*columns))


def efficiency_table(efficiency: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The methods' mean of each efficiency key, a column each; the bound has none."""
    wide = efficiency.groupBy("method").pivot("key", list(keys)).agg(F.first("mean"))
    return wide.select("method", *[F.col(f"`{k}`").alias(f"mean_{k}") for k in keys])


def _section(title: str, note: str, columns: list[str], rows: list[list]) -> str:
    table = markdown("", columns, rows).split("\n\n", 1)[1]
    return f"## {title}\n\n" + (f"{note}\n\n" if note else "") + table


def _means(rows: list[dict], names: tuple[str, ...], metrics: tuple[str, ...], kind: str) -> list[list]:
    return [[r[n] for n in names] + [LABELS.get(r["method"], r["method"]), r["selection_success_rate"], *[r[f"{kind}_{m}"] for m in metrics]] for r in rows]


def _report(title: str, head: str, rows: list[dict], spent: list[dict], names: tuple[str, ...], metrics: tuple[str, ...], keys: tuple[str, ...]) -> str:
    columns = [*names, "method", "success", *metrics]
    parts = [
        f"# {title}\n\n{head}" if head else f"# {title}\n",
        _section("Effective means, all requested samples", "A sample without a selection counts as the worst value. The bound takes each metric's best candidate by itself, so it is no output one could deliver.", columns, _means(rows, names, metrics, "effective")),
        _section("Conditional means, successful selections", "", columns, _means(rows, names, metrics, "conditional")),
        _section("Mean efficiency of a requested sample", "", [*names, "method", *keys], [[r[n] for n in names] + [LABELS.get(r["method"], r["method"]), *[r[f"mean_{k}"] for k in keys]] for r in spent]),
    ]
    return "\n".join(parts)


def analysis_report(integrity: DataFrame, table: DataFrame, efficiency: DataFrame, metrics: tuple[str, ...], keys: tuple[str, ...]) -> str:
    """The whole Markdown of a failure-aware analysis: slots and samples, what the bound means, effective and conditional means of every
    method and of the bound with success and complete prefixes, and the methods' mean efficiency. integrity is stats.pool_integrity's
    row, table main_table's, efficiency stats.efficiency's by method. A mean that is absent or infinite in the efficiency is an error."""
    held, rows = integrity.first(), [r.asDict() for r in table.collect()]
    order = {m: i for i, m in enumerate(LABELS)}
    rows.sort(key=lambda r: order.get(r["method"], len(order)))
    spent: dict[str, dict[str, float]] = {}
    for r in efficiency.where(F.col("key").isin(list(keys))).select("method", "key", "mean").collect():
        spent.setdefault(r["method"], {})[r["key"]] = r["mean"]
    for method, means in spent.items():
        if bad := [k for k in keys if means.get(k) is None or not math.isfinite(means[k])]:
            raise ValueError(f"{method} has no finite mean of {bad}")
    head = (
        f"Requested samples: **{held['samples']}**; valid slots: **{held['valid_slots']}**; failed slots: **{held['slots'] - held['valid_slots']}**.\n\n"
        "The metric-wise bound takes, for each metric by itself, the best valid candidate of a sample. Its values may come from different candidates, so it is no output one could deliver.\n"
    )
    columns = ["Method", "Success", "Complete requested prefix", *metrics]
    means = lambda kind: [[LABELS.get(r["method"], r["method"]), r["selection_success_rate"], r["complete_requested_prefix_rate"], *[r[f"{kind}_{m}"] for m in metrics]] for r in rows]
    worst = f"A failed selection counts as 0, and as 1 where less is better ({', '.join(LOWER_IS_BETTER)})."
    parts = [
        f"# Failure-aware analysis of the candidate pool\n\n{head}", _section("Effective means over all requested samples", worst, columns, means("effective")),
        _section("Conditional means over successful selections only", "", columns, means("conditional")),
    ]
    if keys:
        parts.append(_section("Mean efficiency over all requested samples", "", ["Method", *keys], [[LABELS.get(m, m), *[spent[m][k] for k in keys]] for m in sorted(spent, key=lambda m: order.get(m, len(order)))]))
    return "\n".join(parts)


def metrics_report(facts: dict, table: DataFrame, efficiency: DataFrame, metrics: tuple[str, ...], keys: tuple[str, ...]) -> str:
    """One run's Markdown: its facts, then the means and the efficiency of each method. table and efficiency are report-sized."""
    head = markdown("", ["field", "value"], [[f"`{k}`", v] for k, v in facts.items()]).split("\n\n", 1)[1]
    return _report("Run metrics", head, [r.asDict() for r in table.collect()], [r.asDict() for r in efficiency.collect()], (), metrics, keys)


def metrics_text(facts: dict, table: DataFrame, metrics: tuple[str, ...]) -> str:
    """The same for a console."""
    lines = [f"{k}: {v}" for k, v in facts.items()]
    for r in table.collect():
        for kind in ("effective", "conditional"):
            lines.append(f"{LABELS.get(r['method'], r['method'])}, {kind}: " + ", ".join(f"{m}={r[f'{kind}_{m}']}" for m in metrics))
    return "\n".join(lines) + "\n"


#: What names a row of the matrix.
MATRIX_KEYS = ("dataset", "model")


def matrix_report(table: DataFrame, efficiency: DataFrame, metrics: tuple[str, ...], keys: tuple[str, ...]) -> str:
    """The matrix's Markdown: main and efficiency tables with dataset and model before each method."""
    ordered = lambda d: [r.asDict() for r in d.orderBy(*MATRIX_KEYS, "method").collect()]
    return _report("Experiment matrix", "", ordered(table), ordered(efficiency), MATRIX_KEYS, metrics, keys)


def write_matrix(folder: str, rows: DataFrame, table: DataFrame, efficiency: DataFrame, metrics: tuple[str, ...], keys: tuple[str, ...]) -> None:
    """matrix.json, a list of wide rows in order, and matrix.md."""
    write_json(f"{folder}/matrix.json", [json.loads(r) for r in rows.orderBy(*MATRIX_KEYS).toJSON().collect()])
    write_text(f"{folder}/matrix.md", matrix_report(table, efficiency, metrics, keys))


def read_matrix(spark: SparkSession, path: str, schema: str, metrics: tuple[str, ...]) -> DataFrame:
    """An earlier matrix.json. An error for a row that breaks its contract or a dataset and model given twice."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    bad = rows.withColumn("issue", contracts.matrix_row_issue(metrics)).where("issue is not null").orderBy(*MATRIX_KEYS).limit(5).collect()
    if bad:
        raise ValueError(f"matrix rows are broken: {[(r['dataset'], r['model'], r['issue']) for r in bad]}")
    twice = rows.groupBy(*MATRIX_KEYS).count().where("count > 1").orderBy(*MATRIX_KEYS).limit(5).collect()
    if twice:
        raise ValueError(f"given more than once: {[(r['dataset'], r['model']) for r in twice]}")
    return rows
