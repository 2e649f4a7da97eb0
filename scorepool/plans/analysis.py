"""The failure-aware analysis of a candidate pool, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorepool import reports
from scorepool.constants import BOOTSTRAP_REPLICATES, BOOTSTRAP_SEED, PREFIX_METHODS
from scorepool.operators import bootstrap, quality, selection, stats
from scorepool.sinks import write_analysis, write_text


@dataclass
class Analysis:
    selections: DataFrame
    upper_bound: DataFrame
    summary: DataFrame
    intervals: DataFrame
    efficiency: DataFrame
    integrity: DataFrame
    bound: DataFrame
    metrics: tuple[str, ...]
    sums: tuple[str, ...]

    def write(self, folder: str) -> None:
        """The bundle, and report.md with every section."""
        write_analysis(folder, self.summary, self.selections, self.efficiency)
        write_text(f"{folder}/report.md", self.report())

    def report(self) -> str:
        table = reports.main_table(self.summary, self.bound, self.metrics)
        return reports.analysis_report(self.integrity, table, self.efficiency if self.sums else self.efficiency.withColumn("mean", F.lit(None)), self.metrics, self.sums)


def analyze(slots: DataFrame, metrics: tuple[str, ...], sums: tuple[str, ...] = (), cluster: str = "video_id", replicates: int = BOOTSTRAP_REPLICATES, seed: int = BOOTSTRAP_SEED) -> Analysis:
    """slots: sample_key, the cluster, candidate_index, candidate_id, valid, metrics, and columns to sum over each method's slots.

    An error for no slots, for samples without exactly four ordered candidates, and if candidate 1 beats the best.
    """
    if slots.isEmpty():
        raise ValueError("no slots to analyse")
    if bad := quality.slot_order_issues(slots).limit(5).collect():
        raise ValueError(f"samples without candidates 1 to 4: {[r['sample_key'] for r in bad]}")
    if bad := quality.ordering_violations(slots, selection.best_of(slots)).orderBy("sample_key").limit(5).collect():
        raise ValueError(f"candidate 1 beats the best: {[r['sample_key'] for r in bad]}")
    picked = selection.selections(slots, metrics)
    clusters = slots.groupBy("sample_key").agg(F.first(cluster).alias(cluster))
    summary = stats.summarize_methods(picked, metrics)
    each = stats.method_efficiency(slots, sums, PREFIX_METHODS) if sums else None
    spent = stats.efficiency(each, sums, ("method",)) if each is not None else slots.sparkSession.createDataFrame([], "method string, key string")
    return Analysis(
        picked, selection.upper_bound(slots, metrics), summary, bootstrap.cluster_intervals(picked.join(clusters, "sample_key"), metrics, cluster, tuple(PREFIX_METHODS), replicates, seed), spent, stats.pool_integrity(slots), reports.bound_summary(slots, metrics), metrics, sums
    )
