"""Run summaries, typed reading, projections, the whole report and small checks."""

import json

import pytest
from pyspark.sql import functions as F

from scorepool import sinks
from scorepool.constants import METRICS
from scorepool.operators import quality, summary
from scorepool.plans import analysis

GOOD = {"reward": {"total": 0.5, "alignment": 1, "violations": []}, "quality": {"semantic_point_coverage": 0, "cider_lite": 0.25, "repetition_rate": 0.125}}


def candidate(**changes):
    out = json.loads(json.dumps(GOOD))
    for name, value in changes.items():
        group, _, field = name.partition("__")
        if field and value is ...:
            del out[group][field]
        elif field:
            out[group][field] = value
        else:
            out[group] = value
    return out


@pytest.mark.parametrize(
    "value, issue",
    [
        (GOOD, None), (candidate(reward=[]), "candidate.reward must be an object."), (candidate(quality=None), "candidate.quality must be an object."), (candidate(reward__violations="no"), "candidate.reward.violations must be a list."),
        (candidate(reward__total=...), "Missing required field candidate.reward.total."), (candidate(reward__total=True), "candidate.reward.total must be numeric."), (candidate(reward__total="0.5"), "candidate.reward.total must be numeric."),
        (candidate(reward__alignment=None), "candidate.reward.alignment must be numeric."), (candidate(quality__cider_lite=1.5), "candidate.quality.cider_lite must be within [0, 1]."), (candidate(quality__repetition_rate=-1), "candidate.quality.repetition_rate must be within [0, 1]."),
    ],
)
def test_typed_reading(spark, value, issue):
    row = spark.createDataFrame([(json.dumps(value),)], "j string").select(F.parse_json("j").alias("v"))
    assert row.select(summary.candidate_issue(F.col("v"))).first()[0] == issue
    if issue:
        with pytest.raises(Exception, match="candidate"):
            row.select(summary.candidate_metrics(F.col("v"))).collect()
    else:
        assert row.select(summary.candidate_metrics(F.col("v")).alias("m")).first()["m"].asDict() == {"reward": 0.5, "mv_align": 1.0, "csr": 1.0, "semantic_point_coverage": 0.0, "cider_lite": 0.25, "rep": 0.125}


def test_numbers_with_a_floor(spark):
    row = spark.createDataFrame([('{"a": 2, "b": -0.5, "c": 1e3}',)], "j string").select(F.parse_json("j").alias("v"))
    got = row.select(*[summary.number_issue(F.col("v"), k, "x", 0).alias(k) for k in "abc"], summary.number_issue(F.col("v"), "b", "x").alias("free")).first()
    assert tuple(got) == (None, "x.b must be at least 0.", None, None)


def test_run_summary(spark):
    rows = [(4, json.dumps(GOOD), "video", "multimodal_model"), (4, json.dumps(candidate(reward__violations=["a"], reward__total=1)), "npz", None), (0, None, None, "replay"), (2, "null", "text", "multimodal_model")]
    frame = spark.createDataFrame(rows, "num_candidates int, j string, source_kind string, generation_source string").withColumn("best_candidate", F.parse_json("j"))
    got = {r["field"]: r["value"] for r in summary.run_summary(frame).collect()}
    assert got == {
        "num_samples": 4, "num_candidates": 10, "selected_output_success_count": 2, "selected_output_success_rate": 0.5, "real_video_rate": 0.5, "multimodal_generation_rate": 0.5, "selected_metrics.reward": 0.75, "selected_metrics.mv_align": 1,
        "selected_metrics.csr": 0.5, "selected_metrics.semantic_point_coverage": 0, "selected_metrics.cider_lite": 0.25, "selected_metrics.rep": 0.125, "source_kind_counts.video": 1, "source_kind_counts.npz": 1, "source_kind_counts.text": 1,
        "source_kind_counts.unknown": 1, "generation_source_counts.multimodal_model": 2, "generation_source_counts.unknown": 1, "generation_source_counts.replay": 1,
    }
    none = {r["field"]: r["value"] for r in summary.run_summary(frame.where("false")).collect()}
    assert none["num_samples"] == 0 and none["selected_output_success_rate"] == 0 and none["selected_metrics.rep"] is None and len(none) == 6 + len(METRICS)


def test_projections(spark):
    kind = "s struct<candidate_index:bigint,terminal_status:string,candidate_id:string,terminal_reason:string,request_count:bigint,transport_request_count:bigint,request_seconds:double,usage:struct<total:int>,attempts:array<int>>, points array<string>"
    row = spark.createDataFrame([((2, "failed", None, None, 8, 11, 1.23456789, (7,), [1]), ["a", "b"]), ((1, "ok", "c", "r", 1, 1, 0.5, (1,), []), None)], kind)
    got = row.select(summary.slot_view(F.col("s")).alias("v"), summary.coverage_audit(F.col("points"), F.lit("clues"), "enc", 0.5, ("narration",)).alias("a")).collect()
    assert tuple(got[0]["v"]) == (2, "failed", None, "", 8, 11, 1.234568, (7,)) and got[0]["a"].asDict()["reference_count"] == 2
    assert (got[1]["a"]["reference_available"], got[1]["a"]["reference_count"], got[1]["a"]["script_text_fields"]) == (False, 0, ["narration"])


def test_control_metadata():
    settings = dict.fromkeys(summary.CONTROL_FIELDS, 1) | {"risk_terms": ("a",), "other": 5}
    held = summary.control_metadata(settings, "m", "n")
    assert list(held) == [*summary.CONTROL_FIELDS, "_generation_runtime"] and held["risk_terms"] == ["a"] and held["_generation_runtime"]["model_id"] == "m"
    with pytest.raises(ValueError, match="pace"):
        summary.control_metadata({k: v for k, v in settings.items() if k != "pace"})


def test_own_key(spark):
    rows = spark.createDataFrame([("a", "v"), (" ", "v"), (None, "w")], "sample_key string, video_id string")
    assert [r[0] for r in rows.select(summary.own_key(rows)).collect()] == ["a", "v", "w"]
    with pytest.raises(Exception, match="neither"):
        bad = spark.createDataFrame([("", " ")], "sample_key string, video_id string")
        bad.select(summary.own_key(bad)).collect()


def test_prompt_protocol(spark):
    rows = [(1, 1, "base"), (1, 2, "retry"), (2, 1, "retry"), (3, 1, "base"), (3, 2, "base"), (4, 1, None), (5, 1, "base")]
    frame = spark.createDataFrame(rows, "slot int, attempt int, prompt_sha256 string")
    assert sorted(r["slot"] for r in quality.prompt_issues(frame, ["slot"], "base", "retry").collect()) == [2, 3, 4]


def test_results_are_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("v2", "b", None), ("v1", "z", 1), ("v2", "a", 2)], "video_id string, sample_key string, x int").repartition(3)
    for _ in range(2):  # a rewrite replaces
        sinks.write_results(rows, str(tmp_path / "r"))
    lines = [json.loads(line) for p in sorted((tmp_path / "r").glob("part-*")) for line in p.read_text().splitlines()]
    assert [(r["video_id"], r["sample_key"], r["x"]) for r in lines] == [("v1", "z", 1), ("v2", "a", 2), ("v2", "b", None)]


def test_whole_report(spark, tmp_path):
    rows = [(s, c, s * 10 + c, not (s == 2 and c == 1), None if s == 2 and c == 1 else c / 8, None if s == 2 and c == 1 else 0.5, 1.0, "v") for s in (1, 2) for c in (1, 2, 3, 4)]
    slots = spark.createDataFrame(rows, "sample_key int, candidate_index int, candidate_id int, valid boolean, reward double, rep double, seconds double, video_id string")
    done = analysis.analyze(slots, ("reward", "rep"), ("seconds",), replicates=5)
    done.write(str(tmp_path / "out"))
    text = (tmp_path / "out" / "report.md").read_text()
    assert "Requested samples: **2**; valid slots: **7**; failed slots: **1**." in text and text.count("| Method |") == 3
    lines = text.splitlines()
    assert "| First candidate | 0.5000 | 0.5000 | 0.0625 | 0.7500 |" in lines and "| Best of four | 1.0000 | 0.5000 | 0.5000 | 0.5000 |" in lines and "| Metric-wise bound | 1.0000 | 0.5000 | 0.5000 | 0.5000 |" in lines
    assert "| First candidate | 0.5000 | 0.5000 | 0.1250 | 0.5000 |" in lines and "| Best of four | 4.0000 |" in lines and [x for x in lines if x.startswith("## ")][0] == "## Effective means over all requested samples"
    assert "efficiency" not in analysis.analyze(slots, ("reward", "rep"), replicates=5).report()
    with pytest.raises(ValueError, match="no finite mean"):
        analysis.reports.analysis_report(done.integrity, analysis.reports.main_table(done.summary, done.bound, ("reward", "rep")), done.efficiency, ("reward", "rep"), ("seconds", "requests"))
