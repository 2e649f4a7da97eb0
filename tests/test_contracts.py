import copy

import pytest
from pyspark.sql import functions as F

from scorepool.operators import contracts
from scorepool.plans import analysis

ATTEMPT = {"attempt": 1, "prompt_kind": "base_generation", "status": "accepted", "request_seconds": 1.0, "returned_model_id_conflict": None, "visual_input_frames": 2}
USAGE = {"input_tokens": 2, "output_tokens": 3, "total_tokens": 5}


def good():
    slots = [{"candidate_index": i, "terminal_status": "valid", "candidate_id": f"c{i}", "request_count": 1, "transport_request_count": 1, "request_seconds": 1.0, "usage": dict(USAGE), "attempts": [dict(ATTEMPT)]} for i in range(1, 5)]
    once = {"requests": 1, "semantic_attempts": 1, **USAGE}
    efficiency = {f"{who}_{k}": n * v for who, n in (("generation", 4), ("direct", 1), ("best", 4)) for k, v in once.items()} | {
        "sampled_frames": 2, "seconds_by_slot": [1.0] * 4, "usage_by_slot": [dict(USAGE) for _ in range(4)],
        "sampling_seconds": 0.5, "reward_encoding_seconds": 0.1, "reward_scoring_seconds": 0.4, "selection_seconds": 0.0, "direct_seconds": 1.5, "best_seconds": 5.0, "generation_seconds": 4.0, "metric_seconds": 0.2, "pipeline_seconds": 6.0, "scoring_seconds_by_slot": [0.1] * 4,
    }
    return {
        "sample_key": "s", "video_id": "v", "experiment_version": "e", "prompt_version": "q", "requested_slots": 4, "protocol_fingerprint": "p", "generation_source": "multimodal_model",
        "sampling": {"source_kind": "video", "fallback_used": False, "eligible": True, "selected_indices": [0, 3], "bin_ids": [0, 1]},
        "slots": slots, "candidates": [{"candidate_index": i, "candidate_id": f"c{i}", "reward": r} for i, r in zip(range(1, 5), (0.1, 0.5, 0.5, 0.2), strict=True)],
        "valid_slots": 4, "full_pool": True, "direct_id": "c1", "best_id": "c2", "efficiency": efficiency,
    }


def put(row, path, value):
    *way, last = path
    for k in way:
        row = row[k]
    row[last] = value


CASES = [
    (("protocol_fingerprint",), "x", "protocol_fingerprint"), (("generation_source",), None, "multimodal"), (("sampling",), None, "sampling is missing"), (("sampling", "source_kind"), "made", "real source"),
    (("sampling", "fallback_used"), True, "fallback"), (("sampling", "eligible"), None, "eligible"), (("sampling", "selected_indices"), [3, 0], "not_increasing"), (("sampling", "bin_ids"), [0, 8], "bin_range"),
    (("slots",), None, "incomplete"), (("candidates",), None, "candidates is missing"), (("slots", 1, "candidate_index"), 3, "C1-C4"), (("slots", 0, "terminal_status"), "odd", "terminal status"),
    (("slots", 0, "terminal_status"), "failed", "do not match"), (("slots", 2, "candidate_id"), "z", "identifiers do not match"), (("slots", 0, "attempts"), [], "no attempts"), (("slots", 0, "attempts", 0, "attempt"), 2, "misnumbered"),
    (("slots", 0, "attempts", 0, "status"), "endpoint_error", "invalid status"), (("slots", 0, "attempts", 0, "visual_input_frames"), 3, "frames"), (("slots", 0, "attempts", 0, "status"), "parse_rejected", "disagree"),
    (("slots", 0, "request_count"), 2, "request_count"), (("slots", 0, "request_seconds"), 1.1, "request_seconds"), (("slots", 0, "usage", "total_tokens"), 6, "add up"), (("efficiency",), None, "efficiency is missing"),
    (("efficiency", "generation_requests"), 5, "generation_requests"), (("efficiency", "sampled_frames"), 3, "sampled_frames"), (("efficiency", "selection_seconds"), -1.0, "not a duration"), (("efficiency", "direct_seconds"), 2.0, "direct_seconds"),
    (("experiment_version",), "x", "experiment_version"), (("prompt_version",), None, "prompt_version"), (("requested_slots",), 3, "requested slot count"),
    *[(("efficiency", name), 99, name) for name in contracts.COUNTS], (("efficiency", "metric_seconds"), float("inf"), "not a duration"),
    (("efficiency", "seconds_by_slot"), [1.0] * 3, "seconds by slot are invalid"), (("efficiency", "seconds_by_slot", 2), 1.5, "seconds by slot differ"), (("efficiency", "usage_by_slot", 3, "input_tokens"), 3, "usage by slot"),
    (("efficiency", "scoring_seconds_by_slot"), [0.1] * 3, "scoring seconds by slot"), (("efficiency", "best_seconds"), 2.0, "best_seconds"), (("efficiency", "generation_seconds"), 3.0, "shorter than its requests"), (("efficiency", "pipeline_seconds"), 4.0, "shorter than its parts"), (("efficiency", "scoring_seconds_by_slot"), [0.2] * 4, "add up"),
    (("valid_slots",), 3, "valid_slots"), (("full_pool",), False, "full_pool"), (("candidates", 0, "reward"), 1.5, "outside 0 to 1"), (("direct_id",), "c2", "not C1"), (("best_id",), "c3", "not the best"),
]


def test_one_violation_each(spark):
    rows = [good()]
    for path, value, _ in CASES:
        row = copy.deepcopy(good())
        put(row, path, value)
        rows.append(row)
    frame = spark.createDataFrame([r | {"sample_key": str(i)} for i, r in enumerate(rows)], contracts.RESULT)
    got = {int(r["sample_key"]): r["issue"] for r in contracts.with_issues(frame, "p", "e", "q").collect()}
    assert got[0] is None
    for i, (path, _, word) in enumerate(CASES, 1):
        assert got[i] and word in got[i], (path, got[i])


def test_tolerance(spark):
    row = good()
    row["slots"][0]["request_seconds"] = 1.000004
    assert contracts.with_issues(spark.createDataFrame([row], contracts.RESULT), "p").first()["issue"] is None


def test_resume(spark):
    frame = spark.createDataFrame([good(), good() | {"sample_key": "t", "best_id": "c4"}], contracts.RESULT)
    got = contracts.resume_issues(frame, spark.createDataFrame([("t",)], "sample_key string"), "p").collect()
    assert sorted((r["sample_key"], r["issue"]) for r in got) == [("s", "not a current sample"), ("t", "the selected candidate is not the best")]


SLOTS = [(k, k % 2, i, f"{k}-{i}", not (k == 2 and i < 4), 0.1 * i if not (k == 2 and i < 4) else None, 1.5) for k in range(3) for i in range(1, 5)]


def test_analysis_and_matrix_row(spark, tmp_path):
    slots = spark.createDataFrame(SLOTS, "sample_key int, video_id int, candidate_index int, candidate_id string, valid boolean, reward double, seconds double")
    a = analysis.analyze(slots, ("reward",), ("seconds",), replicates=20)
    a.write(str(tmp_path))
    assert (tmp_path / "summary.md").exists() and a.intervals.count() == 4 and a.upper_bound.count() == 3
    row = contracts.matrix_row(a.summary, "d", "m", ("reward",))
    assert row.select(contracts.matrix_row_issue(("reward",))).first()[0] is None
    for change, word in ((F.lit(0), "not positive"),):
        assert word in row.withColumn("requested", change).select(contracts.matrix_row_issue(("reward",))).first()[0]
    worse = row.withColumn("best_of_4_eff_reward", F.col("best_of_4_eff_reward") + 0.1)
    assert "disagree" in worse.select(contracts.matrix_row_issue(("reward",))).first()[0]
    with pytest.raises(ValueError, match="no slots"):
        analysis.analyze(slots.where("false"), ("reward",))
    with pytest.raises(ValueError, match="1 to 4"):
        analysis.analyze(slots.where("candidate_index < 4"), ("reward",))


def test_server_metrics(spark):
    rows = spark.createDataFrame([('{"model": "a", "server_metrics": {"x": 1, "y": {"z": 2}, "returned_model_id": "b"}}',), ("{}",)], "r string")
    a, b = (r[0] for r in rows.select(contracts.server_metrics(F.parse_json("r"))).collect())
    assert a["metrics"] == {"x": "1", "returned_model_id": "b"} and a["conflict"] and a["returned_model_id"] == "a"
    assert b["metrics"] == {} and not b["conflict"]
