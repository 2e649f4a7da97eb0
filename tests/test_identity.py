import json

import pytest
from pyspark.sql import functions as F

from scorepool import config
from scorepool.constants import CANDIDATES, FRAMES_MAX, REWARD_WEIGHTS
from scorepool.functions import text, vectors
from scorepool.operators import identity, quality, stats
from scorepool.sources import files

GOOD = ("valid_json_candidate", False, False, False, "raw_json")


@pytest.mark.parametrize(
    "place, value, word",
    [(0, None, "parse_status"), (1, True, "semantic_repair"), (2, None, "wrapped"), (3, True, "surrounding"), (4, "other", "envelope"), (4, "single_markdown_json_fence", None), (0, GOOD[0], None)],
)
def test_provenance(spark, place, value, word):
    row = list(GOOD)
    row[place] = value
    got = spark.createDataFrame([(tuple(row),)], f"p {identity.PROVENANCE}").select(identity.provenance_issue(F.col("p"))).first()[0]
    assert got is None if word is None else word in got


def test_generation_issues(spark):
    said = {"server_protocol_version": "p1", "configured_max_frames": str(FRAMES_MAX), "checkpoint_revision": "r"}
    good = ("accepted", 1, said, 4)
    bad = [("endpoint_error", 1, said, 4), ("accepted", 2, said, 4), ("accepted", 1, None, 4), ("accepted", 1, said | {"server_protocol_version": "p0"}, 4), ("accepted", 1, said | {"configured_max_frames": "8"}, 4), ("accepted", 1, said | {"checkpoint_revision": "s"}, 4), ("accepted", 1, said, 3)]
    schema = "sample_key int, candidate_index int, frames int, attempts array<struct<status: string, transport_request_count: int, server_metrics: map<string,string>, visual_input_frames: int>>"
    slots = spark.createDataFrame([(0, 1, 4, [good] * 2), (1, 1, 4, [good, *bad])], schema)
    got = sorted(map(tuple, identity.generation_issues(slots, {"checkpoint_revision": "r"}, "p1").collect()))
    assert [g[:3] for g in got] == [(1, 1, k) for k in range(2, 9)]
    for (*_, issue), word in zip(got, ("failed", "more than once", "lacks", "protocol", "frame cap", "checkpoint_revision", "number of frames"), strict=True):
        assert word in issue


def test_service_and_config():
    entry = {"id": "m", "max_frames": 16, "frame_input_policy": identity.FRAME_POLICY}
    assert identity.advertised([entry, {"id": "x"}], "m") is entry
    for models, word in (([entry, entry], "exactly once"), ([], "exactly once"), ([entry | {"max_frames": True}], "frames"), ([entry | {"frame_input_policy": ""}], "resample")):
        with pytest.raises(ValueError, match=word):
            identity.advertised(models, "m")
    good = {"candidates": CANDIDATES, "max_frames": FRAMES_MAX, "reward_weights": dict(REWARD_WEIGHTS), "other": 1}
    identity.check_config(good)
    with pytest.raises(ValueError, match="max_frames, reward_weights.risk"):
        identity.check_config(good | {"max_frames": 8, "reward_weights": REWARD_WEIGHTS | {"risk": 0.5}})
    assert identity.differing({"a": {"b": 1, "c": True}}, {"a": {"b": 1, "c": 1}, "d": 0}) == ["a.c", "d"]


def test_matrix_and_seeds(spark):
    made = list(config.matrix({"seed": 42, "x": {"y": 1}}, {"d1": {"path": "a"}, "d2": {}}, {"m": {"url": "u"}}, "runs/"))
    assert [c["output"] for c in made] == ["runs/d1/m", "runs/d2/m"] and made[0]["dataset"] == {"name": "d1", "path": "a"}
    assert made[0]["fingerprint"] != made[1]["fingerprint"] and made[0]["x"] is not made[1]["x"]
    with pytest.raises(ValueError, match="project-relative"):
        list(config.matrix({}, {"d": {}}, {"m": {}}, "/abs"))
    rows = spark.createDataFrame([("v", 1, 1), ("v", 2, 3)], "v string, c int, a int").select(config.request_seed(F.col("v"), F.col("c"), F.col("a"), 42)).collect()
    assert rows[1][0] - rows[0][0] == 10_002
    assert config.seed_everything(3).random() == config.seed_everything(3).random() and config.environment(spark)["spark"] == spark.version


def test_tails_templates_and_points(spark):
    rows = spark.createDataFrame([([1, 2] * 64,), ([1] * 127,), (list(range(120)) + [5] * 8,), (list(range(130)),), ([0] * 120 + [1, 2, 3] * 8,)], "t array<int>")
    assert [r[0] for r in rows.select(text.repeated_tail(F.col("t"))).collect()] == [2, None, 1, None, 3]
    made = spark.createDataFrame([("cat", None)], "a string, b string").select(text.filled("Say {a} and {b}!", a=F.col("a"), b=F.col("b")).alias("p"))
    got = made.select(text.prompts(F.col("p"), " Again.").alias("q")).first()["q"]
    assert got["base"] == "Say cat and !" and got["retry"] == "Say cat and ! Again." and got["base_sha256"] != got["retry_sha256"]
    points = spark.createDataFrame([([" a", "b", "", "a", None],)], "p array<string>").select(vectors.distinct_points(F.col("p"))).first()[0]
    assert points == ["a", "b"]


def test_transports_and_counts(spark):
    schema = "k int, status string, prompt_kind string, request_seconds double, transports array<struct<status: string, request_seconds: double, backoff_seconds_after: double>>"
    rows = spark.createDataFrame([(1, "accepted", "base", 2.0, None), (1, "rejected", None, 9.0, [("error", 1.0, 1.5), ("success", 2.0, 0.0)])], schema)
    assert tuple(stats.transports(rows, ("k",)).first()) == (1, 3, 1, 5.0, 1.5)
    assert sorted(map(tuple, stats.attempt_counts(rows).collect())) == [("prompt_kind", "base", 1), ("prompt_kind", "unknown", 1), ("status", "accepted", 1), ("status", "rejected", 1)]


def test_check_points(spark):
    rows = lambda *r: spark.createDataFrame(r, "video_id string, semantic_points array<string>, semantic_point_source_field string")
    bad = F.when(F.size("semantic_points") != 2, F.lit("not two"))
    quality.check_points(rows(("a", ["x", "y"], "semantic_points")), bad)
    for row, word in ((("b", None, "semantic_points"), "1 samples lack reference points: b"), (("b", ["x"], "clues"), "another field: b: not two"), (("b", ["x"], "semantic_points"), "invalid reference points: b: not two")):
        with pytest.raises(ValueError, match=word):
            quality.check_points(rows(("a", ["x", "y"], "semantic_points"), row), bad)


def test_existing_results(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in ({"sample_key": "a", "v": 1}, {"sample_key": " ", "v": 2})))
    with pytest.raises(ValueError, match="blank or repeated"):
        files.read_results(spark, str(path), "sample_key string, v int")
    got = files.read_results(spark, str(path), "sample_key string, v int", F.concat(F.lit("k"), F.col("v")))
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("k2", 2)]
    with pytest.raises(ValueError, match="blank or repeated"):
        files.read_results(spark, str(path), "sample_key string, v int", F.lit("a"))
