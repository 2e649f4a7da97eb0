import json

import pytest
from pyspark.sql import functions as F

from scorepool import reports, sinks
from scorepool.operators import contracts, selection, stats
from scorepool.sources import annotations, manifests

M = ("reward", "rep")
SLOTS = [(1, 1, "a", True, 0.2, 0.5), (1, 2, "b", True, 0.4, 0.7), (2, 1, "c", False, None, None), (2, 2, "d", False, None, None)]


@pytest.fixture(scope="module")
def tables(spark):
    slots = spark.createDataFrame(SLOTS, "sample_key int, candidate_index int, candidate_id string, valid boolean, reward double, rep double")
    summary = stats.summarize_methods(selection.selections(slots, M), M)
    main = reports.main_table(summary, reports.bound_summary(slots, M), M)
    spent = stats.efficiency(spark.createDataFrame([("direct", 1.0, 2.0), ("direct", 3.0, 2.0), ("best_of_4", 5.0, 8.0)], "method string, seconds double, requests double"), ("seconds", "requests"), ("method",))
    return summary, main, reports.efficiency_table(spent, ("seconds", "requests"))


def test_main_table(tables):
    rows = {r["method"]: r for r in tables[1].collect()}
    assert len(tables[1].columns) == 5 + 2 * len(M) and set(rows) == {"direct", "best_of_4", reports.BOUND}
    bound = rows[reports.BOUND]
    assert (bound["requested_samples"], bound["successful_samples"], bound["conditional_reward"], bound["conditional_rep"]) == (2, 1, 0.4, 0.5)
    assert (bound["effective_reward"], bound["effective_rep"], bound["complete_requested_prefix_rate"]) == (0.2, 0.75, 0.5)
    assert {r["method"]: r["mean_seconds"] for r in tables[2].collect()} == {"direct": 2.0, "best_of_4": 5.0}


def test_reports(tables, tmp_path, spark):
    _, main, spent = tables
    text = reports.metrics_report({"samples": 2}, main, spent, M, ("seconds", "requests"))
    assert "| `samples` | 2 |" in text and "| Metric-wise bound | 0.5000 | 0.2000 | 0.7500 |" in text and "| First candidate | 2.0000 | 2.0000 |" in text
    assert "Best of four, conditional: reward=0.4, rep=0.7" in reports.metrics_text({"samples": 2}, main, M)
    keyed = [d.select(F.lit("d").alias("dataset"), F.lit("m").alias("model"), "*") for d in (main, spent)]
    row = contracts.matrix_row(tables[0], "d", "m", M)
    reports.write_matrix(str(tmp_path), row, *keyed, M, ("seconds", "requests"))
    assert "| d | m | Best of four | 0.5000 | 0.2000 | 0.8500 |" in sinks.read_text(str(tmp_path / "matrix.md"))
    schema = row.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    assert reports.read_matrix(spark, str(tmp_path / "matrix.json"), schema, M).count() == 1
    held = json.loads(sinks.read_text(str(tmp_path / "matrix.json")))
    sinks.write_json(str(tmp_path / "twice.json"), held * 2)
    sinks.write_json(str(tmp_path / "broken.json"), [held[0] | {"requested": 0}])
    for name, word in (("twice", "more than once"), ("broken", "not positive")):
        with pytest.raises(ValueError, match=word):
            reports.read_matrix(spark, str(tmp_path / f"{name}.json"), schema, M)


def test_status_and_failures(spark, tmp_path):
    sinks.write_status(str(tmp_path / "status.json"), "complete", samples=3)
    assert json.loads(sinks.read_text(str(tmp_path / "status.json"))) == {"status": "complete", "samples": 3}
    assert sinks.read_text(str(tmp_path / "none.json")) is None
    rows = spark.createDataFrame([("a", 4, "x"), ("b", 1, "y"), ("c", None, "z")], "sample_key string, valid_slots int, other string")
    assert sorted(map(tuple, sinks.failures(rows).collect())) == [("b", 1, 3), ("c", None, 4)]


ROWS = [{"id": "1", "question": "why?", "options": ["x", "y"], "correct_idx": 1}, {"id": "2", "query": " how ", "answer": "so", "choices": []}]


def test_manifest(spark, tmp_path):
    source = tmp_path / "in.json"
    source.write_text(json.dumps({"items": ROWS}))
    samples = annotations.to_samples(annotations.read_json(spark, str(source), strict=True))
    summary = manifests.write_manifest(samples, str(tmp_path / "out"), "demo", str(source))
    assert (summary["samples"], summary["total_semantic_points"]) == (2, 4)
    rows = sorted((json.loads(r[0])["row"] for r in spark.read.text(str(tmp_path / "out")).collect()), key=lambda r: r["id"])
    assert rows[0]["semantic_points"] == ["Evidence context: why?", "Expected answer: y"] and rows[1]["semantic_points"] == ["Evidence context: how", "Expected answer: so"]
    origin = rows[0]["semantic_point_provenance"]
    assert (origin["answer_source_field"], origin["choice_source_field"], origin["reference_enters_reward"]) == ("correct_idx", "options", False)
    assert json.loads(sinks.read_text(str(tmp_path / "out.protocol.json")))["wrapper_key"] == "items"
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        manifests.write_manifest(samples, str(tmp_path / "out"), "demo", str(source))
    with pytest.raises(ValueError, match="replace its source"):
        manifests.write_manifest(samples, str(source), "demo", str(source))


@pytest.mark.parametrize(
    "row, answer, issue",
    [
        ({"question": "q", "answer": "a", "semantic_points": ["x"]}, "a", "already exist"), ({"question": " ", "answer": "a"}, "a", "question is blank"), ({"question": "q"}, "", "answer is blank"),
        ({"question": "q", "answer": "b", "options": ["x"]}, "b", "not expanded"), ({"question": "q", "answer": "b", "options": []}, "b", None), ({"question": "q", "answer": "B", "options": ["x", "y"]}, "y", None),
        ({"question": [], "query": "q", "answer": {}, "label": "a", "semantic_points": []}, "a", None),
    ],
)
def test_manifest_issues(row, answer, issue):
    text, got = manifests.annotate(json.dumps(row), answer)
    assert (got is None and text) if issue is None else (text is None and issue in got)


def test_manifest_is_all_or_nothing(spark):
    rows = spark.createDataFrame([(json.dumps(r),) for r in [*ROWS, {"id": "3", "question": "q"}]], "raw string")
    with pytest.raises(ValueError, match="1 rows: 3: answer is blank"):
        manifests.build_manifest(annotations.to_samples(rows))
