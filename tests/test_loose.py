"""Loosely typed rows, held against plain readings of the same JSON."""

import json

import pytest
from pyspark.sql import functions as F

from scorepool.sources import annotations, loose

VALUES = [
    0, 7, -3, 12345678901234567890123, 0.5, 1.0, -2.50, 1e16, 1.5e-5, 1e-4, 1e7, 123456789.125, 1e300, True, False, None, "", " x ", "é漢  ", 'q"\\"z', "back\\", "tab\tline\n", "[1]", "a, b", [], {}, [None], [[], []], [["a", " b "], "c"],
    {"z": 1, "a": ["x", {"k:": "v, w", "m": None}]}, {"b": {"c": [True, 1.0, "null", "true", "7"]}}, ['say "hi"', "comma, [brackets] {braces}: \\"], "\\" * 5000, "\"" * 5000, ["x" * 200_000, "\n" * 20_000 + "y"], [[[[[["deep"]]]]]],
]


def told(value):
    if value is None:
        return ""
    if isinstance(value, list):
        return " ".join(told(v) for v in value)
    if isinstance(value, dict):
        return " ".join(f"{k}: {told(v)}" for k, v in value.items())
    return str(value).strip()


@pytest.fixture(scope="module")
def held(spark):
    rows = spark.createDataFrame([(i, json.dumps({"x": v}, ensure_ascii=i % 2 == 0)) for i, v in enumerate(VALUES)], "i int, raw string")
    t, v = loose.texts(F.col("raw"), ["x"]), loose.variants(F.col("raw"), ["x"])
    return rows.select("i", loose.value(t["x"], v["x"]).alias("v"))


def test_texts_of_values(held):
    got = {r["i"]: r["p"] for r in held.select("i", loose.plain(F.col("v")).alias("p")).collect()}
    assert [got[i] for i in range(len(VALUES))] == [told(v) for v in VALUES]


def test_what_is_empty(held):
    got = {r["i"]: r["p"] for r in held.select("i", loose.truthy(F.col("v")).alias("p")).collect()}
    assert [got[i] for i in range(len(VALUES))] == [bool(v) for v in VALUES]


def samples(spark, rows):
    frame = spark.createDataFrame([(json.dumps({"id": i, "question": "q"} | row),) for i, row in enumerate(rows)], "raw string")
    return [r for _, r in sorted((int(r["video_id"]), r) for r in annotations.to_samples(frame).collect())]


def test_numbers(spark):
    numbers = [("12.5", 12.5), (" 1e3 ", 1000.0), ("1_000", 1000.0), (".5", 0.5), ("5.", 5.0), ("-Inf", float("-inf")), ("1.5d", None), ("0x10", None), ("", None), (None, None), (True, 1.0), (False, 0.0), (3, 3.0), ([1], None), ({}, None), ("long", None)]
    assert [s["duration"] for s in samples(spark, [{"duration": v} for v, _ in numbers])] == [n for _, n in numbers]


def test_lists(spark):
    lists = [
        ("a; b,", ["a", "b"]), ('["x", " ", "y"]', ["x", "y"]), ("[x, y]", ["[x", "y]"]), ("[1] or [2]", ["[1] or [2]"]), ("[1], [2]", ["[1]", "[2]"]), ([" a ", "", None, ["b", "c"], {"k": 1}], ["a", "b c", "k: 1"]), ([], []), (5, ["5"]),
        (True, ["True"]), ({"k": [1, 2]}, ["k: 1 2"]), ("一、二；三", ["一", "二", "三"]), (" [] ", []), (None, []),
    ]
    got = samples(spark, [{"clues": v} for v, _ in lists])
    assert [s["semantic_points"] for s in got] == [p for _, p in lists]
    assert [s["semantic_point_source_field"] for s in got] == ["" if v is None else "clues" for v, _ in lists]


def test_questions(spark):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    asked = [
        ({"choices": [], "option0": "x"}, "A. x"), ({"choices": "none", "option0": "x", "option1": None, "option2": 3, "option4": "no"}, "A. x B. 3"), ({"options": {"B": 1.0, "A": ["x", "y"], "C": " "}}, "A. x y B. 1.0"),
        ({"option1": "x"}, ""), ({"candidates": [" ", ""]}, ""), ({"choices": ["x"] * 27}, " ".join(f"{m}. x" for m in [*letters, "26"])), ({"choices": {}, "candidates": ["y"]}, ""),
        ({f"option{i}": str(i) for i in range(30)}, " ".join(f"{m}. {i}" for i, m in enumerate(letters))),
    ]
    assert [s["question"] for s in samples(spark, [row for row, _ in asked])] == [f"q Options: {t}" if t else "q" for _, t in asked]


def test_captions(spark):
    subtitles = [{"from": 0, "sentence": " s "}, {"start": "1 ", "text": "t"}, {"text": "", "content": "u"}, {"start": 2}, 7, None, []]
    said = [
        ({"caption": " a ", "prompt": " b "}, "a   b"), ({"desc": 0, "prompt": "b"}, "b"), ({"caption": "c", "asr": subtitles}, "c [0] s [1 ] t u 7"), ({"transcript": "plain"}, "plain"), ({"subtitle": {"a": 1}}, "a: 1"), ({}, ""),
        ({"subtitles": []}, ""), ({"subtitles": [{"start": 1.0, "text": ["a", "b"]}]}, "[1.0] a b"),
    ]
    assert [s["caption"] for s in samples(spark, [row | {"question": ""} for row, _ in said])] == [t for _, t in said]


def test_rows_that_are_no_objects(spark):
    for raw in ("[1]", "5", "{bad", '{"id": {"x": 1, "x": 2}}'):
        with pytest.raises(Exception, match="not an object|MALFORMED"):
            annotations.to_samples(spark.createDataFrame([(raw,)], "raw string")).collect()
    last = annotations.to_samples(spark.createDataFrame([('{"id": 1, "id": 2, "extra": [1]}',)], "raw string")).first()
    assert last["video_id"] == "2"


def test_samples_need_no_python(spark):
    plan = annotations.to_samples(spark.createDataFrame([('{"id": 1}',)], "raw string"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan and plan.count("from_json(StructField(video_id") <= 2
