import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorepool import models, sinks
from scorepool.sources import annotations as A
from scorepool.sources import files, manifests
from scorepool.operators import fingerprint
from scorepool.streaming import resume


def rows(frame):
    return [json.loads(r["raw"]) for r in frame.collect()]


def test_jsonl_skips_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert [r["id"] for r in rows(A.read_annotations(spark, str(tmp_path / "a.jsonl")))] == [1, 2]


@pytest.mark.parametrize("key", ["data", "samples", "annotations", "items", "questions", "qa", "qas"])
def test_json_wrappers(spark, tmp_path, key):
    (tmp_path / "a.json").write_text(json.dumps({"other": 1, key: [{"id": 1}, {"id": 2}]}))
    assert [r["id"] for r in rows(A.read_json(spark, str(tmp_path / "a.json")))] == [1, 2]


def test_json_forms(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"id": 1}]')
    assert rows(A.read_json(spark, str(path))) == [{"id": 1}]
    path.write_text('{"id": 1}')
    assert rows(A.read_json(spark, str(path))) == [{"id": 1}]
    with pytest.raises(Exception, match="no known list"):
        rows(A.read_json(spark, str(path), strict=True))
    path.write_text("5")
    with pytest.raises(Exception, match="neither"):
        rows(A.read_json(spark, str(path)))
    path.write_text("[1]")
    with pytest.raises(Exception, match="not an object"):
        rows(A.read_json(spark, str(path), strict=True))


def test_csv_with_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,question\n1,\"a, b\"\n2,\n", encoding="utf-8")
    assert rows(A.read_annotations(spark, str(tmp_path / "a.csv"))) == [{"id": "1", "question": "a, b"}, {"id": "2", "question": ""}]
    with pytest.raises(ValueError, match="unsupported"):
        A.read_annotations(spark, "a.txt")


def sample(spark, row):
    frame = spark.createDataFrame([(json.dumps(row),)], "raw string")
    return A.to_samples(frame).first()


def test_sample_mapping(spark):
    s = sample(spark, {"video_id": "", "id": 7, "query": "why?", "options": ["A. cat", " ", "dog"], "answer": "A", "duration": "12.5", "clues": "a; b,", "subtitles": [{"start": 1, "text": "hi"}, "yo"]})
    assert (s["video_id"], s["answer"], s["duration"], s["semantic_points"], s["semantic_point_source_field"]) == ("7", "cat", 12.5, ["a", "b"], "clues")
    assert s["question"] == "why? Options: A. A. cat C. dog"
    assert s["caption"] == "[1] hi yo why?"


ANSWERS = [
    ({"options": ["x", "y"], "answer": "b"}, "y"), ({"options": ["x", "y"], "answer": "1"}, "y"), ({"options": ["x"], "answer": "7"}, "7"),
    ({"options": {"A": "(A) x", "B": "y"}, "answer": "a"}, "x"), ({"option0": "x", "option1": "", "option2": "z", "answer": "B"}, "z"),
    ({"choices": ["x", "y"], "correct_idx": 0}, "x"), ({"answer": "free text"}, "free text"), ({"choices": ["x"], "answer": 0}, "x"),
    ({"options": ["(b) q", "[B]: y"], "answer": "B"}, "y"), ({"options": ["B. ", "b)"], "answer": "A"}, "B."), ({"options": {"first": "First - x"}, "answer": "first"}, "First - x"),
    ({"options": {"ONE": "one) x"}, "answer": "one"}, "x"), ({"options": ["x", "y"], "answer": "-1"}, "-1"), ({"options": ["x"], "answer": "1.0"}, "1.0"), ({"options": ["x"], "answer": "\u00c9"}, "\u00c9"),
    ({"options": {"A": "A.x"}, "answer": "A"}, "A.x"), ({"options": {"\\E.": "\\e.) z"}, "answer": "\\e."}, "z"),
]


def test_answers(spark):
    frame = spark.createDataFrame([(json.dumps(row | {"id": i}),) for i, (row, _) in enumerate(ANSWERS)], "raw string")
    got = {int(s["video_id"]): s["answer"] for s in A.to_samples(frame).collect()}
    assert [got[i] for i in range(len(ANSWERS))] == [answer for _, answer in ANSWERS]


def test_empty_values_in_lookups():
    assert manifests.first_of({"a": "", "b": None, "c": 0}, "abc") == ("c", 0)
    assert manifests.first_of({"a": [], "b": {}, "c": 1}, "abc") == ("c", 1)


def test_blank_ids_are_errors(spark):
    frame = spark.createDataFrame([('{"question": "x"}',)], "raw string")
    with pytest.raises(ValueError, match="without an id"):
        A.checked_samples(A.to_samples(frame))
    with pytest.raises(ValueError, match="no samples"):
        A.checked_samples(A.to_samples(frame.where("false")))


def test_paths(spark, tmp_path):
    for name in ("r1/b.mp4", "r2/a.webm", "r2/c/f.jpg"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    roots = [str(tmp_path / "r1"), str(tmp_path / "r2")]
    have = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("r1/b.mp4", "r2/a.webm", "r2/c/f.jpg")], "path string")
    s = spark.createDataFrame([("a", ""), ("b.x", ""), ("c", ""), ("d", "sub/d.mp4"), ("e", "http://x/y"), ("f", "/abs/f.mp4")], "lookup_id string, explicit_path string")
    got = {r["lookup_id"]: r["video_path"] for r in files.resolve_paths(s, have, roots).collect()}
    assert got == {"a": f"{roots[1]}/a.webm", "b.x": f"{roots[0]}/b.mp4", "c": f"{roots[1]}/c", "d": f"{roots[0]}/sub/d.mp4", "e": "", "f": "/abs/f.mp4"}


def test_checkpoint_manifest(spark, tmp_path):
    (tmp_path / "m/.cache").mkdir(parents=True)
    (tmp_path / "m/w.bin").write_bytes(b"abc")
    (tmp_path / "m/.cache/x").write_bytes(b"no")
    (tmp_path / "m/y.lock").write_bytes(b"no")
    listed = files.checkpoint_files(spark, str(tmp_path / "m"))
    manifest = sinks.checkpoint_manifest(listed, "m", "1", "m")
    sinks.check_manifest(manifest)
    assert [f["path"] for f in manifest["files"]] == ["w.bin"] and manifest["total_bytes"] == 3
    want = spark.createDataFrame([("w.bin", 3, "0"), ("gone", 1, "0")], "path string, size_bytes long, sha256 string")
    assert sorted((r["path"], r["issue"]) for r in files.manifest_audit(want, listed).collect()) == [("gone", "missing"), ("w.bin", "sha256")]
    with pytest.raises(ValueError, match="hash"):
        sinks.check_manifest(manifest | {"model_id": "other"})


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", frames=np.full((2, 3, 4, 5), 0.5))
    np.savez(tmp_path / "b.npz", np.full((1, 4, 5, 3), 300.0))
    got = {(r["path"][-5:], r["frame_pos"]): r for r in files.npz_frames(spark, str(tmp_path)).collect()}
    assert (got["a.npz", 1]["height"], got["a.npz", 1]["width"]) == (4, 5) and set(got["a.npz", 0]["pixels"]) == {127}
    assert set(got["b.npz", 0]["pixels"]) == {255}


def test_config(monkeypatch):
    monkeypatch.setenv("ROOT_X", "/r")
    assert files.expand_env({"a": "$ROOT_X/d", "b": ["$NOT_SET_X", 1]}) == {"a": "/r/d", "b": ["", 1]}


def test_guards(spark, tmp_path):
    path = str(tmp_path / "p.json")
    sinks.guard_protocol(path, {"a": 1}, resume=False)
    sinks.guard_protocol(path, {"a": 1}, resume=True)
    with pytest.raises(ValueError, match="changed"):
        sinks.guard_protocol(path, {"a": 2}, resume=True)
    frame = spark.range(1)
    sinks.write_once(frame, str(tmp_path / "once"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_once(frame, str(tmp_path / "once"))
    with pytest.raises(ValueError):
        sinks.write_once(frame, "x", source="x")
    with pytest.raises(ValueError):
        sinks.portable("../x")


def test_bundle(spark, tmp_path):
    summary = spark.createDataFrame([("direct", 0.5, None)], "method string, cond_reward double, eff_reward double")
    sinks.write_analysis(str(tmp_path), summary, spark.range(2), summary)
    assert "| direct | 0.5000 | n/a |" in (tmp_path / "summary.md").read_text()
    assert json.loads((tmp_path / "summary.json").read_text())[0]["method"] == "direct"


def test_replayed_generation(spark):
    s = spark.createDataFrame([("k", "v")], "sample_key string, video_id string")
    slots = models.requests(s, 42)
    generator = models.replay({("k", 1, 2): "good", ("k", 2, 1): "good"})
    got = models.generate(slots, generator, lambda r: "" if r == "good" else "bad").groupBy("candidate_index").agg(F.count("*").alias("n"), F.max("status").alias("s")).collect()
    assert sorted((r["candidate_index"], r["n"]) for r in got) == [(1, 2), (2, 1), (3, 8), (4, 8)]


def test_transport_waits(monkeypatch):
    waits, calls = [], []

    def fail(request, timeout):
        calls.append(1)
        raise TimeoutError

    with pytest.raises(TimeoutError):
        models.post("http://x", {}, sleep=waits.append, open_url=fail)
    assert waits == [1.5, 3.0] and len(calls) == 3


def test_incremental_ingest(spark, tmp_path):
    """Keys seen are known without the target: it may even be gone, and a batch that runs again adds nothing."""
    import shutil

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("sample_key", StringType()), StructField("v", LongType())])
    source = tmp_path / "in"
    source.mkdir()
    target, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        resume.ingest(spark, str(source), schema, target, mark).awaitTermination()

    def held():
        return sorted((r["sample_key"], r["v"]) for r in spark.read.parquet(target).collect())

    (source / "a.jsonl").write_text('{"sample_key": "a", "v": 1}\n{"sample_key": "a", "v": 1}\n{"sample_key": " ", "v": 1}\n{"v": 4}\n')
    run()
    (source / "b.jsonl").write_text('{"sample_key": "a", "v": 2}\n{"sample_key": "b", "v": 3}\n')
    run()
    assert held() == [("a", 1), ("b", 3)]
    run()
    assert held() == [("a", 1), ("b", 3)]
    last = max(int(p.name) for p in (tmp_path / "mark" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):  # as if the query had died before it committed its last batch
        (tmp_path / "mark" / "commits" / name).unlink()
    run()
    assert held() == [("a", 1), ("b", 3)]
    for p in tmp_path.glob("out/part-*"):  # what was written before is not read again
        p.unlink()
    shutil.rmtree(tmp_path / "out" / "_spark_metadata")
    (source / "c.jsonl").write_text('{"sample_key": "b", "v": 9}\n')
    run()
    assert not list(tmp_path.glob("out/part-*")) or spark.read.schema(schema).parquet(*map(str, tmp_path.glob("out/part-*"))).count() == 0


def test_snapshots(spark, tmp_path):
    target, kind = str(tmp_path / "table"), "dataset string, model string, v int"
    one = spark.createDataFrame([("d1", "m1", 1), ("d1", "m2", 2)], kind)
    two = spark.createDataFrame([("d1", "m2", 9), ("d0", "m1", 5)], kind)
    assert resume.version(spark, target) == 0
    with pytest.raises(ValueError, match="nothing is committed"):
        resume.read_snapshot(spark, target)
    assert resume.upsert_snapshot(one, target, ["dataset", "model"]) == 1
    for n in (2, 3):  # a replayed upsert changes nothing but the version
        assert resume.upsert_snapshot(two, target, ["dataset", "model"]) == n
        assert sorted(map(tuple, resume.read_snapshot(spark, target).collect())) == [("d0", "m1", 5), ("d1", "m1", 1), ("d1", "m2", 9)]
    assert resume.read_snapshot(spark, target, 1).count() == 2
    with pytest.raises(RuntimeError, match="moved on"):
        resume.commit_snapshot(one, target, 1)
    one.write.parquet(f"{target}/snapshot-{'0' * 32}")  # written but never committed
    (tmp_path / "table" / "commit-0000000004").write_text("")  # a writer that died
    assert resume.version(spark, target) == 3 and resume.read_snapshot(spark, target).count() == 3
    with pytest.raises(RuntimeError, match="commit-0000000004"):
        resume.upsert_snapshot(two, target, ["dataset", "model"])


def test_fingerprints(spark, tmp_path):
    kind = "a int, b string, c array<string>"
    rows = [(1, "x", ["p", None]), (2, None, None), (2, None, None), (None, "", []), (3, "1:x", ["-"])]
    frame = spark.createDataFrame(rows, kind)
    own = fingerprint.fingerprint_of(frame)
    assert own["rows"] == 5 and own == fingerprint.fingerprint_of(frame.repartition(3).orderBy("b")) == fingerprint.fingerprint_of(frame.select("c", "a", "b"))
    others = [[*rows[:-1], (3, "1:x", [None])], rows[:-1], [*rows, rows[1]], [*rows[:-1], (3, "1:y", ["-"])], [(1, "x", ["p"]), *rows[1:]], [(None, "x", ["p", None]), *rows[1:]]]
    assert len({fingerprint.fingerprint_of(spark.createDataFrame(r, kind))["fingerprint"] for r in [rows, *others]}) == 7
    assert fingerprint.fingerprint_of(frame.where("false"))["rows"] == 0
    digest = lambda r: hashlib.sha256("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in r).encode()).hexdigest()
    plain = [digest((None if a is None else str(a), b)) for a, b, _ in rows]
    sums = [sum(int(d[8 * k : 8 * k + 8], 16) for d in plain) for k in range(8)]
    assert fingerprint.fingerprint_of(frame, ("a", "b"))["fingerprint"] == hashlib.sha256(",".join(map(str, [5, *sums])).encode()).hexdigest()

    code = tmp_path / "src"
    (code / "__pycache__").mkdir(parents=True)
    for name, text in {"a.py": "x = 1", "b.py": "", "notes.txt": "n", "__pycache__/a.py": "y"}.items():
        (code / name).write_text(text)
    manifest = fingerprint.protocol_manifest({"seed": 42}, frame, [str(code)], ("src/b.py", "src/a.py"))
    assert list(manifest["scientific_payload"]["sources"]["files"]) == ["src/a.py", "src/b.py"]
    assert manifest == fingerprint.protocol_manifest({"seed": 42}, frame.repartition(4), [str(code)])
    (code / "a.py").write_text("x = 2")
    now = fingerprint.protocol_manifest({"seed": 43}, frame.where("a = 1"), [str(code)])
    assert now["protocol_fingerprint"] != manifest["protocol_fingerprint"] and fingerprint.changed(manifest, now) == ["settings.seed", "annotations", "sources.src/a.py"]
    path = str(tmp_path / "protocol.json")
    sinks.guard_protocol(path, manifest, resume=False)
    with pytest.raises(ValueError, match="protocol has changed"):
        sinks.guard_protocol(path, now, resume=True)
    with pytest.raises(ValueError, match="src/c.py"):
        fingerprint.protocol_manifest({}, frame, [str(code)], ("src/a.py", "src/c.py"))
    with pytest.raises(ValueError, match="no source files"):
        fingerprint.source_fingerprint(spark, [str(code)], (".rs",))
