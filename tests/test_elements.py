"""Files read in parts and chunks, against whole-file results."""

import hashlib
import json
import os
import random

import pytest

from scorepool.constants import WRAPPER_KEYS
from scorepool.sources import annotations, elements, files, streams

ITEMS = [
    {"id": "a", "text": 'quote " and \\ back', "list": [1, [2, "]}"], {"k": "[,"}]}, {"id": "b\\\\\\", "x": "\\\""}, 5, None, True, "text, with [brackets] {and} \"quotes\"", [], {}, [[], [[]]], -1.5e3,
    {"id": "é日本", "y": "\\" * 9}, "", {"long": "x" * 500, "more": ["\\\"" * 40]},
]


def read(spark, path, part, **more):
    rows = elements.elements(spark, str(path), WRAPPER_KEYS, part_bytes=part, **more).collect()
    return [json.loads(r["value"]) for r in sorted(rows, key=lambda r: (r["path"], r["at"]))]


@pytest.mark.parametrize("part", [1 << 20, 97, 7])
def test_parts_equal_the_whole_file(spark, tmp_path, part, monkeypatch):
    monkeypatch.setattr(elements, "READ_BYTES", 64)
    wrapped = {"info": {"data": [1, 2], "note": '"data": ['}, "data_": [9], "questions": [0], "x\"data": [8], "items": [], "samples": ITEMS, "tail": [[3]], "end": {}}
    texts = {
        "a.json": json.dumps(ITEMS), "b.json": "\ufeff \n" + json.dumps(ITEMS, indent=3, ensure_ascii=False), "c.json": json.dumps(wrapped), "d.json": json.dumps(wrapped, indent=1),
        "e.json": "[]", "f.json": " [ \n] ", "g.json": '{"data": [1,2], "data" :\n[3]}', "h.json": '{"data": {"samples": [1]}, "z": 2}',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    want = ITEMS + ITEMS + ITEMS + ITEMS + [3] + [{"data": {"samples": [1]}, "z": 2}]
    wrapped.pop("items")
    want_wrapped = [json.loads(json.dumps(x)) for x in want]
    (tmp_path / "c.json").write_text(json.dumps(wrapped))
    (tmp_path / "d.json").write_text(json.dumps(wrapped, indent=1))
    assert read(spark, tmp_path, part) == want_wrapped


def test_several_tasks_read_one_file(spark, tmp_path):
    random.seed(4)
    items = [{"id": i, "t": "".join(random.choice('ab"\\[]{},: ') for _ in range(random.randrange(60)))} for i in range(3000)]
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"annotations": items}))
    found = elements.elements(spark, str(path), WRAPPER_KEYS, part_bytes=10_000)
    assert elements.parts(spark, str(path), 10_000).rdd.getNumPartitions() > 10
    assert [json.loads(r["value"]) for r in found.orderBy("at").collect()] == items
    assert sorted(r["raw"] for r in annotations.read_json(spark, str(path)).collect()) == sorted(json.dumps(i, separators=(",", ":")) for i in items)


@pytest.mark.parametrize("text", ["5", '"x"', "null", " ", "[1, 2", '{"data": [1}', '["a]', "[1,,2]", "[1,]"])
def test_what_is_no_list_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):
        read(spark, tmp_path, 3)


def test_strict_reading(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"other": [1]}')
    assert annotations.read_json(spark, str(tmp_path)).first()["raw"] == '{"other":[1]}'
    with pytest.raises(Exception, match="no known list"):
        annotations.read_json(spark, str(tmp_path), strict=True).collect()
    (tmp_path / "x.json").write_text('{"qas": [{"a": 1}, 2]}')
    with pytest.raises(Exception, match="not an object"):
        annotations.read_json(spark, str(tmp_path), strict=True).collect()


@pytest.mark.parametrize("chunk", [1, 7, 8 << 20])
def test_hashes_by_chunks(spark, tmp_path, chunk, monkeypatch):
    monkeypatch.setattr(streams, "CHUNK_BYTES", chunk)
    held = {"a.bin": b"", "sub dir/b.bin": b"x" * 20, "c%20d.bin": bytes(range(256))}
    for name, data in held.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: (r["size_bytes"], r["sha256"]) for r in files.checkpoint_files(spark, str(tmp_path)).collect()}
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in held.items()}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """Larger than any value of a row can be."""
    n = (1 << 31) + 5
    with open(tmp_path / "model.safetensors", "wb") as f:
        f.truncate(n)
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    for at in range(0, n, len(zeros)):
        digest.update(zeros[: min(len(zeros), n - at)])
    row = files.checkpoint_files(spark, str(tmp_path)).first()
    assert (row["size_bytes"], row["sha256"]) == (n, digest.hexdigest())
    assert files.manifest_audit(files.checkpoint_files(spark, str(tmp_path)), files.checkpoint_files(spark, str(tmp_path))).count() == 0
    os.truncate(tmp_path / "model.safetensors", 10)


def test_a_file_that_changes_is_an_error(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    listed = spark.createDataFrame([(str(tmp_path / "x"), 4)], "path string, length long")
    with pytest.raises(Exception, match="has 3 bytes, not 4"):
        streams.hashed(listed).collect()


def test_stores_that_only_spark_opens():
    assert streams.opens("/a/b") and streams.opens("file:/a") and streams.opens("hdfs://n/a") and streams.opens("s3a://b/c") and not streams.opens("wasbs://c@a/x") and not streams.opens("dbfs:/x")
