"""Nested retry logs, frame sources, blocked similarity and n-gram overlap against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorepool.functions import text, vectors
from scorepool.operators import retries
from scorepool.sources import frames

TRY = "struct<transport_attempt:int,status:string,request_seconds:double,backoff_seconds_after:double,retryable:boolean>"
SLOT = f"k int, attempts array<struct<attempt:int,status:string,request_seconds:double,input_tokens:bigint,output_tokens:bigint,transport_request_count:int,transports:array<{TRY}>>>"


def sent(*tries):
    return [(i, status, seconds, wait, again) for i, (status, seconds, wait, again) in enumerate(tries, 1)]


OK, LATE = ("success", 2.0, 0.0, None), ("error", 1.0, 1.5, True)
GOOD = [(1, "parse_rejected", 3.0, 10, 5, 2, sent(LATE, OK)), (2, "endpoint_error", 1.0, 0, 0, 1, sent(("error", 1.0, 0.0, False))), (3, "accepted", 2.5, 7, None, None, None)]


def attempt(n=1, status="accepted", seconds=2.0, count=1, tries=sent(OK)):
    return (n, status, seconds, 1, 1, count, tries)


CASES = [
    (GOOD, None), ([attempt()], None), ([], "no attempts"), (None, "no attempts"), ([attempt(2)], "attempts are not numbered 1, 2, 3 ..."), ([attempt(), attempt()], "attempts are not numbered 1, 2, 3 ..."),
    ([attempt(n, "parse_rejected") for n in range(1, 10)], "too many attempts"), ([attempt(), attempt(2)], "an attempt follows the accepted one"),
    ([attempt(tries=[(2, *OK)])], "attempt 1: tries are not numbered 1, 2, 3 ..."), ([attempt(tries=[(None, *OK)])], "attempt 1: tries are not numbered 1, 2, 3 ..."),
    ([GOOD[0], attempt(2, seconds=5.0, count=4, tries=sent(LATE, LATE, LATE, OK))], "attempt 2: too many tries"), ([attempt(seconds=-1.0, tries=sent(("success", -1.0, 0.0, None)))], "attempt 1: a time is negative"),
    ([attempt(seconds=4.0, count=2, tries=sent(OK, OK))], "attempt 1: a try follows a successful one"), ([attempt(seconds=3.0, count=2, tries=sent(("error", 1.0, 0.0, False), OK))], "attempt 1: a try follows an error that is not retryable"),
    ([attempt(tries=sent(("success", 2.0, 1.5, None)))], "attempt 1: the last try is followed by a wait"), ([attempt(status="endpoint_error")], "attempt 1: the last try and the attempt disagree"),
    ([attempt(seconds=1.0, tries=sent(("error", 1.0, 0.0, True)))], "attempt 1: the last try and the attempt disagree"), ([attempt(count=2)], "attempt 1: the stated number of requests differs"),
    ([GOOD[0], attempt(2, seconds=2.1)], "attempt 2: the stated seconds differ"), ([attempt(seconds=2.000004)], None),
]


def test_nested_rules(spark):
    frame = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], SLOT)
    got = {r["k"]: r["issue"] for r in frame.select("k", retries.nested_issue(F.col("attempts")).alias("issue")).collect()}
    assert got == {i: issue for i, (_, issue) in enumerate(CASES)}


def test_nested_sums(spark):
    row = spark.createDataFrame([(1, GOOD), (2, [])], SLOT).select("k", retries.nested_rollup(F.col("attempts")).alias("r")).select("k", "r.*").orderBy("k").collect()
    assert tuple(row[0]) == (1, 3, 4, 2, 1, 6.5, 1.5, 17, 5, 3) and tuple(row[1]) == (2, 0, 0, 0, 0, 0.0, 0.0, 0, 0, None)
    plan = spark.createDataFrame([(1, GOOD)], SLOT).select(retries.nested_rollup(F.col("attempts")))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def plain_cider(p, r):
    out = 0.0
    for n in (1, 2, 3, 4):
        a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (p, r))
        if a and b:
            out += 2 * (a & b).total() / (a.total() + b.total())
    return out / 4


def test_overlap_equals_counters(spark):
    rng = random.Random(3)
    texts = [(i, *(" ".join(rng.choice(["a", "b", "c", "日", "x1"]) for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 200]))) for _ in range(2))) for i in range(120)] + [(120, None, "a"), (121, "a a a", "a")]
    frame = spark.createDataFrame(texts, "k int, p string, r string")
    found = frame.select("k", text.tokens(F.col("p")).alias("p"), text.tokens(F.col("r")).alias("r"), text.cider_lite("p", "r").alias("x"))
    for row in found.collect():
        assert row["x"] == pytest.approx(plain_cider(row["p"], row["r"]), abs=1e-15)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_shared_count(spark):
    rng = random.Random(1)
    pairs = [(i, rng.choices(range(6), k=rng.randrange(9)), rng.choices(range(6), k=rng.randrange(9))) for i in range(80)]
    frame = spark.createDataFrame(pairs, "k int, a array<bigint>, b array<bigint>").select("a", "b", text.shared_count(F.col("a"), F.col("b")).alias("n"))
    assert all(r["n"] == (Counter(r["a"]) & Counter(r["b"])).total() for r in frame.collect())


@pytest.mark.parametrize("block", [2, 64])
def test_blocked_similarity(spark, block, monkeypatch):
    """Several blocks on both sides, ties, zero and absent vectors, samples of one side only, a text key."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(2)
    points = [(f"s{s}", p, [float(x) for x in rng.integers(-2, 3, 3)]) for s in range(4) for p in range(1, 6)] + [("s0", 6, None), ("only", 1, [1.0, 0.0, 0.0])]
    segments = [(f"s{s}", g, [float(x) for x in rng.integers(-2, 3, 3)]) for s in range(3) for g in range(1, 8)] + [("s0", 8, None), ("other", 1, [1.0, 0.0, 0.0])]
    whole = [("s3", [1.0, 2.0, 0.0]), ("s0", [9.0, 9.0, 9.0])]

    def cosine(a, b):
        if a is None or b is None:
            return 0.0
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        return 0.0 if norm <= 1e-8 else float(np.dot(a, b) / norm)

    want = {}
    for key, p, v in points:
        others = [(g, w) for k, g, w in segments if k == key] or [(0, w) for k, w in whole if k == key]
        if others:
            best = max(round(cosine(v, w), 9) for _, w in others)
            want[key, p] = (best, min(g for g, w in others if round(cosine(v, w), 9) == best))
    frame = vectors.point_coverage(
        spark.createDataFrame(points, "sample_key string, point_index int, embedding array<double>"), spark.createDataFrame(segments, "sample_key string, segment_index int, embedding array<double>"), 0.5,
        whole=spark.createDataFrame(whole, "sample_key string, embedding array<double>"),
    )
    got = {(r["sample_key"], r["point_index"]): r for r in frame.collect()}
    assert set(got) == set(want)
    for k, (best, segment) in want.items():
        assert got[k]["similarity"] == pytest.approx(best, abs=1e-8) and (got[k]["segment_index"] == segment or abs(best - got[k]["similarity"]) < 1e-8)
        assert got[k]["covered"] == (got[k]["similarity"] >= 0.5)


def test_frames_of_every_kind(spark, tmp_path):
    def at(name):
        return str(tmp_path / name)

    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "b.PNG").write_bytes(b"\x89PNG\r\n\x1a\nrest")
    (tmp_path / "images" / "a.jpg").write_bytes(b"\xff\xd8rest")
    (tmp_path / "images" / "notes.txt").write_text("x")
    (tmp_path / "empty").mkdir()
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "a.png").write_bytes(b"GIF89a")
    np.savez(at("ok.npz"), other=np.zeros(3), frames=np.full((2, 3, 4, 5), 0.5))
    np.savez(at("none.npz"), frames=np.zeros((0, 4, 5, 3), np.uint8))
    np.savez(at("flat.npz"), frames=np.zeros((4, 5)))
    np.savez(at("objects.npz"), frames=np.array([{}], dtype=object))
    (tmp_path / "cut.NPZ").write_bytes((tmp_path / "ok.npz").read_bytes()[:60])
    (tmp_path / "clip.raw").write_bytes(b"abcdef")
    (tmp_path / "still.raw").write_bytes(b"")
    (tmp_path / "clip.mp4").write_bytes(b"x")
    names = ["images", "empty", "broken", "ok.npz", "none.npz", "flat.npz", "objects.npz", "cut.NPZ", "clip.raw", "still.raw", "clip.mp4", "absent.npz"]
    samples = spark.createDataFrame([(at(n),) for n in names] + [("",), (None,), (at("images"),), ("nowhere://x/y",)], "video_path string")

    def halves(f):
        held = f.read()
        for k in range(0, len(held), 3):
            yield 1, 1, held[k : k + 3]

    got = frames.load_frames(samples, {".raw": halves})
    rows = {(r["video_path"].rsplit("/", 1)[-1], r["frame_pos"]): r for r in got.frames.collect()}
    assert set(rows) == {("images", 0), ("images", 1), ("ok.npz", 0), ("ok.npz", 1), ("clip.raw", 0), ("clip.raw", 1)}
    assert bytes(rows["images", 0]["content"]) == b"\xff\xd8rest" and rows["images", 0]["height"] is None
    assert (rows["ok.npz", 1]["height"], rows["ok.npz", 1]["width"], bytes(rows["ok.npz", 1]["content"])) == (4, 5, bytes([127]) * 60)
    assert bytes(rows["clip.raw", 1]["content"]) == b"def"
    errors = {(r["video_path"] or "").rsplit("/", 1)[-1]: (r["kind"], r["error"]) for r in got.errors.collect()}
    assert set(errors) == {"empty", "broken", "none.npz", "flat.npz", "objects.npz", "cut.NPZ", "still.raw", "clip.mp4", "absent.npz", "", "y"} and got.errors.count() == 12
    for name, kind, text_ in (("empty", "image_dir", "no images"), ("broken", "image_dir", "a.png is not an image"), ("none.npz", "npz", "no frames"), ("flat.npz", "npz", "four axes"), ("clip.mp4", "video", "no decoder for .mp4"), ("still.raw", "video", "no frames"), ("absent.npz", "none", "nothing is there"), ("", "none", "path is empty")):
        assert errors[name][0] == kind and text_ in errors[name][1]
    sources = {r["video_path"].rsplit("/", 1)[-1]: r for r in got.sources.collect()}
    assert {k: (r["decode_backend"], r["formal_sampling_eligible"], r["frames"]) for k, r in sources.items()} == {"images": ("image_directory", True, 2), "ok.npz": ("numpy", True, 2), "clip.raw": ("decoder", False, 2)}
