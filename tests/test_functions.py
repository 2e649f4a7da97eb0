import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from scorepool.functions import letters, sampling, text, timeline, vectors
from scorepool.plans import catalog


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, want",
    [("A b_1, c!", ["a", "b_1", "c"]), ("日本x", ["日", "本", "x"]), ("?!", ["?", "!"]), ("", []), (None, [])],
)
def test_tokens(spark, value, want):
    assert one(spark, text.tokens(F.lit(value).cast("string"))) == want


def test_repetition(spark):
    assert one(spark, text.repetition_rate(text.tokens(F.lit("a a b a")))) == 0.5
    assert one(spark, text.repetition_rate(text.tokens(F.lit("")))) == 0.0


def test_cider_lite(spark):
    rows = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "a b", "a b"), (3, "a", "b"), (4, "", "x"), (5, None, None)], "k int, p string, r string")
    got = {r["k"]: r["x"] for r in rows.select("k", text.cider_lite("p", "r").alias("x")).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0, 5: 0.0}


def test_english_words(spark):
    rows = spark.createDataFrame([("Don't stop naïve café-bar 12",), ("日本 a",), ("",), (None,)], "t string")
    assert [r["n"] for r in rows.select(text.english_word_count("t").alias("n")).collect()] == [4, 1, 0, 0]


def test_every_letter_by_interval(spark):
    """All code points, a row each, against the Unicode names."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(i, "".join(map(chr, codes[i : i + 4000]))) for i in range(0, len(codes), 4000)], "i int, t string")
    got = {r["i"]: (r["o"], tuple(r["n"])) for r in rows.select("i", letters.other_letters(F.col("t")).alias("o"), letters.letter_counts(F.col("t")).alias("n")).collect()}
    for i in range(0, len(codes), 4000):
        own = [c for c in codes[i : i + 4000] if chr(c).isalpha()]
        other = [c for c in own if "LATIN" not in unicodedata.name(chr(c), "")]
        assert got[i] == (other, (len(own), len(other)))


def test_latin_contract_of_candidates(spark):
    kind = "k int, segments array<struct<narration:string,salient_point:string,on_screen_text:string>>, controls struct<tone:string,_hidden:string,points:array<string>,deep:struct<m:map<string,string>,n:int>>"
    ok = [("plain é ñ", "x", "日本 a"), ("two", None, None), ("three", "", "é Ж")]
    rows = [
        (1, ok, ("tone", "日", ["a", "b"], ({"k": "v", "_h": "Ж"}, 1))), (2, [*ok, ("bad ω Ж", "日", "")], None), (3, ok, ("fine", None, ["a", "ב"], None)), (4, [("a", "пункт", "z")], ("Ж", None, None, None)),
        (5, [], (None, None, None, ({"q": "한"}, 2))), (6, None, None), (7, [("𝒳 math", "\U00010400", None)], None),
    ]
    frame = spark.createDataFrame(rows, kind)
    fields = letters.contract_fields(F.col("segments"), frame.schema["controls"].dataType, F.col("controls"))
    got = {r["k"]: (r["issue"], tuple(r["a"])) for r in letters.contract_issues(frame, fields).select("k", "issue", letters.on_screen_audit(F.col("segments")).alias("a")).collect()}

    def named(path, c):
        return f"{path} contains non-Latin letter U+{ord(c):04X} ({unicodedata.name(c)})"

    shown = (True, [1, 3], 3, 5)
    assert got[1] == (None, shown) and got[2] == (named("timeline[4].narration", "ω"), shown) and got[3] == (named("controls.points[1]", "ב"), shown)
    assert got[4] == (named("timeline[1].salient_point", "п"), (False, [], 0, 1)) and got[5] == (named("controls.deep.m.q", "한"), (False, [], 0, 0))
    assert got[6][0] is None and got[7] == (named("timeline[1].narration", "𝒳"), (False, [], 0, 0))


def test_risk(spark):
    found = text.risk_terms(F.lit("The BEST cure; bestow"))
    assert one(spark, found) == ["cure", "best"]
    assert one(spark, text.risk_score(found)) == pytest.approx(5 / 7)


def test_sample_key_escapes(spark):
    import hashlib
    import json

    fields = {"video_id": 'v"1', "question": "a\nb\\", "answer": "é/", "caption": ""}
    want = int(hashlib.sha256(json.dumps(fields, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16], 16) % 10**12
    got = one(spark, text.sample_key(*[F.lit(fields[k]) for k in ("video_id", "question", "answer", "caption")]))
    assert got == f'v"1::{want:012d}'


@pytest.mark.parametrize("value, want", [("x" * 300, 1), ("ab" * 150 + "  ", 2), ("1" * 300, None), ("x" * 255, None), ("pre " * 80 + "tail word", None)])
def test_degenerate(spark, value, want):
    assert one(spark, text.degenerate_period(F.lit(value))) == want


def test_hashed_vector(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "")], "k int, t string")
    got = {r["k"]: r["vector"] for r in text.hashed_vector(rows, "k", "t", 16).collect()}
    assert math.isclose(sum(x * x for x in got[1]), 1.0) and got[2] == [0.0] * 16


@pytest.mark.parametrize("value, want", [(float("nan"), 0.0), (float("inf"), 0.0), (-float("inf"), 0.0), (2.0, 1.0), (-1.0, 0.0), (0.25, 0.25)])
def test_clip(spark, value, want):
    assert one(spark, vectors.clip01(F.lit(value))) == want


def test_half_even(spark):
    assert one(spark, vectors.half_even(F.lit(2.5), 0)) == 2.0


def test_cosine_of_zero(spark):
    zero, unit = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, vectors.cosine(zero, unit)) == 0.0
    assert one(spark, vectors.cosine(unit, unit)) == 1.0


def test_lone_frame_weight(spark):
    frames = spark.createDataFrame([(1, 0, [1.0, 0.0])], "sample_key int, frame_pos int, embedding array<double>")
    assert vectors.with_weights(frames).first()["weight"] == 1.0


def test_coverage_first_wins(spark):
    points = spark.createDataFrame([(1, 0, [1.0, 0.0])], "sample_key int, point_index int, embedding array<double>")
    segments = spark.createDataFrame([(1, 1, [0.0, 1.0]), (1, 2, [1.0, 0.0]), (1, 3, [2.0, 0.0])], "sample_key int, segment_index int, embedding array<double>")
    r = vectors.point_coverage(points, segments, 0.5).first()
    assert (r["similarity"], r["segment_index"], r["covered"]) == (1.0, 2, True)


@pytest.mark.parametrize("total, want", [(32, [0, 3, 4, 7, 8, 11, 12, 15, 16, 19, 20, 23, 24, 27, 28, 31]), (5, [0, 1, 2, 3, 4]), (1, [0]), (0, [])])
def test_binwise(spark, total, want):
    got = one(spark, sampling.binwise(F.lit(total)))
    assert [x["frame"] for x in got] == want
    if total == 5:
        assert [x["bin"] for x in got] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("bins, per_bin, most", [(8, 2, 16), (8, 2, 9), (3, 5, 16), (4, 1, 16)])
def test_binwise_equals_plain(spark, bins, per_bin, most):
    def plain(total):
        out, n = [], min(bins, total or 0)
        for b in range(n):
            start, end = b * total // n, (b + 1) * total // n
            count = min(per_bin, end - start)
            spots = [start + (end - start) // 2] if count == 1 else [start + round((end - start - 1) * k / (count - 1)) for k in range(count)]
            out += [(x, b) for x in spots]
        assert len({x for x, _ in out}) == len(out)
        return out[:most]

    totals = [None, -3, *range(150), 999, 10_000_019]
    rows = spark.createDataFrame([(t,) for t in totals], "t long").select("t", sampling.binwise(F.col("t"), bins, per_bin, most).alias("p")).collect()
    assert {r["t"]: [tuple(x) for x in r["p"]] for r in rows} == {t: plain(t) if t and t > 0 else [] for t in totals}


def test_sampling_computes_a_bin_once(spark):
    """Neither picks nor their check repeat the bins' bounds for each frame that they look at."""
    picks = sampling.binwise(F.col("id") + 2)
    issue = sampling.accounting_issue(F.transform(picks, lambda x: x["frame"]), F.transform(picks, lambda x: x["bin"]))
    for column, most in ((picks, 3), (issue, 6)):
        plan = spark.range(3).select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("FLOOR(") <= most


def test_picks_are_made_once_a_total(spark):
    """Rows keep their number and order of columns, null totals too; what is made of a total is made once for all its rows."""
    rows = spark.range(500).select("id", F.when(F.col("id") % 8 > 0, F.col("id") % 8 - 1).alias("t"))
    got = sampling.per_total(rows, "t", "p").collect()
    assert sorted(r["id"] for r in got) == list(range(500)) and list(got[0].asDict()) == ["id", "t", "p"]
    assert all([x["frame"] for x in r["p"]] == list(range(r["t"] or 0)) for r in got)
    once = sampling.per_total(rows, "t", "p", lambda t: F.concat(F.uuid(), t.cast("string"))).where("t IS NOT NULL")
    assert once.select("p").distinct().count() == 7


@pytest.mark.parametrize("name", ["binwise_indices", "sampling_accounting"])
def test_queries_make_picks_of_distinct_totals(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [k for k, line in enumerate(plan) if "flatten(" in line]
    assert len(made) == 1 and "Aggregate [" in plan[made[0]] + plan[made[0] + 1]


SEGMENT = "array<struct<start: double, end: double, words: int, complete: boolean, narration: string, is_summary: boolean>>"


def segments(spark, rows):
    return spark.createDataFrame([(rows,)], f"segments {SEGMENT}")


def even(n=5):
    return [(6.0 * i, 6.0 * i + 6, 12, True, "words.", i == n - 1) for i in range(n)]


def value(spark, rows, f):
    return segments(spark, rows).select(f(F.col("segments")).alias("x")).first()["x"]


def test_even_timeline(spark):
    assert value(spark, even(), timeline.rhythm) == pytest.approx(1.0)
    assert value(spark, even(), timeline.readability) == pytest.approx(1.0)
    assert value(spark, even(), timeline.violations) == []
    assert value(spark, even(), lambda s: timeline.control_score(timeline.violations(s))) == 1.0


def test_empty_timeline(spark):
    assert value(spark, [], timeline.rhythm) == 0.0
    assert value(spark, [], timeline.readability) == 0.0
    assert value(spark, [], timeline.timestamps_valid) is False
    assert value(spark, [], timeline.violations) == ["segment_count", "timestamp_validity", "duration_coverage", "required_fields", "summary_position", "information_density"]


@pytest.mark.parametrize("gap, ok", [(-1e-7, True), (-1e-3, False), (0.5, True)])
def test_overlaps(spark, gap, ok):
    rows = [(0.0, 6.0, 12, True, "a", False), (6.0 + gap, 12.0, 12, True, "b", True)]
    assert value(spark, rows, timeline.timestamps_valid) is ok


def test_missing_and_infinite_times(spark):
    rows = even()
    rows[1] = (None, 12.0, 12, True, "x", False)
    assert value(spark, rows, timeline.timestamps_valid) is False
    rows[1] = (6.0, float("inf"), 12, True, "x", False)
    assert value(spark, rows, timeline.duration_coverage) is False


def test_surplus_segments_cost(spark):
    assert value(spark, even(6), timeline.rhythm) == pytest.approx(1 - 1 / 5)


def test_two_violations(spark):
    assert one(spark, timeline.control_score(F.array(F.lit("a"), F.lit("b")))) == pytest.approx(1 - 2 / 6)
