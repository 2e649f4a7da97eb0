import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorepool.operators import bootstrap, parsing, quality, quantiles, selection, stats

SLOT = "sample_key int, candidate_index int, candidate_id int, valid boolean, reward double, rep double"
ROWS = [
    (1, 1, 11, True, 0.5, 0.2), (1, 2, 12, True, 0.5, 0.1), (1, 3, 13, True, 0.1, 0.1), (1, 4, 14, False, None, None),
    (2, 1, 21, False, None, None), (2, 2, 22, True, 0.3, 0.4), (2, 3, 23, False, None, None), (2, 4, 24, False, None, None),
    (3, 1, 31, False, None, None), (3, 2, 32, False, None, None), (3, 3, 33, False, None, None), (3, 4, 34, False, None, None),
]


@pytest.fixture
def slots(spark):
    return spark.createDataFrame(ROWS, SLOT)


def test_best_takes_first_of_ties(slots):
    assert {r["sample_key"]: r["candidate_id"] for r in selection.best_of(slots).collect()} == {1: 11, 2: 22}


def test_direct_is_never_promoted(slots):
    assert [r["candidate_id"] for r in selection.direct(slots).collect()] == [11]


def test_upper_bound_takes_least_repetition(slots):
    got = {(r["sample_key"], r["metric"]): r["candidate_id"] for r in selection.upper_bound(slots, ("reward", "rep")).collect()}
    assert got == {(1, "reward"): 11, (1, "rep"): 12, (2, "reward"): 22, (2, "rep"): 22}


def test_summary_and_identity(slots):
    picked = selection.selections(slots, ("reward", "rep"))
    summary = stats.summarize_methods(picked, ("reward", "rep"))
    row = {r["method"]: r for r in summary.collect()}
    assert row["best_of_4"]["ok"] == 2 and row["direct"]["ok"] == 1 and row["direct"]["requested"] == 3
    assert row["best_of_4"]["eff_rep"] == pytest.approx((0.2 + 0.4 + 1) / 3)
    assert quality.identity_issues(summary, ("reward", "rep")).count() == 0
    broken = summary.withColumn("eff_reward", F.col("eff_reward") + 0.1)
    assert quality.identity_issues(broken, ("reward", "rep")).count() == 2


def test_selection_does_not_depend_on_partitions(spark, slots):
    once = sorted(map(tuple, selection.selections(slots, ("reward",)).collect()), key=str)
    again = sorted(map(tuple, selection.selections(slots.orderBy(F.desc("candidate_id")).repartition(7), ("reward",)).collect()), key=str)
    assert once == again


def test_percentile_is_linear(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = stats.efficiency(rows, ("x",)).first()
    assert (r["mean"], r["median"], r["total"]) == (4.0, 2.5, 16.0) and r["p95"] == pytest.approx(8.95)
    with pytest.raises(Exception, match="negative"):
        stats.efficiency(spark.createDataFrame([(-1.0,)], "x double"), ("x",)).collect()


def test_interval_degenerate_cases():
    rng = np.random.default_rng(1)
    assert bootstrap.interval(np.array([]), np.array([]), 10, rng) == [0.0, 0.0]
    assert bootstrap.interval(np.array([4]), np.array([1.0]), 10, rng) == [0.25, 0.25]
    assert bootstrap.interval(np.array([1, 1]), np.array([1.0, 0.0]), 0, rng) == [0.5, 0.5]


def test_interval_equals_row_level_draws():
    rng, values, clusters = np.random.default_rng(42), np.arange(12.0), np.repeat(list("abcd"), 3)
    draws = []
    for _ in range(50):
        own = rng.choice(list("abcd"), size=4, replace=True)
        draws.append(np.concatenate([values[clusters == c] for c in own]).mean())
    want = [round(float(x), 6) for x in np.percentile(draws, [2.5, 97.5])]
    sums = np.array([values[clusters == c].sum() for c in "abcd"])
    assert bootstrap.interval(np.full(4, 3), sums, 50, np.random.default_rng(42)) == want


def test_bootstrap_skips_methods_without_success(spark, slots):
    picked = selection.selections(slots.where("sample_key = 3"), ("reward",)).withColumn("video", F.lit("v"))
    got = bootstrap.cluster_intervals(picked, ("reward",), "video", ("direct",), 10).collect()
    assert [(r["estimand"], r["low"]) for r in got] == [("conditional", None), ("effective", 0.0)]


def test_audits(spark, slots):
    assert quality.slot_order_issues(slots.where("candidate_id <> 23")).collect()[0]["sample_key"] == 2
    issues = quality.slot_mismatches(slots, slots.where("candidate_id in (11, 12, 13, 14)")).collect()
    assert sorted((r["sample_key"], r["candidate_index"], r["issue"]) for r in issues) == [(1, 4, "candidate_without_slot"), (2, 2, "slot_without_candidate")]
    keys = spark.createDataFrame([("a",), ("a",), (" ",), (None,), ("b",)], "k string")
    assert {r["k"]: r["n"] for r in quality.blank_or_repeated(keys, "k").collect()} == {"a": 2, "": 2}


def test_first_issue_keeps_order(spark):
    rows = spark.createDataFrame([(1, None), (-1, 2), (0, 0)], "a int, b int")
    issue = quality.first_issue((F.col("a") < 0, "a"), (F.col("b").isNull(), "b null"), (F.col("b") > 1, "b"))
    assert [r[0] for r in rows.select(issue).collect()] == ["b null", "a", None]


def test_upsert_and_order(spark):
    old = spark.createDataFrame([("d1", "m1", 1), ("d1", "m2", 2)], "dataset string, model string, v int")
    new = spark.createDataFrame([("d1", "m2", 9), ("d0", "m1", 5)], "dataset string, model string, v int")
    rows = quality.in_enumeration_order(quality.upsert(old, new, ["dataset", "model"]), dataset=["d1", "d0"], model=["m2", "m1"]).collect()
    assert [tuple(r) for r in rows] == [("d1", "m2", 9), ("d1", "m1", 1), ("d0", "m1", 5)]


def test_resume_twice_is_once(spark):
    samples = spark.createDataFrame([(1,), (2,)], "sample_key int")
    done = samples.where("sample_key = 1")
    left = quality.pending(samples, done)
    assert quality.pending(samples, done.unionByName(left)).count() == 0


SEGMENT = '{"start": 0, "end": 6, "narration": "a", "on_screen_text": "", "salient_point": "", "control_tags": ["summary"]}'


@pytest.mark.parametrize(
    "reply, reason",
    [
        (f'{{"timeline": [{SEGMENT}]}}', ""),
        (f'```json\n{{"timeline": [{SEGMENT}]}}\n```', ""),
        ('{"controls": {"timeline": []}}', ""),
        ('{"timeline": [], "timeline": []}', "duplicate key"),
        ('{"a": {"b": 1, "b": 2}}', "duplicate key"),
        ('{"timeline": []} x', "invalid JSON"),
        ("[1, 2]", "an array of 2"),
        ("5", "not an object"),
        ("{}", "not a JSON array"),
        ('{"timeline": [1]}', "not a JSON object"),
        (f'{{"timeline": [{SEGMENT.replace("0,", "true,")}]}}', "finite JSON number; received bool"),
        (f'{{"timeline": [{SEGMENT.replace("0,", chr(34) + "5" + chr(34) + ",")}]}}', "received str"),
        (f'{{"timeline": [{SEGMENT.replace("0,", "NaN,")}]}}', "finite JSON number"),
        (f'{{"timeline": [{SEGMENT.replace("summary", "other")}]}}', "noncanonical"),
        (f'{{"timeline": [{SEGMENT.replace("[" + chr(34) + "summary", "[" + chr(34) + "summary" + chr(34) + ", " + chr(34) + "summary")}]}}', "duplicate tags"),
        (f'{{"timeline": [{SEGMENT.replace(":" + " " + chr(34) + "a", ": " + chr(34) + "Я")}]}}', "non-Latin"),
        ("ab" * 200, "period=2"),
    ],
)
def test_strict_parsing(spark, reply, reason):
    got = spark.createDataFrame([(reply,)], "reply string").select(parsing.parsed_candidate("reply")["reason"]).first()[0]
    assert (got == "") if reason == "" else reason in got


def test_parsed_column(spark):
    rows = spark.createDataFrame([('{"timeline": [{"narration": "x"}]}',), (None,)], "reply string").select(parsing.parsed_candidate("reply").alias("c"))
    a, b = rows.select("c.*", parsing.timeline(F.col("c")).alias("t")).collect()
    assert a["reason"] == "" and len(a["missing_required_fields"]) == 5 and a["t"][0]["narration"] == "x"
    assert b["reason"].startswith("invalid JSON")


def test_many_candidates():
    assert len(parsing.many_candidates(f'[{{"timeline": [{SEGMENT}]}}, {{"x": 1}}]')) == 1


def test_usage_and_message(spark):
    rows = spark.createDataFrame([('{"prompt_tokens": 2, "completion_tokens": 3, "total_tokens": 5}',), ('{"input_tokens": 2, "output_tokens": 3, "total_tokens": 6}',), ("{}",)], "u string")
    got = [r["x"] for r in rows.select(parsing.usage_counts(F.parse_json("u")).alias("x")).collect()]
    assert got[0]["total_tokens"] == 5 and got[1] is None and got[2] is None
    reply = spark.createDataFrame([('{"choices": [{"message": {"content": "hi"}}]}',), ('{"choices": [{"message": {"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}}]}',)], "r string")
    assert [r[0] for r in reply.select(parsing.message_text(F.parse_json("r"))).collect()] == ["hi", "ab"]


def test_counter_draws_agree_with_a_generator(spark):
    """The interval is the generator's but for chance, repeats exactly, and doesn't depend on how rows are dealt or which replicates are asked for."""
    rng = np.random.default_rng(1)
    rows = [("direct", str(c), float(rng.random() < 0.3 + 0.4 * (c % 2))) for c in range(300) for _ in range(int(rng.integers(1, 6)))]
    rows += [("best_of_4", str(c), None) for c in range(5)] + [("best_of_4", "9", 0.5)]
    picked = spark.createDataFrame(rows, "method string, video string, reward double")
    methods = ("direct", "best_of_4", "absent")
    a, b = ({r[:3]: r[3:] for r in map(tuple, bootstrap.cluster_intervals(p, ("reward",), "video", methods, 2000).collect())} for p in (picked, picked.repartition(5)))
    assert a == b and len(a) == 6 and a["absent", "reward", "effective"] == (0.0, 0.0) and a["absent", "reward", "conditional"] == (None, None)
    sums = bootstrap.cluster_sums(picked, ("reward",), "video").where("method = 'direct'").toPandas().sort_values("cluster")
    for e, n, v in (("conditional", "n_reward", "cond_reward"), ("effective", "n", "eff_reward")):
        want = bootstrap.interval(sums[n].to_numpy(), sums[v].to_numpy(), 2000, np.random.default_rng(42))
        assert a["direct", "reward", e] == pytest.approx(tuple(want), abs=0.01)
    assert a["best_of_4", "reward", "conditional"] == (0.5, 0.5)
    once = bootstrap.cluster_intervals(picked, ("reward",), "video", ("direct",), 0).first()
    assert once["low"] == once["high"]


def test_weights_are_poisson(spark):
    """Weights of one seed equal the plain rule, have mean and variance 1, and the replicates asked for don't change them."""
    clusters = spark.range(300).select(F.col("id").cast("string").alias("c"))
    got = {(r["c"], r["replicate"]): r["w"] for r in clusters.select("c", F.inline(bootstrap.cluster_weights(F.col("c"), 101, 5))).collect()}
    few = {(r["c"], r["replicate"]): r["w"] for r in clusters.select("c", F.inline(bootstrap.cluster_weights(F.col("c"), 9, 5))).collect()}
    assert len(got) == 300 * 101 and len(few) == 300 * 9 and all(got[k] == w for k, w in few.items())
    steps = bootstrap.poisson_steps()
    for (c, r), w in list(got.items())[:2000]:
        h = int(hashlib.sha256(f"5:{r // 8}:{c}".encode()).hexdigest()[8 * (r % 8) : 8 * (r % 8) + 8], 16)
        assert w == sum(h >= s for s in steps)
    w = np.array(list(got.values()))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04
    assert spark.range(1).select(F.size(bootstrap.cluster_weights(F.lit(None), 0, 5))).first()[0] == 0


SHAPES = {
    "ties": [1.0] * 50 + [2.0] * 50, "one": [3.5], "two": [1.0, 2.0], "equal": [7.0] * 9, "heavy": [10.0**k for k in range(-300, 300)], "ends": [0.0, 5e-324, 1.7e308, 1e308, float("inf")], "even": [k / 7 for k in range(5000)],
}


@pytest.mark.parametrize("passes", [0, 1, 2, 3])
def test_selected_quantiles_are_exact(spark, passes, monkeypatch):
    """Against the sorted values, for one engine partitioning and another, with few ranges so that several brackets stay open."""
    monkeypatch.setattr(quantiles, "BINS", 7)
    rows = [(g if g != "even" else None, x) for g, values in SHAPES.items() for x in [*values, None]] + [("empty", None)]
    shares = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q95": 0.95, "q100": 1.0}
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ("g",), "x", shares, passes).collect()
    assert {r["g"] for r in got} == {None if g == "even" else g for g in SHAPES} | {"empty"}
    for r in got:
        if r["g"] == "empty":
            assert r["n"] == 0 and all(r[name] is None for name in shares)
            continue
        values = sorted(SHAPES[r["g"] or "even"])
        assert r["n"] == len(values)
        for name, share in shares.items():
            place = share * (len(values) - 1)
            low, high = math.floor(place), math.ceil(place)
            assert r[name] == (values[low] if low == high else (high - place) * values[low] + (place - low) * values[high]), (r["g"], name)


def test_quantiles_hold_no_group(spark):
    """No aggregate collects values, and none of a whole table gives no rows."""
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.rand(1).alias("x"))
    found = quantiles.exact_quantiles(rows, ("g",), "x", {"m": 0.5})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    whole = quantiles.exact_quantiles(rows, (), "x", {"m": 0.5}).first()
    assert whole["m"] == pytest.approx(rows.agg(F.percentile("x", 0.5)).first()[0], abs=0) and whole["n"] == 1000
    assert quantiles.exact_quantiles(rows.where("false"), ("g",), "x", {"m": 0.5}).count() == 0
