"""Substring dedup, the n-gram join and scores against brute force."""

import math
import sys

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from scorepool.llm import ctw, exchange, ngram_join
from scorepool.llm.common import crc_bucket
from scorepool.llm.components import components
from scorepool.llm.substring_dedup import remove_repeats


def ranked(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(params=[None, 200])
def cells(request, monkeypatch):
    """Also with many small packets and buckets."""
    if request.param:
        monkeypatch.setattr(exchange, "LEAST_CELLS", request.param)


def test_substring_dedup(docs, rows, cells):
    assert ranked(remove_repeats(docs).collect()) == ranked(brute.substring_dedup(rows))


def test_shingle_components(docs, rows, cells):
    assert ranked(ngram_join.shingle_components(docs).collect()) == ranked(brute.shingle_components(rows))


@pytest.mark.parametrize("most", [0, 100])
def test_split_groups_link_alike(docs, rows, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "LARGE_GROUPS", most)
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 1)
    monkeypatch.setattr(ngram_join, "GROUP_SHARE", 0)
    assert ranked(ngram_join.shingle_components(docs).collect()) == ranked(brute.shingle_components(rows))


def test_one_of_each_keeps_columns(docs, rows):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = [(d, t) for (d, t), (_, _, c) in zip(rows, brute.shingle_components(rows), strict=True) if d is None or d == c]
    assert ranked(kept.select("doc_id", "text").collect()) == ranked(want)


def test_similarity_bound():
    assert ngram_join.similar(8, 8, 10) and not ngram_join.similar(8, 9, 10)
    for n in range(1, 60):
        assert ngram_join.prefix_length(n) == n - math.ceil(0.8 * n - 1e-9) + 1


def test_random_sets():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = [rng.choice(300, size=rng.integers(1, 50), replace=False) for _ in range(3)]
        sets = []
        for _ in range(rng.integers(2, 25)):
            b = base[rng.integers(3)].copy()
            k = rng.integers(0, len(b) // 4 + 1)
            b[rng.permutation(len(b))[:k]] = rng.integers(1000, 4000, k)
            sets.append(np.unique(b).astype(np.uint64))
        up = list(range(len(sets)))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        plain = [set(s.tolist()) for s in sets]
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j]):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
        assert ngram_join.link(sets) == [find(i) for i in range(len(sets))]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("edges, share", [(1, 1000), (200, 1000), (3, 2)])
def test_hot_nodes_are_split(spark, monkeypatch, edges, share):
    """Hot nodes, whole and split, at both ends of the order, and a path between them."""
    monkeypatch.setattr(sys.modules[components.__module__], "NODE_EDGES", edges)
    monkeypatch.setattr(sys.modules[components.__module__], "HOT_SHARE", share)
    rows = [(0, i) for i in range(1, 300)] + [(i, 2000) for i in range(1000, 1300)] + [(299, 400), (400, 401), (401, 1299), (5000, 5001)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {x: 0 for r in rows[:-1] for x in r} | {5000: 5000, 5001: 5000}


def test_cells_follow_the_input():
    """Rows that a packet sends stay few against its keys at any size, and cells stay within a worker's memory."""
    for total in (0, 1, 10**9, 10**12, 10**14):
        n = exchange.cells_of(total)
        cell = total / n
        assert n >= exchange.LEAST_CELLS and cell <= 300e6 and n < 1 << 24
        assert total < 10**11 or cell / 6 / n > 100  # keys in a row


def test_null_and_repeated_ids_are_spread(spark):
    rows = [(None, f"a{i}") for i in range(300)] + [(7, f"b{i}") for i in range(300)]
    sizes = [r["count"] for r in exchange.packets(spark.createDataFrame(rows, "doc_id long, text string"), 50).groupBy("packet").count().collect()]
    assert max(sizes) < 40


def test_equal_sets_meet_across_packets(spark, cells):
    """Copies, copies with other white space, and two different sets of the same size."""
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(i, base if i % 2 else base.upper().replace(" ", "\n")) for i in range(10, 60)] + [(5, " ".join(f"v{i}" for i in range(30))), (70, base + " x y z"), (80, "one"), (81, "ONE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ranked(ngram_join.shingle_components(docs).collect()) == ranked(brute.shingle_components(rows))


def scored(docs):
    learns = crc_bucket(F.col("doc_id"), 7) != 2
    return ctw.score(docs, ctw.train(docs.where(learns)), learns)


def test_scores(docs, rows):
    got = ranked(scored(docs).collect())
    want = ranked(brute.base_scores(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(g[6] < 0 for g in got)


def test_scores_without_training_rows(docs):
    got = ctw.score(docs, ctw.train(docs.where("false")), F.lit(False)).collect()
    assert {r["train_tokens"] for r in got} == {0} and {r["n_known"] for r in got} == {0}
    one = next(r for r in got if r["doc_id"] == 6)
    assert one["score"] == pytest.approx(4 * 8 * math.log10(0.5))  # "one" and its end, a half for each bit


def kt_tree(data, contexts):
    """Weighted probabilities of every next byte by a plain recursive context tree without tables."""
    counts = {}
    for past, byte in data:
        for k in range(8):
            prefix = (1 << k) | (byte >> (8 - k))
            for d in range(ctw.DEPTH + 1):
                node = counts.setdefault((past[len(past) - d :], prefix), [0, 0])
                node[(byte >> (7 - k)) & 1] += 1
    children = {}
    for context, prefix in counts:
        if context:
            children.setdefault((context[1:], prefix), []).append((context, prefix))

    def kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    weighted = {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        e = kt(*counts[node])
        weighted[node] = e if len(node[0]) == ctw.DEPTH else np.logaddexp(e, sum(weighted[c] for c in children[node])) - math.log(2)

    def probability(past, byte):
        out = 0.0
        for k in range(8):
            prefix, bit, p, seen = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1, 0.5, False
            for d in range(ctw.DEPTH, -1, -1):
                node = (past[len(past) - d :], prefix)
                if node in counts:
                    n0, n1 = counts[node]
                    own = (n1 + 0.5) / (n0 + n1 + 1)
                    stop = 1.0 if d == ctw.DEPTH else math.exp(kt(n0, n1) - math.log(2) - weighted[node])
                    p, seen = (stop * own + (1 - stop) * p if seen else own), True
            out += math.log10(p if bit else 1 - p)
        return out

    return [probability(*c) for c in contexts]


def test_tree_equals_plain_recursion():
    import pyarrow as pa

    from scorepool.llm.common import utf8

    texts, other = ["the cat sat on the mat", "the hat", "", "a cat"], ["the rat sat", "xyz"]

    def steps(t):
        raw = t.lower().encode() + bytes([ctw.END])
        return [((bytes([ctw.END] * ctw.DEPTH) + raw)[i : i + ctw.DEPTH], b) for i, b in enumerate(raw)]

    gram, _ = ctw.grams(*utf8(pa.array(texts)))
    keys, number = np.unique(gram, return_counts=True)
    node = ctw.strongest(*ctw._sum_nodes(*ctw.tally(keys, number)))
    tree = ctw.build(*node[1:], node[0].astype(np.uint16))
    got = tree.scores(*utf8(pa.array(other)))
    want = [sum(kt_tree([s for t in texts for s in steps(t)], steps(o))) for o in other]
    assert got.tolist() == pytest.approx(want, rel=2e-3)  # stopping weights are kept in half precision


def test_every_node_is_kept(spark):
    """Contexts that would meet in tables of a fixed size: scores equal plain recursion."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x21, 0x41, 1500))) for _ in range(16)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.score(docs, ctw.train(docs.where("doc_id < 15")), F.col("doc_id") < 15).collect()}

    def steps(t):
        raw = bytes([ctw.END] * ctw.DEPTH) + t.encode() + bytes([ctw.END])
        return [(raw[i : i + ctw.DEPTH], raw[i + ctw.DEPTH]) for i in range(len(t) + 1)]

    want = kt_tree([s for t in texts[:15] for s in steps(t)], [s for t in texts for s in steps(t)])
    assert [got[i] for i in range(16)] == pytest.approx([sum(want[1501 * i : 1501 * (i + 1)]) for i in range(16)], rel=1e-6)


def test_empty_tables(empty):
    assert remove_repeats(empty).count() == 0
    assert ngram_join.shingle_components(empty).count() == 0
    assert scored(empty).count() == 0
