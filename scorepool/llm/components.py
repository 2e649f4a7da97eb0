"""Connected components of an edge table by alternating large-star and small-star steps, all on DataFrames.

A node's edges meet its least neighbour in a join. Nodes with more than a thousandth of all edges (and NODE_EDGES at least) are
split: their edges are dealt by a hash of the other end, and the node's least neighbour goes to each of those shares. There
are at most 2000 such nodes, as each takes part in that many edge ends, so their list is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorepool.llm.common import materialise

MAX_ROUNDS = 60
#: Edges of a node that stay together; twice the reciprocal of HOT_SHARE bounds the number of split nodes.
NODE_EDGES, HOT_SHARE = 200, 1000


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _with_least(edges: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """edges with the least b of each edge's a as m, and the table of those (a, m). `number`: edges there are."""
    limit = max(NODE_EDGES, number // HOT_SHARE)
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("s"))
    hot = F.broadcast(least.where("s > 1").select("a", "s"))  # at most 2 * HOT_SHARE rows
    share = F.pmod(F.xxhash64("b"), F.coalesce("s", F.lit(1))).cast("int")
    dealt = edges.join(hot, "a", "left").select("a", "b", share.alias("k"))
    spread = least.select("a", "m", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("k"))
    return dealt.join(spread.hint("shuffle_merge"), ["a", "k"]).select("a", "b", "m"), least.select("a", "m")


def _large_star(edges: DataFrame, number: int) -> DataFrame:
    """Every larger neighbour of a node goes to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met, _ = _with_least(both, number)
    return met.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, number: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the least of them. Edges come as (larger, smaller)."""
    met, least = _with_least(edges, number)
    moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs to rows (node, component): every node with an edge and the least node it reaches. Nulls and loops are ignored."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "edges")
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        now = materialise(_small_star(_large_star(now, mark[0]), mark[0]), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # every remaining edge leads to its component's least node
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
