"""Vector functions over array columns and tables of frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorepool.constants import ANCHOR_BALANCE, CENTRALITY, TEMPERATURE, VISUAL_BALANCE

LEAST_NORM = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where the norms' product is at most 1e-8."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms <= LEAST_NORM, F.lit(0.0)).otherwise(dot(a, b) / norms)


def normalized(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(LEAST_NORM))
    return F.transform(doubles(v), lambda x: x / norm)


def clip01(x: Column) -> Column:
    """NaN and infinities go to 0, the rest into [0, 1]."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def half_even(x: Column, digits: int = 6) -> Column:
    return F.bround(x, digits)


def _mean_vector(frames: DataFrame, key: str, weight: Column) -> DataFrame:
    """Rows (key, v): the weighted sum of vectors, put together from per-component sums, so no key's frames are gathered."""
    long = frames.select(key, weight.alias("_w"), F.posexplode(doubles(F.col("embedding"))).alias("_i", "_x"))
    sums = long.groupBy(key, "_i").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"]).alias("v"))


def with_novelty(frames: DataFrame, key: str = "sample_key", order: str = "frame_pos") -> DataFrame:
    """Adds novelty: half the distance to the previous frame's direction; 0.5 for the first."""
    before = F.lag("embedding").over(Window.partitionBy(key).orderBy(order))
    return frames.withColumn("_before", before).withColumn("novelty", F.when(F.col("_before").isNull(), F.lit(0.5)).otherwise(1 - (cosine(F.col("embedding"), F.col("_before")) + 1) / 2)).drop("_before")


def with_weights(frames: DataFrame, key: str = "sample_key", order: str = "frame_pos", centrality: float = CENTRALITY, temperature: float = TEMPERATURE) -> DataFrame:
    """Adds weight: the softmax over a sample's frames of centrality and novelty; 1 for a lone frame."""
    center = _mean_vector(frames, key, F.lit(1.0)).select(key, normalized(F.col("v")).alias("_center"))
    own = Window.partitionBy(key)
    score = centrality * (cosine(F.col("embedding"), F.col("_center")) + 1) / 2 + (1 - centrality) * F.col("novelty")
    scored = with_novelty(frames, key, order).join(center, key).withColumn("_score", score).drop("_center")
    power = F.exp((F.col("_score") - F.max("_score").over(own)) / max(LEAST_NORM, temperature))
    return scored.withColumn("_e", power).withColumn("weight", F.col("_e") / F.sum("_e").over(own)).drop("_score", "_e")


def pooled(weighted: DataFrame, key: str = "sample_key") -> DataFrame:
    """Rows (key, pooled): the weighted sum of frames, L2-normalised."""
    return _mean_vector(weighted, key, F.col("weight")).select(key, normalized(F.col("v")).alias("pooled"))


def key_frames(weighted: DataFrame, key: str = "sample_key", order: str = "frame_pos", n: int = 4) -> DataFrame:
    """The n heaviest frames of each sample, later ones first among equals."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), F.desc(order)))
    return weighted.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


#: Tags that are broadcast at most.
MOST_TAGS = 10_000


def top_tags(samples: DataFrame, tags: DataFrame, key: str = "sample_key") -> DataFrame:
    """Samples (key, pooled) with tags (tag_group, tag, tag_pos, top, embedding): the `top` nearest of each group.

    The taxonomy is a configured list of a few dozen rows; up to MOST_TAGS, which is checked, it is broadcast. More is an error, as
    every sample meets every tag.
    """
    if tags.limit(MOST_TAGS + 1).count() > MOST_TAGS:
        raise ValueError(f"more than {MOST_TAGS} tags")
    scored = samples.crossJoin(F.broadcast(tags)).withColumn("similarity", dot(F.col("pooled"), F.col("embedding")))
    rank = F.row_number().over(Window.partitionBy(key, "tag_group").orderBy(F.desc("similarity"), F.desc("tag_pos")))
    return scored.withColumn("rank", rank).where("rank <= top").select(key, "tag_group", "tag", "rank", "similarity")


def alignment(script: Column, video: Column, anchor: Column, text: Column, tags: Column) -> Column:
    """Half visual similarity, half text evidence: anchor similarity and the share of tags that the text names."""
    lower = F.lower(text)
    hits = F.size(F.filter(tags, lambda t: (t != "") & F.contains(lower, F.lower(t)))) / F.greatest(F.lit(1), F.size(tags))
    evidence = ANCHOR_BALANCE * (cosine(script, anchor) + 1) / 2 + (1 - ANCHOR_BALANCE) * hits
    return VISUAL_BALANCE * (cosine(script, video) + 1) / 2 + (1 - VISUAL_BALANCE) * evidence


def distinct_points(points: Column) -> Column:
    """Reference points without blanks and repeats, in order of first occurrence."""
    stripped = F.transform(points, lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(stripped, lambda p: p != ""))


#: Vectors of a sample that meet as one matrix.
BLOCK = 64


def _blocks(rows: DataFrame, key: str, index: str, name: str) -> DataFrame:
    """Rows (key, name): a sample's vectors with their indices, BLOCK of them in a row."""
    item = F.struct(F.col(index).cast("long").alias("index"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.groupBy(key, F.floor(F.col(index) / BLOCK).alias("_block")).agg(F.array_sort(F.collect_list(item)).alias(name)).drop("_block")


def _matrix(items, width: int) -> np.ndarray:
    """Vectors as rows; an absent one as zeros."""
    out = np.zeros((len(items), width))
    for k, item in enumerate(items):
        if item["v"] is not None:
            out[k] = [0.0 if x is None else x for x in item["v"]]
    return out


def _best_of_block(points: list, others: list) -> list[tuple[int, float, int]]:
    """For each point the greatest cosine with the others, and the first of them that has it."""
    width = max((len(i["v"]) for i in [*points, *others] if i["v"] is not None), default=0)
    a, b = _matrix(points, width), _matrix(others, width)
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    cosines = np.where(norms <= LEAST_NORM, 0.0, (a @ b.T) / np.maximum(norms, LEAST_NORM))
    best = cosines.argmax(axis=1)
    return [(p["index"], float(cosines[k, j]), others[j]["index"]) for k, (p, j) in enumerate(zip(points, best.tolist(), strict=True))]


def point_coverage(points: DataFrame, segments: DataFrame, threshold: float, key: str = "sample_key", whole: DataFrame | None = None) -> DataFrame:
    """points (key, point_index, embedding), segments (key, segment_index, embedding): for each point the best similarity and
    the first segment that has it, and whether it reaches the threshold. Samples without segments are held against their whole text
    (key, embedding) as segment 0, where `whole` is given; a sample without any has no rows. An absent vector is similar to none (0).

    A sample's points and segments meet in blocks: each pair of blocks is one matrix product that gives a best segment for each point, so no
    pair of a point and a segment ever is a row, and a large sample's blocks are dealt over tasks.
    """
    others = segments.select(key, F.col("segment_index").cast("long").alias("segment_index"), "embedding")
    if whole is not None:
        bare = whole.join(segments.select(key).distinct(), key, "left_anti")
        others = others.unionByName(bare.select(key, F.lit(0).cast("long").alias("segment_index"), "embedding"))
    met = _blocks(points, key, "point_index", "points").join(_blocks(others, key, "segment_index", "others"), key)
    kind = points.schema[key].dataType.simpleString()

    def best(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                found = _best_of_block(batch.column("points")[k].as_py(), batch.column("others")[k].as_py())
                own = pa.concat_arrays([batch.column(key).slice(k, 1)] * len(found))
                yield pa.RecordBatch.from_arrays([own, *map(pa.array, zip(*found, strict=True))], names=[key, "point_index", "s", "i"])

    each = met.mapInArrow(best, f"`{key}` {kind}, point_index long, s double, i long")
    top = each.groupBy(key, "point_index").agg(F.max(F.struct("s", (-F.col("i")).alias("i"))).alias("b"))
    index = points.schema["point_index"].dataType.simpleString()
    return top.select(key, F.col("point_index").cast(index).alias("point_index"), F.col("b.s").alias("similarity"), (-F.col("b.i")).alias("segment_index"), (F.col("b.s") >= threshold).alias("covered"))


def mean_coverage(covered: DataFrame, key: str = "sample_key") -> DataFrame:
    """Per sample the number of its points and the share that is covered."""
    return covered.groupBy(key).agg(F.count(F.lit(1)).alias("points"), F.avg(F.col("covered").cast("int")).alias("coverage"))
