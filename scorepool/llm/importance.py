"""Target-distribution importance resampling over hashed word n-grams, with position tables.

A position table has a row for each word of a document. The words that follow are put beside each word by lead() within the document,
so that every order's n-gram is one concatenation; n-grams are hashed to buckets, counted by group, and each bucket's gain is joined to
the rows, whose sums by document give weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorepool.llm.common import _LOWER, materialise, slices, utf8

BUCKETS = 10_000
ORDERS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Copies of one row that one row of the result stands for until the very end.
STRETCH = 1 << 16

_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def _plain(array: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and one space between words, none at the ends."""
    data, bounds = utf8(array)
    data = np.where(_WORD[data], _LOWER[data], np.uint8(32))
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    solid = data != 32
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the space after a word stays
    keep &= solid | ~first[:-1]  # but not one that begins a text
    before = np.concatenate([[0], np.cumsum(keep)])
    sizes = np.diff(before[bounds])
    out = data[keep]
    tail = np.flatnonzero(sizes > 0)
    end = before[bounds][1:][tail] - 1
    drop = end[out[end] == 32]  # nor one that ends it
    mask = np.ones(len(out), bool)
    mask[drop] = False
    sizes[tail[out[end] == 32]] -= 1
    return pa.LargeStringArray.from_buffers(len(array), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(out[mask].tobytes()))


def plain_texts(docs: DataFrame, id_column: str) -> DataFrame:
    """(key, text): texts as words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased, one space between two; null as empty."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("key"), _plain(part.column("text"))], names=["key", "text"])

    return docs.select(F.col(id_column).cast("long").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, text string")


def positions(rows: DataFrame, orders: int) -> DataFrame:
    """The position table of rows (key, d1, d2, copies, words): (key, d1, d2, copies, pos, grams), grams holding the n-gram of each
    order that begins at pos. A document without words keeps one row, with null pos and grams. For orders beyond 1 the rows of a
    document must be one row of the input, as copies would interleave."""
    table = rows.select("key", "d1", "d2", "copies", F.posexplode_outer("words").alias("pos", "gram1"))
    if orders == 1:
        return table.select("key", "d1", "d2", "copies", "pos", F.array("gram1").alias("grams"))
    along = Window.partitionBy("key", "d1", "d2").orderBy("pos")
    grams = ["gram1"]
    for n in range(2, orders + 1):
        table = table.withColumn(f"gram{n}", F.concat(F.col(grams[-1]), F.lit(" "), F.lead("gram1", n - 1).over(along)))  # null where no word follows
        grams.append(f"gram{n}")
    return table.select("key", "d1", "d2", "copies", "pos", F.array(*grams).alias("grams"))


def bucketed(table: DataFrame, orders: int, buckets: int) -> DataFrame:
    """A position table with one row for each n-gram, as its bucket; null for documents without any."""
    bucket = (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int").alias("bucket")
    if orders == 1:
        return table.select("key", "d1", "d2", "copies", "pos", F.lit(1).alias("n"), F.col("grams")[0].alias("gram")).select("key", "d1", "d2", "copies", "pos", "n", bucket)
    each = table.select("key", "d1", "d2", "copies", "pos", F.posexplode("grams").alias("n", "gram"))
    return each.where("gram is not null or n = 0").select("key", "d1", "d2", "copies", "pos", (F.col("n") + 1).alias("n"), bucket)


def keyed(docs: DataFrame, id_column: str, orders: int) -> DataFrame:
    """Rows (key, d1, d2, copies, words). 128 bits of hashes of its words (d1, d2) tell a row from others of its id. Beyond order 1 equal rows become
    one, with their number, and lie where lead() needs them, so that the exploded words are not shuffled again."""
    rows = plain_texts(docs, id_column).select("key", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"), "text")
    words = F.when(F.col("text") != "", F.split("text", " ")).otherwise(F.array().cast("array<string>")).alias("words")
    if orders > 1:
        rows = rows.groupBy("key", "d1", "d2").agg(F.max("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return rows.select("key", "d1", "d2", F.col("copies") if orders > 1 else F.lit(1).cast("long").alias("copies"), words)


def bucket_counts(docs: DataFrame, id_column: str, orders: int, buckets: int, name: str) -> DataFrame:
    """(bucket, name): how often n-grams of the bucket occur; at most `buckets` rows, counted before any shuffle."""
    table = bucketed(positions(keyed(docs, id_column, orders), orders), orders, buckets)
    return table.where("bucket is not null").groupBy("bucket").agg(F.sum("copies").alias(name))


def gains(docs: DataFrame, target: DataFrame, target_id: str = "item_id", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), S, s, T and t the n-grams of docs and target, all and
    in the bucket."""
    spark = docs.sparkSession
    s, t = bucket_counts(docs, "doc_id", orders, buckets, "s"), bucket_counts(target, target_id, orders, buckets, "t")
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    total = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))  # one row
    ratio = ((F.col("t") + 1).cast("double") * (F.col("all_s") + F.lit(float(buckets)))) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + F.lit(float(buckets))))
    return both.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, table: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, copies): the floored mean gain of each row's n-grams, equal rows merged."""
    grams = bucketed(positions(keyed(docs, "doc_id", orders), orders), orders, buckets)
    joined = grams.join(F.broadcast(table), "bucket", "left")  # `buckets` rows
    first = (F.col("n") == 1) & (F.coalesce(F.col("pos"), F.lit(0)) == 0)
    # each row of a position table stands for `copies` equal documents beyond order 1, and at order 1 for one of them
    sums = joined.groupBy("key", "d1", "d2").agg(
        F.sum(F.when(first, F.col("copies")).otherwise(0)).alias("copies"),
        F.sum(F.when((F.col("n") == 1) & F.col("pos").isNotNull(), F.col("copies")).otherwise(0)).alias("w"),
        F.sum(F.when(F.col("bucket").isNotNull(), F.col("copies")).otherwise(0)).alias("f"),
        F.sum(F.coalesce(F.col("gain"), F.lit(0)) * F.col("copies")).alias("g"),
    )
    weight = F.when(F.col("f") == 0, 0).otherwise(F.expr("(g - pmod(g, greatest(f, 1))) div greatest(f, 1)")).cast("long")
    return sums.select(F.col("key").alias("doc_id"), F.expr("w div copies").alias("n_words"), F.expr("f div copies").alias("n_features"), weight.alias("weight"), "copies")


def noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from the first 8 hex digits of sha256(seed:doc_id); a null id is the empty text there."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, target_id: str = "item_id", orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs; rank is null for rows that are not drawn.

    The floor(percent * N / 100) highest scores are drawn from the N rows with at least least_words words; of equal scores the
    smaller doc_id first (null before all), rows that share id and score in any order. Null and empty texts have no features and
    weight 0; texts of any length are counted whole; repeated rows each get a row of their own and distinct ranks; an empty table
    gives no rows, an empty target makes rare n-grams of docs count more; other columns, whatever their names, are ignored.

    Equal rows stay one row with their number until the end, so a group of copies is never gathered. Scores are whole thousandths
    of logarithms: their histogram has at most a few hundred thousand rows whatever the input, and is all that reaches the driver.
    """
    spark = docs.sparkSession
    scored = weights(docs, gains(docs, target, target_id, orders, buckets), orders, buckets)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("able", F.col("n_words") >= least_words)
    # rows alike in all that is returned are one; summed before the shuffle
    held = materialise(scored.groupBy("doc_id", "n_features", "weight", "score", "able").agg(F.sum("copies").alias("copies")), "importance")
    histogram = sorted((tuple(r) for r in held.where("able").groupBy("score").agg(F.sum("copies")).collect()), reverse=True)
    draw, before, ahead = percent * sum(n for _, n in histogram) // 100, 0, []
    for score, n in histogram:
        if before >= draw:
            break
        ahead.append((score, before))
        before += n
    ahead = spark.createDataFrame(ahead, "score long, ahead long").coalesce(1)
    drawn = held.where("able").join(F.broadcast(ahead), "score")
    so_far = Window.partitionBy("score").orderBy("doc_id", "n_features").rowsBetween(Window.unboundedPreceding, -1)
    ranked = drawn.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("copies").over(so_far), F.lit(0)))
    rest = held.join(F.broadcast(ahead.select("score", F.lit(True).alias("able"))), ["score", "able"], "left_anti").withColumn("ahead", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "ahead", "copies"]
    stretches = ranked.select(columns).unionByName(rest.select(columns)).select("*", F.explode(F.expr(f"sequence(0L, copies - 1, {STRETCH}L)")).alias("base"))
    each = stretches.select("*", F.explode(F.expr(f"sequence(base, least(copies, base + {STRETCH}) - 1)")).alias("copy"))
    rank = F.col("ahead") + F.col("copy") + 1
    return each.select("doc_id", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))
