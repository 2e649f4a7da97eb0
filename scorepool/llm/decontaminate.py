"""Benchmark decontamination by spaced seeds.

A seed is a mask that looks at four words and ignores those between. Two masks are enough: exhaustively, every pattern of agreement that
the rules below accept has one of them at some place with all four words agreeing (`tests/llm` tries all patterns). Masked words of
both sides are hashed, and the hashes of texts and items are joined by shuffle. Each row carries the words around its seed, so a hit is
verified where the two meet.

The rules: an item is held against a text word by word, at any shift. An overlap is a stretch of LEAST to MOST words of an item of
which MIN_AGREE or more, and MIN_SHARE of them, agree; or a whole item of LEAST words or more of which MIN_SHARE agree. Words
that lie beyond the text's ends don't agree. A shorter item counts only as a whole, word for word.

An item of more than MOST words of which MIN_SHARE agree may have no such stretch, but has a seed; if it is twice as long as CHUNK, it
falls into chunks of CHUNK to MOST words, of one of which that share agrees, with a seed in it. Where only that is seen around a seed, and the
pair has no overlap otherwise, the whole item is laid over the text at that shift.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorepool.llm.common import Words, doc_text, materialise, mix64, slices, windows

#: Words that each mask looks at; the others of its span are ignored.
MASKS = ((0, 1, 2, 4), (0, 3, 4, 5))
#: Words of a stretch, at least and at most, how many must agree, and which share.
LEAST, MOST, MIN_AGREE, MIN_SHARE = 11, 16, 11, 0.75
CHUNK = 12
#: Words before and after a seed's first that a stretch with the seed in it can hold.
BEFORE, AFTER = MOST - 5, MOST
SPAN = BEFORE + AFTER
#: Bits of the filter of benchmark hashes: 8 MB, whatever the benchmark's size. A large benchmark fills it, and more seeds of texts are shuffled for nothing.
FILTER_BITS, _PART_BITS = 26, 19
#: Texts that are broadcast at most, by two hashes, to find the rows that hold them (16 bytes each); with more, rows are shuffled.
MOST_BROADCAST = 1_000_000
#: Verified at once.
ROWS = 4096

_STEP = np.uint64(0xA0761D6478BD642F)
#: What stands for a word beyond the ends of a text and of an item.
_NO_TEXT, _NO_ITEM = 0, 1


def _seeds(words: np.ndarray, doc_of: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of a mask at every place where it lies in one text."""
    offsets = MASKS[mask]
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = np.full(n, mask + 1, np.uint64)
    for o in offsets:
        x = x * _STEP + words[o : o + n]
    at = np.flatnonzero(doc_of[:n] == doc_of[offsets[-1] :])
    return at, mix64(x)[at]


def _runs(words: np.ndarray, doc_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of runs of n words that lie in one text."""
    h = windows(words, n)
    at = np.flatnonzero(doc_of[: len(h)] == doc_of[n - 1 :]) if len(h) else np.zeros(0, np.int64)
    return at, h[at]


def _around(short: np.ndarray, ptr: np.ndarray, doc: np.ndarray, at: np.ndarray, beyond: int) -> np.ndarray:
    """The words around each place, 32 bits each, as rows of SPAN."""
    place = at[:, None] + np.arange(-BEFORE, AFTER)
    inside = (place >= ptr[doc][:, None]) & (place < ptr[doc + 1][:, None])
    return np.where(inside, short[np.clip(place, 0, max(0, len(short) - 1))], np.uint32(beyond)).astype("<u4")


def _short_hashes(words: np.ndarray) -> np.ndarray:
    return np.maximum((words >> np.uint64(32)).astype(np.uint32), np.uint32(2))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    n, raw = len(rows), np.ascontiguousarray(rows).tobytes()
    size = len(raw) // n if n else 0
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(raw)])


def _first_of_each(*keys: np.ndarray) -> np.ndarray:
    """The first of equal rows, in order of place."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    order = np.lexsort([np.arange(len(keys[0])), *keys])
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return np.sort(order[new])


_ITEMS = "key long, item long, item_id long, size int, item_at int, item_around binary"


def _item_seeds(items: DataFrame) -> DataFrame:
    """Rows of _ITEMS: each seed of each item; a shorter item's only seed is its whole run, without words around it. Of equal rows of an
    item only the first, as an overlap is reported at its earliest place."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), lower=True)
                size = np.diff(w.ptr)
                doc_of, short = np.repeat(np.arange(len(size)), size), _short_hashes(w.hash)
                for n in (*range(1, LEAST), *(-1 - m for m in range(len(MASKS)))):
                    at, keys = _runs(w.hash, doc_of, n) if n > 0 else _seeds(w.hash, doc_of, -1 - n)
                    own = (size[doc_of[at]] == n) if n > 0 else (size[doc_of[at]] >= LEAST)
                    at, keys = at[own], keys[own]
                    doc = doc_of[at]
                    around = _around(short, w.ptr, doc, at, _NO_ITEM) if n < 0 else np.zeros((len(at), 0), "<u4")
                    first = _first_of_each(doc, keys, *[around[:, k] for k in range(around.shape[1])])
                    at, doc, keys, around = at[first], doc[first], keys[first], around[first]
                    columns = [pa.array(keys.view(np.int64)), *(part.column(c).take(pa.array(doc)) for c in ("item", "item_id")), pa.array(size[doc].astype(np.int32)), pa.array((at - w.ptr[doc]).astype(np.int32)), _binary(around) if n < 0 else pa.array([b""] * len(at), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ITEMS.split(", ")])

    return items.mapInArrow(run, _ITEMS)


def _filter(seeds: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit for each hash of the benchmark's seeds, and the lengths of its shorter items. Bits are set in the executors, a part of 64 KB each, and
    merged there; the driver gets at most 8 MB and ten lengths."""

    def part(key, table):
        bits = np.zeros(1 << _PART_BITS, bool)
        bits[table.column("bit").to_numpy()] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    slot = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    slots = seeds.select(F.shiftright(slot, _PART_BITS).cast("int").alias("part"), (slot % (1 << _PART_BITS)).cast("int").alias("bit")).distinct()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in slots.groupBy("part").applyInArrow(part, "part int, bits binary").collect():
        held = np.frombuffer(r["bits"], np.uint8)
        out[r["part"] * len(held) : (r["part"] + 1) * len(held)] = held
    lengths = [r["size"] for r in seeds.where(F.col("size") < LEAST).select("size").distinct().collect()]
    return out, sorted(lengths)


_TEXTS = "key long, d1 long, d2 long, text_at long, text_around binary"


def _text_seeds(texts: DataFrame, held) -> DataFrame:
    """Rows of _TEXTS: the seeds of texts that the filter lets pass. Equal seeds of a text with the same words around them are one, the first."""

    def run(batches):
        bits, lengths = held.value
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), lower=True)
                size = np.diff(w.ptr)
                doc_of, short = np.repeat(np.arange(len(size)), size), _short_hashes(w.hash)
                for n in (*lengths, *(-1 - m for m in range(len(MASKS)))):
                    at, keys = _runs(w.hash, doc_of, n) if n > 0 else _seeds(w.hash, doc_of, -1 - n)
                    slot = keys >> np.uint64(64 - FILTER_BITS)
                    passed = (bits[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1 == 1
                    at, keys = at[passed], keys[passed]
                    doc = doc_of[at]
                    around = _around(short, w.ptr, doc, at, _NO_TEXT) if n < 0 else np.zeros((len(at), 0), "<u4")
                    first = _first_of_each(doc, keys, *[around[:, k] for k in range(around.shape[1])])
                    at, doc, keys, around = at[first], doc[first], keys[first], around[first]
                    if len(at):
                        columns = [pa.array(keys.view(np.int64)), part.column("d1").take(pa.array(doc)), part.column("d2").take(pa.array(doc)), pa.array(at - w.ptr[doc]), _binary(around) if n < 0 else pa.array([b""] * len(at), pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _TEXTS.split(", ")])

    return texts.mapInArrow(run, _TEXTS)


def _share(n: int) -> int:
    return int(np.ceil(MIN_SHARE * n))


def verify(text: np.ndarray, item: np.ndarray, item_at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs of words around a seed (rows of SPAN): how many words of the best overlap agree (0 without one), where it begins in the
    row, how many words it has, from the first that agrees to the last, and whether a chunk agrees. Best is most agreeing, then shortest, then first."""
    same = text == item
    n_rows = len(same)
    agree = np.zeros((n_rows, SPAN + 1), np.int64)
    np.cumsum(same, axis=1, out=agree[:, 1:])
    index = np.arange(SPAN)
    later = np.minimum.accumulate(np.where(same, index, SPAN)[:, ::-1], axis=1)[:, ::-1]  # the first that agrees from here on
    earlier = np.maximum.accumulate(np.where(same, index, -1), axis=1)
    low, high = np.maximum(0, BEFORE - item_at), np.minimum(SPAN, BEFORE + size - item_at)
    best, chunk = np.zeros(n_rows, np.int64), np.zeros(n_rows, bool)
    for n in range(LEAST, MOST + 1):
        for s in range(SPAN - n + 1):
            count = agree[:, s + n] - agree[:, s]
            near = (s >= low) & (s + n <= high) & (count >= _share(n))
            chunk |= near & (n >= CHUNK)
            ok = near & ((count >= MIN_AGREE) | (size == n))
            if ok.any():
                first = later[:, s]
                length = earlier[:, s + n - 1] - first + 1
                best = np.maximum(best, np.where(ok, (count << 16) | ((255 - length) << 8) | (255 - first), 0))
    return best >> 16, 255 - (best & 255), 255 - ((best >> 8) & 255), chunk


#: Rows with a shift have no overlap yet: at that shift a seed or a chunk of the item agrees, and the whole item may.
_FOUND = "d1 long, d2 long, item long, item_id long, n_agree long, n_words long, start_word long, item_word long, shift long"


def _verified(batches):
    names = [c.split()[0] for c in _FOUND.split(", ")]
    keys = ("d1", "d2", "item", "item_id")
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            whole = np.array([not x for x in part.column("item_around").to_pylist()])
            short = part.filter(pa.array(whole))
            if short.num_rows:  # shorter items: the whole run agrees
                size = short.column("size").to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(short.column(c) for c in keys), pa.array(size), pa.array(size), short.column("text_at"), pa.array(np.zeros(len(size), np.int64)), pa.nulls(len(size), pa.int64())], names=names)
            rows = part.filter(pa.array(~whole))
            if not rows.num_rows:
                continue
            text, item = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "<u4").reshape(-1, SPAN) for c in ("text_around", "item_around"))
            item_at, size, text_at = (rows.column(c).to_numpy().astype(np.int64) for c in ("item_at", "size", "text_at"))
            agree, first, length, chunk = verify(text, item, item_at, size)
            good = np.flatnonzero((agree > 0) | ((size > MOST) & (chunk | (size < 2 * CHUNK))))
            move = (first - BEFORE)[good]
            columns = [pa.array(x[good]) for x in (agree, length)] + [pa.array(text_at[good] + move), pa.array(item_at[good] + move), pa.array((text_at - item_at)[good], mask=agree[good] > 0)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(good)) for c in keys), *columns], names=names)


def _laid_over(batches):
    """Whole items at stated shifts of texts: rows of _FOUND where MIN_SHARE of the item's words agree."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            text, item = (Words(pa.array([r[c]]), lower=True).hash for c in ("text", "passage"))
            lo, hi = max(0, r["shift"]), min(len(text), r["shift"] + len(item))
            same = np.flatnonzero(text[lo:hi] == item[lo - r["shift"] : hi - r["shift"]]) if hi > lo else np.zeros(0, np.int64)
            if len(item) and len(same) >= _share(len(item)):
                start = lo + int(same[0])
                out.append((r["d1"], r["d2"], r["item"], r["item_id"], len(same), int(same[-1] - same[0]) + 1, start, start - r["shift"], None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)


def _named(docs: DataFrame) -> DataFrame:
    """docs with two hashes of the text, which name it: copies of a text are searched alike."""
    text = F.col("text").cast("string")
    return docs.withColumn("d1", F.xxhash64(text)).withColumn("d2", F.xxhash64(F.lit(1), text))


def _small(names: DataFrame) -> DataFrame:
    """Two hashes of each of some texts, to be broadcast if they are few enough."""
    return F.broadcast(names) if names.count() <= MOST_BROADCAST else names


def found(docs: DataFrame, benchmark: DataFrame, unnamed: bool = False) -> DataFrame | None:
    """(d1, d2, item_id, n_agree, n_words, start_word, item_word): the best overlap of each text and item; None for an empty benchmark."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = (items.fillna(0, ["item_id"]) if unnamed else items.where("item_id is not null")).withColumn("item", F.xxhash64("text"))  # an id may have several texts
    seeds = _item_seeds(items)
    bits, lengths = _filter(seeds)
    if not bits.any():
        return None
    texts = _named(doc_text(docs)).where("text is not null").select("d1", "d2", "text")
    held = spark.sparkContext.broadcast((bits, lengths))  # 8 MB
    # copies of a text and of a passage are one row before they meet; a hash that many texts hold is split as it is joined
    own = _text_seeds(texts, held).groupBy("key", "d1", "d2", "text_around").agg(F.min("text_at").alias("text_at"))
    met = materialise(own.join(seeds.hint("shuffle_merge"), "key").mapInArrow(_verified, _FOUND), "overlaps")
    sure = met.where("shift is null")
    open_ = met.where("shift is not null").select("d1", "d2", "item", "item_id", "shift").distinct().join(sure.select("d1", "d2", "item_id").distinct(), ["d1", "d2", "item_id"], "left_anti")
    open_ = materialise(open_, "open-overlaps")
    once = texts.join(_small(open_.select("d1", "d2").distinct()), ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])  # of few texts
    passages = items.select("item", F.col("text").alias("passage")).dropDuplicates(["item"])
    laid = open_.join(once, ["d1", "d2"]).join(passages, "item").mapInArrow(_laid_over, _FOUND)
    order = F.struct("n_agree", (-F.col("n_words")).alias("w"), (-F.col("start_word")).alias("s"), (-F.col("item_word")).alias("i"))
    best = sure.unionByName(laid).groupBy("d1", "d2", "item_id").agg(F.max(order).alias("b"))
    return best.select("d1", "d2", "item_id", F.col("b.n_agree").alias("n_agree"), (-F.col("b.w")).alias("n_words"), (-F.col("b.s")).alias("start_word"), (-F.col("b.i")).alias("item_word"))


SCHEMA = "doc_id long, item_id long, start_word long, n_words long, n_agree long, item_word long"


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words, n_agree, item_word): texts that hold a benchmark passage, one row for each
    text row and item, with the overlap in which most words agree; of those the shortest, then the first in the text, then in the item. It
    goes from the first word that agrees to the last.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Null texts, null ids of items and empty tables give no rows; very long texts are
    searched whole; repeated rows of docs give repeated rows, null ids too; extra columns are ignored.
    """
    hits = found(docs, benchmark)
    if hits is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    rows = _named(doc_text(docs)).select("doc_id", "d1", "d2")
    return rows.join(hits, ["d1", "d2"]).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs without an overlap, also with items that have no id; all columns kept.

    Null and empty texts stay, and all rows where the benchmark is empty; very long texts are searched whole; repeated rows are
    judged alike; an empty table gives none.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    hits = found(docs, benchmark, unnamed=True)
    if hits is None:
        return docs
    bad = materialise(hits.select(F.col("d1").alias("_bad1"), F.col("d2").alias("_bad2")).distinct(), "contaminated")
    own = (F.xxhash64("text") == F.col("_bad1")) & (F.xxhash64(F.lit(1), "text") == F.col("_bad2"))
    return docs.join(_small(bad), own, "left_anti")
