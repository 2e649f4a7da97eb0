"""The elements of JSON lists, read from parts of a file by many tasks.

A part begins anywhere, so it isn't known whether it begins within a text, or how deep. Each part is therefore first summed up for both
cases: whether it turns texts on or off, and by how much the depth changes if it begins outside or inside a text. Running sums over a
file's parts then give the true state at each part's start. With it a part finds the commas between the list's elements, and reads the
elements that begin in it, the last one beyond its end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorepool.sources.streams import chunks, listed, opened

PART_BYTES = 64 << 20
READ_BYTES = 1 << 20
#: White space between a key and its list, at most.
KEY_BYTES = 4096
_BOM = b"\xef\xbb\xbf"


@dataclass
class State:
    """Where a reader stands: within a text, after an odd number of backslashes, and how deep in lists and objects."""

    inside: bool = False
    escaped: bool = False
    depth: int = 0


def structure(data: np.ndarray, state: State) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some bytes: which are outside texts, the depth after each, and whether each opens (1), closes (-1) or neither. Moves the state."""
    n = len(data)
    slash, quote = data == 92, data == 34
    if state.escaped or slash.any():
        at = np.arange(n)
        run = at - np.maximum.accumulate(np.where(slash, -1, at))  # backslashes that end here, if any reach back to a byte before
        whole = np.logical_and.accumulate(slash)
        run = np.where(whole, at + 1 + int(state.escaped), run)
        odd = slash & (run % 2 == 1)
        quote = quote & ~np.concatenate([[state.escaped], odd[:-1]])
        state.escaped = bool(odd[-1]) if n else state.escaped
    out = (np.cumsum(quote) + int(state.inside)) % 2 == 0
    step = np.zeros(n, np.int8)
    step[out & ((data == 91) | (data == 123))] = 1
    step[out & ((data == 93) | (data == 125))] = -1
    depth = state.depth + np.cumsum(step, dtype=np.int64)
    if n:
        state.inside, state.depth = not bool(out[-1]), int(depth[-1])
    return out, depth, step


def _escaped_at(f, start: int) -> bool:
    """Whether an odd number of backslashes ends right before start."""
    n = 0
    while start - n > 0:
        low = max(0, start - n - 4096)
        f.seek(low)
        held = f.read(start - n - low)
        bare = held.rstrip(b"\\")
        n += len(held) - len(bare)
        if bare:
            break
    return n % 2 == 1


def _summary(path: str, start: int, end: int) -> dict:
    """flips, and the change of depth for a part that begins outside (d0) or inside (d1) a text; the first byte of the file's value."""
    first, d = None, [0, 0]
    with opened(path) as f:
        state = State(escaped=_escaped_at(f, start))
        for held in chunks(f, start, end, READ_BYTES):
            if start == 0 and first is None:
                head = held.removeprefix(_BOM).lstrip(b" \t\r\n")
                first = chr(head[0]) if head else None
            data, was = np.frombuffer(held, np.uint8), State(state.inside, state.escaped, 0)
            out, depth, step = structure(data, was)
            d[0] += int(step.sum())
            flipped = State(not state.inside, state.escaped, 0)
            d[1] += int(structure(data, flipped)[2].sum())
            state = State(was.inside, was.escaped, 0)
    return {"path": path, "start": start, "end": end, "first": first, "flips": int(state.inside), "d0": d[0], "d1": d[1]}


def _lists(path: str, start: int, end: int, inside: bool, depth: int, keys: tuple[str, ...]):
    """Of a file that holds an object: where in this part a list begins under one of the keys, and where lists at its top level end."""
    named = re.compile(rb'(\\*)"(' + b"|".join(re.escape(k.encode()) for k in keys) + rb')"[ \t\r\n]*:[ \t\r\n]*$')
    with opened(path) as f:
        state, at = State(inside, _escaped_at(f, start), depth), start
        spots = []
        for held in chunks(f, start, end, READ_BYTES):
            data = np.frombuffer(held, np.uint8)
            _, deep, step = structure(data, state)
            spots += [(at + int(k), "begin") for k in np.flatnonzero((step == 1) & (deep == 2) & (data == 91))]
            spots += [(at + int(k), "end") for k in np.flatnonzero((step == -1) & (deep == 1) & (data == 93))]
            at += len(held)
        for spot, what in spots:
            if what == "end":
                yield {"path": path, "key": None, "at": spot}
                continue
            low = max(0, spot - KEY_BYTES)
            f.seek(low)
            if (found := named.search(f.read(spot - low))) and len(found[1]) % 2 == 0:
                yield {"path": path, "key": found[2].decode(), "at": spot}


def _elements(path: str, start: int, end: int, inside: bool, depth: int, level: int, begin: int, close: int | None):
    """(place, text) of the list's elements that begin in this part. The list's commas are at depth `level`, begin is its bracket."""
    with opened(path) as f:
        size = f.size()
        state, at = State(inside, _escaped_at(f, start), depth), start
        pending, held_from, buffer = None, start, b""
        for held in chunks(f, start, size, READ_BYTES):
            data = np.frombuffer(held, np.uint8)
            out, deep, step = structure(data, state)
            cut = (out & (data == 44) & (deep == level)) | ((step == -1) & (deep == level - 1)) | ((step == 1) & (deep == level))
            buffer += held
            for k in np.flatnonzero(cut).tolist():
                spot = at + k
                if spot < begin or (close is not None and spot > close) or (data[k] in (91, 123) and spot != begin):
                    continue
                if pending is not None:
                    text = buffer[pending + 1 - held_from : spot - held_from].strip(b" \t\r\n")
                    if text:
                        yield pending, text.decode()
                    elif data[k] == 44 or pending != begin:
                        raise ValueError(f"{path} has an empty element before byte {spot}")
                pending = spot if data[k] not in (93, 125) and spot < end else None
                if spot >= end or data[k] in (93, 125):
                    return
            at += len(held)
            if pending is None and at >= end:
                return
            keep = pending if pending is not None else at
            buffer, held_from = buffer[keep - held_from :], keep


def _mapped(rows: DataFrame, each, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                held: list[dict] = []
                n = 0
                for found in each(row):
                    held.append(found)
                    n += len(found.get("value") or "")
                    if len(held) >= 10_000 or n > READ_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, n = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    kinds = {"string": pa.string(), "long": pa.int64()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return rows.mapInArrow(run, schema)


def parts(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, start, end) of all files at path, each part dealt to a task of its own."""
    files = listed(spark, path).where("length > 0")
    each = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(part_bytes).cast("long"))).alias("start"))
    each = each.select("path", "start", F.least(F.col("start") + part_bytes, F.col("length")).alias("end"))
    return each.repartition(max(1, min(each.count(), 20_000)))  # beyond that a task takes several parts


def placed(found: DataFrame) -> DataFrame:
    """Parts with the state at their start. A file that ends within a text, a list or an object is an error."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    out = found.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2).withColumn("d", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")))
    out = out.withColumn("depth", F.coalesce(F.sum("d").over(before), F.lit(0))).withColumn("kind", F.max("first").over(whole))
    ends = (F.sum("d").over(whole) == 0) & (F.sum("flips").over(whole) % 2 == 0)
    broken = F.raise_error(F.concat(F.col("path"), F.lit(" is not one whole JSON value")))
    return out.withColumn("kind", F.when(ends, F.col("kind")).otherwise(broken.cast("string"))).select("path", "start", "end", "inside", "depth", "kind")


def elements(spark: SparkSession, path: str, keys: tuple[str, ...], alone: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, at, value): the JSON text of each element of the lists at path, at the byte where it (or the comma before it) lies.

    A file holds a list, or an object with a list under one of the keys: the first key that has one counts, and of equal keys the
    last. An object without any is one row (with alone=False an error); a number, text, truth value, null or blank file is an error.
    Keys are compared as they are written, without escapes. Texts of elements are not checked here but for their brackets.
    """
    summed = _mapped(parts(spark, path, part_bytes), lambda r: [_summary(r["path"], r["start"], r["end"])], "path string, start long, end long, first string, flips long, d0 long, d1 long")
    ready = placed(summed)
    neither = F.raise_error(F.concat(F.col("path"), F.lit(" holds neither a list nor an object"))).cast("string")
    ready = ready.withColumn("kind", F.when(F.col("kind").isin("[", "{"), F.col("kind")).otherwise(neither))
    spots = _mapped(ready.where("kind = '{'"), lambda r: _lists(r["path"], r["start"], r["end"], bool(r["inside"]), r["depth"], keys), "path string, key string, at long")
    order = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))])
    first = spots.where("key is not null").groupBy("path").agg(F.min_by("at", F.struct(order[F.col("key")], -F.col("at"))).alias("begin"))
    ends = spots.where("key is null").join(first, "path").where("at > begin").groupBy("path").agg(F.min("at").alias("close"))
    objects = ready.where("kind = '{'").join(first, "path", "left").join(ends, "path", "left")
    level: Column = F.when(F.col("kind") == "[", 1).otherwise(2)
    some = ready.where("kind = '['").withColumn("begin", F.lit(0).cast("long")).withColumn("close", F.lit(None).cast("long")).unionByName(objects.where("begin is not null and end > begin and start <= close"))

    def found(r):
        begin = r["begin"] if r["level"] == 2 else _bracket(r["path"])
        return ({"path": r["path"], "at": at, "value": text} for at, text in _elements(r["path"], r["start"], r["end"], bool(r["inside"]), r["depth"], r["level"], begin, r["close"]))

    schema = "path string, at long, value string"
    out = _mapped(some.withColumn("level", level.cast("long")), found, schema)
    lone = objects.where("begin is null and start = 0").select("path")
    if not alone:
        lone = lone.select(F.when(F.raise_error(F.concat(F.lit("no known list in the object of "), F.col("path"))).isNull(), F.col("path")).alias("path"))
    return out.unionByName(_mapped(lone, lambda r: [{"path": r["path"], "at": 0, "value": _whole(r["path"])}], schema))


def _bracket(path: str) -> int:
    """Where the list of a file that holds one begins."""
    with opened(path) as f:
        at = 0
        for held in chunks(f, size=READ_BYTES):
            if (k := held.find(b"[")) >= 0:
                return at + k
            at += len(held)
    raise ValueError(f"{path} has no list")


def _whole(path: str) -> str:
    with opened(path) as f:
        return f.read().removeprefix(_BOM).decode()
