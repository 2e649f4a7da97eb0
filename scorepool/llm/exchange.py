"""A packed exchange: questions about 64-bit keys over the whole corpus, without a row for each key.

Documents are dealt into packets by a hash of their id and text. A packet sends each of its distinct keys once, sorted and packed by
key range (bucket), however often it holds it, so a hot key costs at most one entry for each packet. The task of a bucket sees
every packet's entries of its keys and answers in the same order; a packet finds its answers by recomputing its keys. Texts
are shuffled once: all steps group by packet, and Spark reuses that exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorepool.llm.common import doc_text

#: Text of one packet, and keys of one bucket, in bytes of text, at least; both numbers follow the input. A packet sends a row to
#: each bucket it has keys for, so with a fixed size those would hold ever fewer keys. Beyond about 22 GB the size therefore
#: grows with the square root of the input, by this factor, which keeps about 128 keys in a row: 28 MB at 1 TB, 280 MB at 100 TB.
CELL_BYTES = 4 << 20
ROW_FACTOR = 768
LEAST_CELLS = 64


def cells(docs: DataFrame) -> int:
    """How many packets, and how many buckets."""
    return cells_of(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)


def cells_of(total: int) -> int:
    return max(LEAST_CELLS, -(-total // max(CELL_BYTES, math.isqrt(ROW_FACTOR * total))))


def packets(docs: DataFrame, n: int) -> DataFrame:
    """Rows by a hash of id and text: neither null ids nor an id that repeats gather in one packet."""
    return doc_text(docs).select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("packet"), "doc_id", "text")


def ordered(table: pa.Table) -> pa.Table:
    """A packet's rows by id, then text: shuffles deliver them in any order."""
    return table.select(["doc_id", "text"]).combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def ids_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids with null as the least integer, and which are not null."""
    column = table.column("doc_id")
    return column.fill_null(-(1 << 63)).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


def planes(x: np.ndarray, kind: str, cuts: np.ndarray, which: np.ndarray) -> list[bytes]:
    """For each stretch of x its first bytes, then its second ones and so on: high bytes of small numbers compress to nothing."""
    size = np.dtype(kind).itemsize
    raw = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(-1, size)
    return [raw[cuts[k] : cuts[k + 1]].T.tobytes() for k in which.tolist()]


def unplaned(parts: list, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    arrays = [np.frombuffer(p, np.uint8).reshape(size, -1).T for p in parts]
    return np.ascontiguousarray(np.concatenate(arrays)).view(kind).ravel() if arrays else np.zeros(0, kind)


class Format:
    """Rows (packet, bucket, keys, one binary for each value); keys lose their top bytes beyond `width`, which the bucket mostly
    implies: buckets grow in number with the input, so the share of keys that then look alike does not."""

    def __init__(self, n: int, width: int, **values: str):
        self.n, self.width, self.values = n, width, values
        self.schema = "packet int, bucket int, keys binary" + "".join(f", {v} binary" for v in values)
        self.arrow = pa.schema([("packet", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), *((v, pa.binary()) for v in values)])

    def bounds(self, keys: np.ndarray) -> np.ndarray:
        """Where each bucket begins in sorted keys, and the end."""
        bucket = ((keys >> np.uint64(40)) * np.uint64(self.n)) >> np.uint64(24)
        return np.searchsorted(bucket, np.arange(self.n + 1, dtype=np.uint64))

    def write(self, packet: int, keys: np.ndarray, **values: np.ndarray) -> pa.Table:
        at = self.bounds(keys)
        full = np.flatnonzero(at[1:] > at[:-1])
        raw = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]).tobytes()
        columns = [pa.array(np.full(len(full), packet, np.int32)), pa.array(full.astype(np.int32)), pa.array([raw[at[b] * self.width : at[b + 1] * self.width] for b in full], pa.binary())]
        for name, kind in self.values.items():
            columns.append(pa.array(planes(values[name], kind, at, full), pa.binary()))
        return pa.Table.from_arrays(columns, schema=self.arrow)

    def read(self, table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Of a bucket: packets, ascending; each one's bounds in the entries; keys; values."""
        table = table.combine_chunks().sort_by("packet")
        joined = {c: [x.as_buffer() for x in table.column(c)] for c in ("keys", *self.values)}
        sizes = [len(b) // self.width for b in joined["keys"]]
        raw = np.frombuffer(b"".join(joined["keys"]), np.uint8).reshape(-1, self.width)
        keys = np.zeros((len(raw), 8), np.uint8)
        keys[:, : self.width] = raw
        return table.column("packet").to_pylist(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), keys.view("<u8").ravel(), {v: unplaned(joined[v], kind) for v, kind in self.values.items()}


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the keys, and where each distinct key begins in it."""
    order = np.argsort(keys, kind="stable")
    if not len(keys):
        return order, np.zeros(0, np.int64)
    s = keys[order]
    return order, np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])


class Answers:
    """Rows (packet, bucket, one binary for each value): answers to a packet's keys in a bucket, in the order asked."""

    def __init__(self, **values: str):
        self.values = values
        self.schema = "packet int, bucket int" + "".join(f", {v} binary" for v in values)
        self.arrow = pa.schema([("packet", pa.int32()), ("bucket", pa.int32()), *((v, pa.binary()) for v in values)])

    def write(self, bucket: int, packets: list[int], bounds: np.ndarray, **values: np.ndarray) -> pa.Table:
        columns = [pa.array(packets, pa.int32()), pa.array([bucket] * len(packets), pa.int32())]
        for name, kind in self.values.items():
            columns.append(pa.array(planes(values[name], kind, bounds, np.arange(len(packets))), pa.binary()))
        return pa.Table.from_arrays(columns, schema=self.arrow)

    def read(self, table: pa.Table) -> dict[str, np.ndarray]:
        """Answers to all of a packet's sorted keys."""
        table = table.combine_chunks().sort_by("bucket")
        return {v: unplaned([x.as_buffer() for x in table.column(v)], kind) for v, kind in self.values.items()}


def ask(dealt: DataFrame, form: Format, send: Callable[[int, pa.Table], pa.Table], answer: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """send(packet, its rows) gives rows of form; answer(bucket, those of a bucket) gives rows of schema."""

    def sender(key, table):
        return send(key[0].as_py(), ordered(table))

    def answerer(key, table):
        return answer(key[0].as_py(), table)

    return dealt.groupBy("packet").applyInArrow(sender, form.schema).groupBy("bucket").applyInArrow(answerer, schema)


def meet(dealt: DataFrame, answers: DataFrame, finish: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """finish(packet, its rows, its answers) gives rows of schema."""

    def both(key, left, right):
        return finish(key[0].as_py(), ordered(left), right)

    return dealt.groupBy("packet").cogroup(answers.groupBy("packet")).applyInArrow(both, schema)
