"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision in the context of the last 0 to DEPTH bytes is a node with a
Krichevsky-Trofimov estimate from its zeros and ones in the training texts. Each node weighs its own estimate, one half,
against the product of its children's weighted probabilities; a bit's probability mixes all depths by the weights that
training leaves. Every node is kept. The distinct grams (context and byte) of the training texts are a table in the shared
folder, dealt by the last NEAR bytes of context, so that a part holds whole subtrees below depth NEAR and the sums of their
weights; a text's grams are sent to their parts, which answer with probabilities. Only the nodes above depth NEAR, whose
number the alphabet bounds, are sent to every worker.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorepool.llm.common import _LOWER, Words, doc_text, materialise, mix64, slices, utf8
from scorepool.llm.exchange import Answers, Format, cells, grouped, packets, planes, unplaned

#: Bytes of context.
DEPTH = 5
#: Bytes of context, the nearest ones, that decide where a gram is kept.
NEAR = 3
#: No UTF-8 text holds this byte; it ends a text and stands for what precedes one.
END = 0xFF
#: The end of a text among word keys.
END_KEY = 0x5851F42D4C957F2D
#: Grams that a task adds up before it sends them on.
HELD_GRAMS = 4_000_000
#: Groups in which the sums of the parts are added up.
SUMS = 64


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each lower-cased text and its end: the DEPTH bytes before it and itself, the byte lowest; and text bounds."""
    n = len(offsets) - 1
    ends = offsets[1:] + np.arange(n)
    x = np.empty(len(data) + n, np.uint8)
    inside = np.ones(len(x), bool)
    inside[ends] = False
    x[inside] = _LOWER[data]
    x[ends] = END
    bounds = offsets + np.arange(n + 1)
    out = x.astype(np.uint64)
    for k in range(1, DEPTH + 1):
        before = np.full(len(x), END, np.uint8)
        before[k:] = x[:-k] if k < len(x) else before[k:]
        for j in range(k):  # the first bytes of a text have no bytes of the text before in their context
            at = bounds[:-1] + j
            before[at[at < bounds[1:]]] = END
        out |= before.astype(np.uint64) << np.uint64(8 * k)
    return out, bounds


def keyed(gram: np.ndarray) -> np.ndarray:
    """Grams with the nearest byte of context highest and the byte itself lowest, so that sorted ones lie by context."""
    return ((gram.byteswap() << np.uint64(8)) >> np.uint64(16)) | (gram & np.uint64(255))


def home(key: np.ndarray) -> np.ndarray:
    """What decides a key's part: a hash of its NEAR bytes of context."""
    return mix64(key >> np.uint64(8 * (DEPTH + 1 - NEAR)))


def _sum_nodes(where: np.ndarray, key: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """One row for each key, sorted."""
    order = np.argsort(key)
    s = key[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return [where[order][first], s[first], np.add.reduceat(count[order], first) if len(s) else count[:0]]


def tally(gram: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Distinct grams as rows of the tree's lowest table: home, key, count."""
    key = keyed(gram)
    return _sum_nodes(home(key), key, count)


def strongest(where: np.ndarray, key: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """The rows that stay: all, as no two nodes share a place."""
    return [where, key, count]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8; x > 0."""
    shift = np.zeros(len(x))
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


_SMALL = 1 << 14
_HALVES, _WHOLES = _log_gamma(np.arange(_SMALL) + 0.5), _log_gamma(np.arange(_SMALL) + 1.0)


def _estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate; 0 of no counts."""

    def look(n, table, more):
        out = table[np.minimum(n, _SMALL - 1)]
        big = n >= _SMALL
        if big.any():
            out[big] = _log_gamma(n[big].astype(np.float64) + more)
        return out

    out = look(n0, _HALVES, 0.5) + look(n1, _HALVES, 0.5) - look(n0 + n1, _WHOLES, 1.0) - math.log(math.pi)
    out[n0 + n1 == 0] = 0.0
    return out


def _weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes with the sum of their children's weighted logs: own probability of a 1, weight of that estimate, weighted log."""
    e = _estimate(n0, n1)
    weighted = np.logaddexp(e, below) - math.log(2)
    return (n1 + 0.5) / (n0 + n1 + 1.0), np.exp(np.minimum(0, e - math.log(2) - weighted)), weighted


@dataclass
class Top:
    """The nodes above depth NEAR, mixed: at a node of depth NEAR - 1 (sorted keys) a 1 has probability base + share * p, with p
    that of the nodes below, or alone where there are none; and less has it by one byte of context where there is no such node."""

    keys: np.ndarray
    base: np.ndarray
    share: np.ndarray
    alone: np.ndarray
    less: np.ndarray

    def mix(self, node: np.ndarray, p: np.ndarray, below: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Probability of a 1 at rows whose node here is node[of]; p where below."""
        less = self.less[((node >> 16) << 8) | (node & 255)]
        if not len(self.keys):
            return less[of]
        at = np.minimum(np.searchsorted(self.keys, node), len(self.keys) - 1)
        there = self.keys[at] == node
        base, share, alone = self.base[at], self.share[at], np.where(there, self.alone[at], less)
        return np.where(below, base[of] + share[of] * p, alone[of])


def top(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> Top:
    """From the nodes of depth NEAR - 1, sorted, with counts and the sums of their children's weighted logs."""
    one, stop, weighted = _weigh(n0, n1, below)
    levels, size = [], int(node.max()) + 1 if len(node) else 1
    for _ in range(NEAR - 1):  # a context's nearest byte is highest: a parent loses the byte beside the prefix
        up = ((node >> 16) << 8) | (node & 255) if not levels else np.arange(size) & 255
        size = int(up.max()) + 1 if len(up) else 1
        n0, n1, below = (np.bincount(up, x, size) for x in (n0, n1, weighted))
        n0, n1 = n0.astype(np.int64), n1.astype(np.int64)
        own, weight, weighted = _weigh(n0, n1, below)
        weighted[n0 + n1 == 0] = 0.0
        levels.append((n0, n1, own, weight))
    (a0, a1, own1, stop1), (b0, b1, own0, stop0) = levels
    mine, root = ((node >> 16) << 8) | (node & 255), node & 255
    less = np.full(1 << 16, 0.5)
    every = np.arange(1 << 16)
    low = np.minimum(every & 255, len(own0) - 1)
    seen = ((every & 255) < len(own0)) & ((b0 + b1)[low] > 0)
    less[seen] = own0[low[seen]]
    held = np.flatnonzero(a0 + a1)
    less[held] = stop0[held & 255] * own0[held & 255] + (1 - stop0[held & 255]) * own1[held]
    s0, s1 = stop0[root], stop1[mine]
    base = s0 * own0[root] + (1 - s0) * s1 * own1[mine]
    share = (1 - s0) * (1 - s1)
    return Top(node, base + share * stop * one, share * (1 - stop), base + share * one, less)


def part_sums(key: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Of a part's grams, for each node of depth NEAR - 1 (context, prefix after a 1): zeros, ones, sum of its children's weighted logs."""
    out = []
    for k, levels in _levels(key, count):
        _, _, n0, n1, _, _, weighted, node = levels[-1]
        out.append((node, n0, n1, weighted))
    return add_sums(*(np.concatenate(x) for x in zip(*out, strict=True)))


def add_sums(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> list[np.ndarray]:
    """One row for each node, sorted; equal ones are added in order of weight, so in any order of arrival alike."""
    order = np.lexsort((below, node))
    s = node[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return [s[first], *(np.add.reduceat(x[order], first) if len(s) else x[:0] for x in (n0, n1, below))]


def _levels(key: np.ndarray, count: np.ndarray):
    """For each of a byte's eight bits the nodes of depths DEPTH to NEAR: (row to node, node to parent, zeros, ones, probability
    of a 1, weight of the own estimate, weighted log, node above NEAR). Rows without counts have nodes with none, whose log is 0."""
    tables = [(key, count, None)]
    for _ in range(DEPTH - NEAR):
        k, c, _ = tables[-1]
        up, back = np.unique(((k >> np.uint64(16)) << np.uint64(8)) | (k & np.uint64(255)), return_inverse=True)
        tables.append((up, np.bincount(back, c, len(up)).astype(np.int64), back))
    for k in range(8):
        out = []
        for i, (keys, counts, back) in enumerate(tables):
            node = keys >> np.uint64(8 - k)
            new = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.zeros(0, bool)
            first, of = np.flatnonzero(new), np.cumsum(new) - 1
            bit = ((keys >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
            add = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]  # noqa: B023, E731
            n1 = add(counts * bit)
            n0 = add(counts) - n1
            if i:
                out[-1][1] = parent = of[back[out[-1][8]]]
                one, stop, weighted = _weigh(n0, n1, np.bincount(parent, out[-1][6], len(first)))
            else:
                one, stop, weighted = (n1 + 0.5) / (n0 + n1 + 1.0), np.ones(len(first)), _estimate(n0, n1)
            above = None
            if i == len(tables) - 1:
                at = keys[first].astype(np.int64)
                above = ((at >> 16) << 8) | (1 << k) | ((at & 255) >> (8 - k))
            out.append([of, None, n0, n1, one, stop, weighted, above, first])
        yield k, [tuple(x[:8]) for x in out]


def log10(key: np.ndarray, count: np.ndarray, above: Top) -> np.ndarray:
    """log10 probability of each gram's byte in its context, from a part's sorted grams with their training counts, 0 for other texts' grams."""
    out = np.zeros(len(key))
    for k, levels in _levels(key, count):
        at, p, below = np.arange(len(levels[0][2])), np.full(len(levels[0][2]), 0.5), np.zeros(len(levels[0][2]), bool)
        for _, parent, n0, n1, one, stop, _, node in levels:
            here, own, a = (n0 + n1 > 0)[at], one[at], stop[at]
            p = np.where(here, np.where(below, a * own + (1 - a) * p, own), p)
            below |= here
            if parent is not None:
                at = parent[at]
        p = above.mix(node, p, below, at)[levels[0][0]]
        bit = ((key >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        out += np.log10(np.where(bit, p, 1 - p))
    return out


def _pieces(offsets: np.ndarray, step: int = 1 << 20):
    """Bounds of runs of whole texts."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, side="right")) - 1)
        yield at, to
        at = to


def _distinct(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Keys of the texts' grams, sorted."""
    some = [_once(keyed(grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0])) for a, b in _pieces(offsets)]
    return _once(np.concatenate(some)) if some else np.zeros(0, np.uint64)


def _once(x: np.ndarray) -> np.ndarray:
    """Distinct values, sorted; faster on many equal ones than unique()."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _added(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Each text's sum of logs, given those of its sorted distinct keys."""
    out = np.zeros(len(offsets) - 1)
    for a, b in _pieces(offsets):
        gram, bounds = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        key = keyed(gram)
        order = np.argsort(key)
        s = key[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        each = np.empty(len(key))
        each[order] = np.repeat(logs[np.searchsorted(keys, s[first])], np.diff(np.append(first, len(s))))
        out[a:b] = np.add.reduceat(each, bounds[:-1])
    return out


def _joined(key: np.ndarray, trained: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Asked and trained keys together, sorted, with training counts."""
    _, keys, counts = _sum_nodes(np.zeros(len(key) + len(trained), np.uint64), np.concatenate([key, trained]), np.concatenate([np.zeros(len(key), np.int64), count]))
    return keys, counts


@dataclass
class Tree:
    """A tree in one piece."""

    key: np.ndarray
    count: np.ndarray
    above: Top

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        keys = _distinct(data, offsets)
        every, counts = _joined(keys, self.key, self.count)
        return _added(data, offsets, keys, log10(every, counts, self.above)[np.searchsorted(every, keys)])


def build(key: np.ndarray, count: np.ndarray, check: np.ndarray | None = None) -> Tree:
    """The tree of a table of grams that is held whole."""
    return Tree(key, count, top(*part_sums(key, count)))


@dataclass
class Model:
    """A table with a row of grams for each part, the number of parts, and what all parts share."""

    table: DataFrame
    parts: int
    above: Top


#: A sum of a part: node, zeros, ones, weighted logs of the children.
_SUM = (("node", "<u4"), ("zeros", "<i8"), ("ones", "<i8"), ("below", "<f8"))


def train(docs: DataFrame) -> Model:
    """Counts every byte of every text of docs in its context. Tasks add up their grams, parts add those and keep them in the
    shared folder; parts grow in number with the texts. The driver gets the nodes of depth NEAR - 1."""
    parts = cells(docs)

    def count(batches):
        held, size = [], 0

        def added():
            return _sum_nodes(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def out(where, key, number):
            part = (where % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(planes(x[order], kind, cut, full), pa.binary()) for x, kind in ((key, "<u8"), (number, "<i8")))], names=["part", "gram", "number"])

        for batch in batches:
            for piece in slices(batch):
                new = np.sort(grams(*utf8(piece.column("text")))[0])
                first = np.concatenate([[0], np.flatnonzero(new[1:] != new[:-1]) + 1])
                held.append(tally(new[first], np.diff(np.append(first, len(new)))))
                size += len(first)
                if size > HELD_GRAMS:  # keeps a task's memory bounded
                    held = [added()]
                    size = len(held[0][1])
                    if size > HELD_GRAMS // 2:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*added())

    def read(table, *names):
        return [unplaned([x.as_buffer() for x in table.column(name).combine_chunks()], kind) for name, kind in names]

    def merge(key, table):
        gram, number = read(table, ("gram", "<u8"), ("number", "<i8"))
        _, gram, number = _sum_nodes(np.zeros(len(gram), np.uint64), gram, number)
        sums = part_sums(gram, number)
        group = (sums[0] >> 8) % SUMS
        order = np.argsort(group, kind="stable")
        cut = np.searchsorted(group[order], np.arange(SUMS + 1))
        full = np.flatnonzero(cut[1:] > cut[:-1])
        whole, one = np.array([0, len(gram)]), np.zeros(1, np.int64)
        rows = len(full)
        return pa.table(
            {"bucket": pa.array([key[0].as_py()] + [None] * rows, pa.int32()), "sub": pa.array([None, *full.tolist()], pa.int32())}
            | {name: pa.array(planes(x, kind, whole, one) + [None] * rows, pa.binary()) for name, x, kind in (("gram", gram, "<u8"), ("number", number, "<i8"))}
            | {name: pa.array([None, *planes(x[order], kind, cut, full)], pa.binary()) for (name, kind), x in zip(_SUM, sums, strict=True)}
        )

    def total(key, table):
        node, *rest = read(table, *_SUM)
        got = add_sums(node, *rest)
        return pa.table({name: [x.astype(kind).tobytes()] for (name, kind), x in zip(_SUM, got, strict=True)})

    sums = ", ".join(f"{name} binary" for name, _ in _SUM)
    counted = doc_text(docs).select("text").mapInArrow(count, "part int, gram binary, number binary")
    table = materialise(counted.groupBy("part").applyInArrow(merge, f"bucket int, sub int, gram binary, number binary, {sums}"), "grams")
    rows = list(table.where("sub is not null").select("sub", *(name for name, _ in _SUM)).groupBy("sub").applyInArrow(total, sums).toLocalIterator())
    node, n0, n1, below = (np.concatenate([np.frombuffer(r[k], kind) for r in rows] or [np.zeros(0, kind)]) for k, (_, kind) in enumerate(_SUM))
    order = np.argsort(node)
    return Model(table.where("bucket is not null").select("bucket", "gram", "number"), parts, top(node[order].astype(np.int64), n0[order], n1[order], below[order]))


def score(docs: DataFrame, tree: Model, learns) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `learns` is a condition on doc_id: rows that meet it are training rows. Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z
    lower-cased and one end. The base score is the sum over tokens of log10((c + 1) / (N + V + 1)); the score is the tree's
    log10 probability of the lower-cased UTF-8 text and its end. A null text counts as empty: one token, the end. Null ids,
    repeated rows (each counts), an empty table and clashing extra columns are allowed; row count is kept.
    """
    n = cells(docs)
    dealt = packets(docs, n).withColumn("learns", learns)
    held, parts = docs.sparkSession.sparkContext.broadcast(tree.above), tree.parts
    form, answers = Format(n, 8, count="<i8"), Answers(count="<i8")
    end = np.uint64(END_KEY)

    def ordered_all(table):
        return table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])

    def asks(table):
        """The texts' keys, sorted, and their order by part."""
        data, offsets = utf8(table.column("text").combine_chunks())
        keys = _distinct(data, offsets)
        part = (home(keys) % np.uint64(parts)).astype(np.int64)
        return data, offsets, keys, part, np.argsort(part, kind="stable")

    def look(table):
        w = Words(table.column("text").combine_chunks(), lower=True)
        order, first = grouped(np.append(w.hash, end))
        return w, order, first, np.append(w.hash, end)[order[first]]

    def send(key, table):
        table = ordered_all(table)
        w, order, first, keys = look(table)
        learn = table.column("learns").to_numpy(zero_copy_only=False).astype(np.int64)
        weight = np.append(np.repeat(learn, np.diff(w.ptr)), learn.sum())
        said = form.write(key[0].as_py(), keys, count=np.add.reduceat(weight[order], first))
        _, _, keys, part, order = asks(table)
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        full = np.flatnonzero(cut[1:] > cut[:-1])  # grams go to buckets of their own, beyond those of words
        return pa.concat_tables([said, pa.Table.from_arrays([pa.array(np.full(len(full), key[0].as_py(), np.int32)), pa.array((n + full).astype(np.int32)), pa.array(planes(keys[order], "<u8", cut, full), pa.binary()), pa.array([b""] * len(full), pa.binary())], schema=form.arrow)])

    def answer_grams(bucket, table, trained):
        table = table.combine_chunks().sort_by("packet")
        asked = [x.as_buffer() for x in table.column("keys")]
        bounds = np.concatenate([[0], np.cumsum([len(x) // 8 for x in asked])]).astype(np.int64)
        asked = unplaned(asked, "<u8")
        gram, number = (unplaned([x.as_buffer() for x in trained.column(name)], kind) for name, kind in (("gram", "<u8"), ("number", "<i8")))
        keys, counts = _joined(np.unique(asked), gram, number)
        got = log10(keys, counts, held.value)[np.searchsorted(keys, asked)]
        return pa.Table.from_arrays([table.column("packet").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(planes(got, "<f4", bounds, np.arange(len(bounds) - 1)), pa.binary())], schema=answers.arrow)

    def answer(key, table, trained):
        if not len(table):
            return answers.arrow.empty_table()
        bucket = key[0].as_py()
        if bucket >= n:
            return answer_grams(bucket, table, trained)
        who, bounds, keys, values = form.read(table)
        order, first = grouped(keys)
        many = np.diff(np.append(first, len(keys)))
        total = np.add.reduceat(values["count"][order], first)
        out = np.zeros(len(keys), np.int64)
        out[order] = np.repeat(total, many)
        got = answers.write(bucket, who, bounds, count=out)
        # this bucket's share of N and V goes along with its first packet's answers
        tail = pa.Table.from_arrays([pa.array([who[0]], pa.int32()), pa.array([-1 - bucket], pa.int32()), pa.array([np.array([total.sum(), (total > 0).sum()], "<i8").tobytes()], pa.binary())], schema=answers.arrow)
        return pa.concat_tables([got, tail])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, all_tokens long, all_words long"

    def finish(key, left, right):
        table = ordered_all(left)
        right = right.combine_chunks()
        shares = right.filter(pa.compute.less(right.column("bucket"), 0))
        told = right.filter(pa.compute.greater_equal(right.column("bucket"), n)).combine_chunks().sort_by("bucket")
        right = right.filter(pa.compute.and_(pa.compute.greater_equal(right.column("bucket"), 0), pa.compute.less(right.column("bucket"), n)))
        w, order, first, keys = look(table)
        count = np.zeros(len(order), np.int64)
        count[order] = np.repeat(answers.read(right)["count"], np.diff(np.append(first, len(order))))
        ends, count = count[-1], count[:-1]
        logs = np.concatenate([[0.0], np.cumsum(np.log10(count + 1.0))])
        known = np.concatenate([[0], np.cumsum(count > 0)])
        a, b = w.ptr[:-1], w.ptr[1:]
        rows = len(table)
        parts = np.array([np.frombuffer(x.as_buffer(), "<i8") for x in shares.column("count")], np.int64).reshape(-1, 2)
        data, offsets, grams_, _, by_part = asks(table)
        logged = np.zeros(len(grams_))
        logged[by_part] = unplaned([x.as_buffer() for x in told.column("count")], "<f4")
        scores = _added(data, offsets, grams_, logged)
        per_doc = [np.add.reduceat(np.append(np.log10(count + 1.0), 0.0), a) * (b > a)] if len(a) else [logs[:0]]
        out = pa.table({
            "doc_id": table.column("doc_id"), "held_out": pa.array(~table.column("learns").to_numpy(zero_copy_only=False)), "n_tokens": pa.array((b - a + 1).astype(np.int64)),
            "n_known": pa.array((known[b] - known[a] + int(ends > 0)).astype(np.int64)), "logs": pa.array(per_doc[0] + math.log10(ends + 1.0)), "score": pa.array(scores),
            "all_tokens": pa.nulls(rows, pa.int64()), "all_words": pa.nulls(rows, pa.int64()),
        })
        if len(parts):
            share = pa.table({c: pa.nulls(1, out.schema.field(c).type) for c in out.column_names[:-2]} | {"all_tokens": [int(parts[:, 0].sum())], "all_words": [int(parts[:, 1].sum())]})
            out = pa.concat_tables([out, share.cast(out.schema)])
        return out

    asked = dealt.groupBy("packet").applyInArrow(send, form.schema)
    trained = tree.table.withColumn("bucket", F.col("bucket") + n)
    asked = asked.groupBy("bucket").cogroup(trained.groupBy("bucket")).applyInArrow(answer, answers.schema)
    both = dealt.groupBy("packet").cogroup(asked.groupBy("packet")).applyInArrow(finish, schema)
    rows = materialise(both, "scores")
    total = rows.where("all_tokens is not null").agg(F.sum("all_tokens").alias("n"), F.sum("all_words").alias("v")).first()
    tokens, words = total["n"] or 0, total["v"] or 0
    return rows.where("all_tokens is null").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * math.log10(tokens + words + 1)).alias("base_score"), "score",
    )
