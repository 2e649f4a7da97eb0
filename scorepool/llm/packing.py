"""Best-fit packing by the linear grouping scheme.

Only the histogram of piece lengths (at most `capacity` rows) reaches the driver. There, long lengths are rounded up within
groups of equal cardinality, a linear program over configurations of those few sizes is solved by column generation, the
actual lengths take the places of the rounded ones, and what is left goes best-fit into the gaps. The plan is a table of
length, rank range, sequence and offset, bounded by the number of lengths; each piece finds its place by its rank among the
pieces of its length, which is computed in two levels (within a task, then over tasks) so that no length is one task's work.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorepool.llm.common import crc, doc_text, materialise, slices
from scorepool.llm.tokenise import TEXT_BYTES, default_path, text_ids, with_end

CAPACITY = 2048
#: Lengths up to the capacity over one of these are small, to be placed best-fit after the rest; the split that needs fewest sequences is taken.
SMALL_SHARES = (2, 4)
#: Distinct rounded sizes of the configuration program.
GROUPS = 40

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _ranks(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Of each piece, how many of its length came before; seen counts on."""
    order = np.argsort(length, kind="stable")
    s = length[order]
    first = np.searchsorted(s, s)
    out = np.empty(len(length), np.int64)
    out[order] = np.arange(len(s)) - first + seen[s]
    seen += np.bincount(length, minlength=len(seen))
    return out


def pieces(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Token pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32, and the rank among a task's pieces of that length."""
    path = vocabulary_path or default_path("word_bpe_49k.json")

    def run(batches):
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, limit=TEXT_BYTES):
                flat, many = with_end(*text_ids(part.column("text"), path, split=True), end_id)
                pieces_of = -(-many // capacity)
                row = np.repeat(np.arange(len(many)), pieces_of)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
                start = piece * capacity
                length = np.minimum(capacity, many[row] - start)
                raw, at = memoryview(flat.tobytes()), 4 * np.concatenate([[0], np.cumsum(length)])
                crcs = [crc(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                rank = _ranks(length, seen)
                yield pa.RecordBatch.from_arrays(
                    [pc.take(part.column("doc_id"), pa.array(row, pa.int64())), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(np.full(len(row), here, np.int32)), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return doc_text(docs).mapInArrow(run, _PIECES)


# --- the plan, from the histogram alone ------------------------------------------------------------------------


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest worth: an unbounded knapsack over few sizes, by unit of capacity."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    low = int(sizes.min())
    for c in range(low, capacity + 1):
        fit = sizes <= c
        got = np.where(fit, value[c - np.where(fit, sizes, 0)] + worth, -1.0)
        k = int(got.argmax())
        value[c], last[c] = value[c - 1], -1
        if got[k] > value[c] + 1e-12:
            value[c], last[c] = got[k], k
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c >= low:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= int(sizes[last[c]])
    return out


def _configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, steps: int = 400) -> list[tuple[np.ndarray, int]]:
    """Column generation for min sum(x) with sum(x_p * pattern_p) = need; whole parts of the optimal x."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = need / np.diag(basis)
    for _ in range(steps):
        dual = np.linalg.solve(basis.T, np.ones(k))
        new = _best_pattern(sizes, np.maximum(dual, 0), capacity).astype(float)
        if dual @ new <= 1 + 1e-7:
            break
        move = np.linalg.solve(basis, new)
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = np.maximum(x - step * move, 0)
        basis[:, out] = new
        x[out] = step
    return [(basis[:, j].astype(np.int64), int(x[j] + 1e-6)) for j in range(k) if x[j] + 1e-6 >= 1]


def _take(runs: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The first n items of runs of [length, count], longest first; runs shrink."""
    got = []
    while n and runs:
        m = min(n, runs[0][1])
        got.append((runs[0][0], m))
        runs[0][1] -= m
        n -= m
        if not runs[0][1]:
            runs.pop(0)
    return got


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple[int, ...]]]:
    """Bins as (how many, the lengths in each); uses every item of the histogram once. The best of SMALL_SHARES, the first of equals."""
    return min((_plan(histogram, capacity, groups, share) for share in SMALL_SHARES), key=lambda bins: sum(many for many, _ in bins))


def _plan(histogram: dict[int, int], capacity: int, groups: int, share: int) -> list[tuple[int, tuple[int, ...]]]:
    left = {n: c for n, c in histogram.items() if c > 0}
    bins: list[tuple[int, tuple[int, ...]]] = []
    if left.get(capacity):
        bins.append((left.pop(capacity), (capacity,)))
    long = [[n, left[n]] for n in sorted(left, reverse=True) if n * share > capacity]
    total = sum(c for _, c in long)
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    if total:
        each = -(-total // groups)
        members: list[list[list[int]]] = []
        for n, c in long:  # groups of equal cardinality, longest first; each is rounded up to its longest length
            while c:
                if not members or sum(m for _, m in members[-1]) == each:
                    members.append([])
                m = min(c, each - sum(x for _, x in members[-1]))
                members[-1].append([n, m])
                c -= m
        by_size: dict[int, list[list[int]]] = {}
        for g in members:
            by_size.setdefault(g[0][0], []).extend(g)
        sizes = np.array(list(by_size), np.int64)
        stock = list(by_size.values())
        need = np.array([sum(m for _, m in g) for g in stock], float)
        for pattern, many in _configurations(sizes, need, capacity):
            slots = [k for k in range(len(sizes)) for _ in range(pattern[k])]
            many = min([many] + [sum(m for _, m in stock[k]) // int(pattern[k]) for k in set(slots)])
            rows = [_take(stock[k], many) for k in slots]
            while many > 0:  # cut into stretches in which each place has one actual length
                m = min(r[0][1] for r in rows)
                content = tuple(r[0][0] for r in rows)
                open_bins[capacity - sum(content)].append((m, content))
                many -= m
                rows = [([(r[0][0], r[0][1] - m)] if r[0][1] > m else []) + r[1:] for r in rows]
        rest: dict[int, int] = defaultdict(int)
        for g in stock:
            for n, c in g:
                rest[n] += c
        for n, _ in long:
            left[n] = rest.get(n, 0)
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        c = left[n]
        while c:
            gap = min((g for g in open_bins if g >= n and open_bins[g]), default=None)
            if gap is None:
                k = capacity // n
                if c >= k:
                    open_bins[capacity - k * n].append((c // k, (n,) * k))
                    c %= k
                else:
                    open_bins[capacity - c * n].append((1, (n,) * c))
                    c = 0
                continue
            many, content = open_bins[gap].pop()
            k = min(gap // n, max(1, c // many))
            m = min(many, c // k)
            if m < many:
                open_bins[gap].append((many - m, content))
            open_bins[gap - k * n].append((m, content + (n,) * k))
            c -= m * k
    return bins + [b for g in sorted(open_bins) for b in open_bins[g]]


def places(bins: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its stretches, the sequence of each stretch's first rank, and the offset."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for many, content in bins:
        at = 0
        for n in content:
            out[n].append((used[n], base, at))
            used[n] += many
            at += n
        base += many
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in out.items()}


def pack(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every piece with its sequence_id and its offset there.

    A null text counts as empty and gives one piece, the end id; repeated rows, null ids and clashing extra columns are
    allowed, each row being packed on its own; an empty table gives no rows.
    """
    held = materialise(pieces(docs, vocabulary_path, capacity, end_id), "pieces")
    counts = held.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(histogram, capacity))

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, base, where = table[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[k] + rank[at] - first[k]
                offset[at] = where[k]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # the hint keeps both inputs shuffled: the table of counts grows with the number of tasks
    joined = held.join(counts.select("part", "length", "base").hint("shuffle_merge"), ["part", "length"])
    return joined.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
