"""N-gram Jaccard join by prefix trees.

Sets of word shingles are put in one global order, rarest first (document frequency over packets' distinct sets, then hash).
Equal sets are one throughout the corpus, found by 128 bits of hashes. Two sets can only be similar if their prefixes share a shingle, and a shingle that occurs once joins nothing. Every repeated
shingle has an owner, the first packet that holds it; a set goes once to each owner of its prefix, whatever number of
shingles lead there. In an owner's group, sets that share a prefix shingle form a cluster, whose sets are stored in a trie
with merged chains; lookups walk it together with their overlaps so far, leave subtrees that remaining lengths rule out, and
skip those already in their own component. Groups far beyond the mean are split into blocks, compared pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorepool.llm.common import Words, materialise, mix64, windows
from scorepool.llm.components import components
from scorepool.llm.exchange import Answers, Format, ask, cells, grouped, ids_of, meet, packets

SHINGLE = 5
#: A group of more sets than this, and than GROUP_SHARE times the mean group, is split into blocks of that many and compared
#: as pairs of blocks, each a task's group by itself.
GROUP_SETS, GROUP_SHARE = 500, 2
#: Of a set: the second sum of its hashes and the least id that has it in a packet.
_PRINT = np.dtype([("check", "<u8"), ("rep", "<i8")])
#: Large groups whose list is broadcast (16 bytes each); a longer list is joined by shuffle.
LARGE_GROUPS = 100_000


class _Sets:
    """Distinct shingle hashes of each text of a packet, by text, then hash."""

    def __init__(self, table: pa.Table):
        w = Words(table.column("text").combine_chunks(), lower=True)
        texts = len(table)
        count = np.diff(w.ptr)
        text_of = np.repeat(np.arange(texts), count)
        g = windows(w.hash, SHINGLE)
        at = np.flatnonzero(text_of[: len(g)] == text_of[SHINGLE - 1 :]) if len(g) else np.zeros(0, np.int64)
        value, owner = [g[at]], [text_of[at]]
        for k in range(1, SHINGLE):  # shorter texts: the whole sequence as one
            short = np.flatnonzero(count == k)
            if len(short):
                value.append(windows(w.hash, k)[w.ptr[short]])
                owner.append(short)
        value, owner = np.concatenate(value), np.concatenate(owner)
        order = np.argsort(value, kind="stable")
        order = order[np.argsort(owner[order], kind="stable")]
        value, owner = value[order], owner[order]
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        self.value, self.owner = value[keep], owner[keep]
        self.ptr = np.searchsorted(self.owner, np.arange(texts + 1))
        self.size = np.diff(self.ptr)
        ids, valid = ids_of(table)
        # texts with the same set (the same two sums of hashes, 128 bits) are one from here on: the first of them, as rows are in order of id
        mixed = mix64(self.value + np.uint64(0x632BE59BD9B4E019))
        one, two = self._total(mixed), self._total(mixed * mixed)
        first: dict[tuple[int, int, int], int] = {}
        self.first = np.arange(texts)
        for i, *print_ in zip(np.flatnonzero(valid & (self.size > 0)).tolist(), *(x[valid & (self.size > 0)].tolist() for x in (self.size, one, two)), strict=True):
            self.first[i] = first.setdefault(tuple(print_), i)
        self.distinct = np.array(sorted(first.values()), np.int64)
        self.ids, self.valid = ids, valid
        prints = mix64(one[self.distinct] ^ mix64(self.size[self.distinct].astype(np.uint64)))
        order = np.argsort(prints, kind="stable")
        self.distinct = self.distinct[order]  # in order of their prints, as these are asked about
        self.prints, self.checks = prints[order], two[self.distinct]
        used = np.zeros(texts, bool)
        used[self.distinct] = True
        self.held = np.flatnonzero(used[self.owner])  # entries of distinct sets
        self.order, self.start = grouped(self.value[self.held])
        self.keys = self.value[self.held][self.order[self.start]]

    def _total(self, x: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        return sums[self.ptr[1:]] - sums[self.ptr[:-1]]

    def inverse(self) -> np.ndarray:
        step = np.zeros(len(self.held), np.int64)
        step[self.start[1:]] = 1
        out = np.zeros(len(self.held), np.int64)
        out[self.order] = np.cumsum(step)
        return out


def prefix_length(size: np.ndarray | int):
    """How many leading shingles must hold one of any partner's: size - ceil(0.8 size) + 1."""
    return size - (4 * size + 4) // 5 + 1


def similar(overlap: int, size: int, other: int) -> bool:
    """100 * intersection >= 80 * union."""
    return 9 * overlap >= 4 * (size + other)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class _Node:
    __slots__ = ("run", "below", "sets", "least", "most", "member", "mixed")

    def __init__(self, run):
        self.run, self.below, self.sets, self.least, self.most, self.member, self.mixed = run, {}, [], 1 << 60, 0, -1, False


#: Bytes of the table of which items the lookups of one walk hold, and lookups of one walk at most.
WALK_BYTES, WALK_SETS = 16 << 20, 512
#: In larger clusters, sets are first compared with this many central ones: what those connect need not be walked.
PIVOTS = 8


class Trie:
    """Sets as ascending arrays of small integers, in a trie with merged chains. walk() takes many lookups down it together:
    what a node's run adds to their overlaps is counted once for all, and each leaves where remaining lengths rule it out."""

    def __init__(self, union: _Union, sets: list[np.ndarray], universe: int):
        self.root, self.union, self.sets, self.universe = _Node(np.zeros(0, np.int64)), union, sets, universe

    def insert(self, who: int, own: int) -> None:
        node, at, items, find = self.root, 0, self.sets[own], self.union.find
        while True:
            node.least, node.most = min(node.least, len(items)), max(node.most, len(items))
            if node.member < 0:
                node.member = who
            elif not node.mixed and find(node.member) != find(who):
                node.mixed = True
            if at == len(items):
                node.sets.append(who)
                return
            child = node.below.get(int(items[at]))
            if child is None:
                child = node.below[int(items[at])] = _Node(items[at:])
                child.least = child.most = len(items)
                child.member = who
                child.sets.append(who)
                return
            n = min(len(child.run), len(items) - at)
            differ = np.flatnonzero(child.run[:n] != items[at : at + n])
            k = int(differ[0]) if len(differ) else n
            if k < len(child.run):  # split the chain
                upper = _Node(child.run[:k])
                upper.least, upper.most, upper.member, upper.mixed = child.least, child.most, child.member, child.mixed
                node.below[int(items[at])] = upper
                upper.below[int(child.run[k])] = child
                child.run = child.run[k:]
                child = upper
            node, at = child, at + k

    def walk(self, who: list[int], own: list[int]) -> None:
        """Links the sets `own`, known to the union as `who`, with every similar one that they aren't connected with yet."""
        find, names = self.union.find, np.array(who)
        size = np.array([len(self.sets[i]) for i in own], np.int64)
        span = self.universe + 1
        holds = np.zeros((span, len(own)), np.uint8)
        keys = np.concatenate([self.sets[i] + k * span for k, i in enumerate(own)])
        holds[keys % span, keys // span] = 1
        ptr = np.concatenate([[0], np.cumsum(size)])
        roots, stale = np.array([find(w) for w in who]), False
        stack = [(self.root, np.arange(len(own)), np.zeros(len(own), np.int64), 0)]
        while stack:
            node, live, overlap, depth = stack.pop()
            if not node.mixed:
                if stale:
                    roots, stale = np.array([find(w) for w in who]), False
                other = roots[live] != find(node.member)
                if not other.any():
                    continue
                live, overlap = live[other], overlap[other]
            if len(node.run):
                depth += len(node.run)
                held = holds[node.run].sum(0, dtype=np.int64)[live] if len(live) * 4 > len(own) else holds[np.ix_(node.run, live)].sum(0, dtype=np.int64)
                overlap = overlap + held
                need = 4 * (size[live] + max(node.least, depth))
                fits = 9 * (overlap + np.minimum(size[live] - overlap, node.most - depth)) >= need
                if not fits.any():
                    continue
                live, overlap, need = live[fits], overlap[fits], need[fits]
                passed = np.searchsorted(keys, live * span + node.run[-1], side="right") - ptr[live]
                fits = 9 * (overlap + np.minimum(size[live] - passed, node.most - depth)) >= need
                live, overlap = live[fits], overlap[fits]
                if not len(live):
                    continue
            if node.sets:  # those that end here are equal
                for q in live[9 * overlap >= 4 * (size[live] + depth)].tolist():
                    if find(int(names[q])) != find(node.sets[0]):
                        self.union.join(int(names[q]), node.sets[0])
                        stale = True
            stack.extend((child, live, overlap, depth) for child in node.below.values())


def _link_cluster(union: _Union, own: list[int], sets: list[np.ndarray]) -> None:
    flat = np.concatenate([sets[i] for i in own])
    value, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(value), np.int64)
    rank[np.lexsort((value, -count))] = np.arange(len(value))  # the most frequent first: chains are shared longest
    sizes = np.array([len(sets[i]) for i in own])
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    items = [np.sort(rank[back[a:b]]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    if len(own) > 8 * PIVOTS:
        central = np.add.reduceat(count[back], ptr[:-1]) / sizes
        for pivot in np.argsort(-central, kind="stable")[:PIVOTS].tolist():
            mark = np.zeros(len(value), np.int64)
            mark[items[pivot]] = 1
            overlap = np.add.reduceat(mark[rank[back]], ptr[:-1])
            for k in np.flatnonzero(9 * overlap >= 4 * (sizes + sizes[pivot])).tolist():
                union.join(own[k], own[pivot])
    trie = Trie(union, items, len(value))
    for k, i in enumerate(own):
        trie.insert(i, k)
    step = max(1, min(WALK_SETS, WALK_BYTES // (len(value) + 1)))
    for at in range(0, len(own), step):
        trie.walk(own[at : at + step], list(range(at, min(at + step, len(own)))))


def link(sets: list[np.ndarray]) -> list[int]:
    """For sets in global order: the least index of each one's component under similar()."""
    union = _Union(len(sets))
    size = np.array([len(s) for s in sets], np.int64)
    prefix = prefix_length(size)
    token = np.concatenate([s[:p] for s, p in zip(sets, prefix, strict=True)])
    who = np.repeat(np.arange(len(sets)), prefix)
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    cluster = _Union(len(sets))
    for i in np.flatnonzero(token[1:] == token[:-1]).tolist():
        cluster.join(int(who[i]), int(who[i + 1]))
    members: dict[int, list[int]] = {}
    for i in range(len(sets)):
        members.setdefault(cluster.find(i), []).append(i)
    for own in members.values():
        if len(own) > 1:
            _link_cluster(union, own, sets)
    return [union.find(i) for i in range(len(sets))]


def shingle_components(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id reachable by links).

    Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; distinct shingles of SHINGLE words, or the whole sequence of fewer words.
    Null and wordless texts have an empty set and link with nothing; a null id has a null component and links with nothing;
    rows that share an id are one node. Empty tables and clashing extra columns are allowed; row count is kept.
    """
    n = cells(docs)
    dealt = packets(docs, n)
    form, prints = Format(n, 5, df="u1"), Format(n, 8, df=_PRINT)
    verdict, least = Answers(df="<u2", owner="<i4"), Answers(df="<i8", owner="u1")

    def send(packet, table):
        s = _Sets(table)
        many = np.diff(np.append(s.start, len(s.held)))
        said = np.zeros(len(s.distinct), _PRINT)
        said["check"], said["rep"] = s.checks, s.ids[s.distinct]
        sets = prints.write(packet, s.prints, df=said)
        sets = sets.set_column(1, "bucket", pc.add(sets.column("bucket"), pa.scalar(n, pa.int32())))  # prints go to buckets of their own
        return pa.concat_tables([form.write(packet, s.keys, df=np.minimum(many, 255)), sets])

    def first_of_equals(bucket, table):
        who, bounds, keys, values = prints.read(table)
        check, rep = values["df"]["check"], values["df"]["rep"]
        order = np.lexsort((rep, check, keys))
        new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (check[order][1:] != check[order][:-1])])
        out = np.zeros(len(keys), np.int64)
        out[order] = rep[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        return least.write(bucket, who, bounds, df=out, owner=np.zeros(len(out), np.uint8))

    def judge(bucket, table):
        if bucket >= n:
            return first_of_equals(bucket, table)
        who, bounds, keys, values = form.read(table)
        packet = np.repeat(np.array(who, np.int32), np.diff(bounds))
        order, first = grouped(keys)
        many = np.diff(np.append(first, len(keys)))
        df = np.minimum(np.add.reduceat(values["df"][order].astype(np.int64), first), 65535)
        owner = np.where(df > 1, packet[order[first]], 0)  # entries are in order of packet
        out, own = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.int32)
        out[order], own[order] = np.repeat(df, many), np.repeat(owner, many)
        return verdict.write(bucket, who, bounds, df=out, owner=own)

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("rep", pa.int64()), ("owner", pa.int32()), ("items", pa.binary())])

    def route(packet, table, answers):
        s = _Sets(table)
        rep = [int(s.ids[s.first[i]]) if s.valid[i] else None for i in range(len(table))]
        plain = pa.Table.from_arrays([table.column("doc_id"), pa.array(s.size.astype(np.int64)), pa.array(rep, pa.int64()), pa.nulls(len(table), pa.int32()), pa.nulls(len(table), pa.binary())], schema=schema)
        if not len(s.keys):
            return plain
        of_prints = pc.greater_equal(answers.column("bucket"), n)
        first = least.read(answers.filter(of_prints))["df"]
        got, back = verdict.read(answers.filter(pc.invert(of_prints))), s.inverse()
        df, owner, text, value = got["df"][back].astype(np.int64), got["owner"][back], s.owner[s.held], s.value[s.held]
        order = np.argsort(text * 65536 + df, kind="stable")  # by text, frequency, hash
        df, owner, text, value = df[order], owner[order], text[order], value[order]
        begin = np.searchsorted(text, np.arange(len(table) + 1))
        place = np.arange(len(text)) - begin[text]
        inside = np.flatnonzero((place < prefix_length(s.size)[text]) & (df > 1))
        pairs = np.unique(text[inside] * (1 << 31) + owner[inside].astype(np.int64))
        who, where = pairs >> 31, (pairs & ((1 << 31) - 1)).astype(np.int32)
        # of equal sets in all packets only the first is routed; the others are linked to it here
        own = s.ids[s.distinct]
        copies = np.flatnonzero(first != own)
        plain = pa.concat_tables([plain, pa.Table.from_arrays([pa.nulls(len(copies), pa.int64()), pa.array(first[copies]), pa.array(own[copies]), pa.array(np.full(len(copies), -1, np.int32)), pa.nulls(len(copies), pa.binary())], schema=schema)])
        kept = ~np.isin(who, s.distinct[copies])
        who, where = who[kept], where[kept]
        items = [value[begin[i] : begin[i + 1]].astype("<u8").tobytes() for i in who.tolist()]
        sent = pa.Table.from_arrays([pa.nulls(len(who), pa.int64()), pa.nulls(len(who), pa.int64()), pa.array(s.ids[who]), pa.array(where), pa.array(items, pa.binary())], schema=schema)
        return pa.concat_tables([plain, sent])

    answers = ask(dealt, form, send, judge, verdict.schema)
    held = materialise(meet(dealt, answers, route, "doc_id long, n_shingles long, rep long, owner int, items binary"), "routes")
    copies = held.where("owner = -1").select(F.col("rep").alias("a"), F.col("n_shingles").alias("b"))
    sets = held.where("owner >= 0").select("owner", "rep", "items")
    size = sets.groupBy("owner").agg(F.count(F.lit(1)).alias("_n"))
    mean = size.agg(F.avg("_n")).first()[0] or 0.0
    limit = max(float(GROUP_SETS), GROUP_SHARE * mean, 1.0)
    large = size.where(F.col("_n") > limit).select("owner", F.ceil(F.col("_n") / limit).cast("int").alias("_s"))
    few = large.count() <= LARGE_GROUPS
    spread = sets.join(F.broadcast(large) if few else large, "owner", "left").withColumn("_s", F.coalesce("_s", F.lit(1)))
    spread = spread.withColumn("_b", F.pmod(F.xxhash64("rep"), F.col("_s")).cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    spread = spread.select("owner", F.least("_b", "_c").alias("lo"), F.greatest("_b", "_c").alias("hi"), "rep", "items")
    if not few:  # a join by owner leaves the rows by owner, and grouping would keep a large group's pairs of blocks together
        spread = spread.repartition("owner", "lo", "hi")

    def linked(key, table):
        table = table.sort_by("rep")
        rep = table.column("rep").to_numpy()
        root = link([np.frombuffer(x.as_buffer(), "<u8") for x in table.column("items")])
        root = np.array(root, np.int64)
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": rep[far], "b": rep[root[far]]})

    edges = spread.groupBy("owner", "lo", "hi").applyInArrow(linked, "a long, b long")
    found = components(edges.unionByName(copies))
    rows = held.where("owner is null").select("doc_id", "n_shingles", "rep")
    return rows.join(found, rows["rep"] == found["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, that of the least id. Rows without an id stay; of rows that share an id all stay."""
    lost = shingle_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_copy_id")).distinct()
    return docs.join(lost, docs["doc_id"].cast("long") == lost["_copy_id"], "left_anti")
