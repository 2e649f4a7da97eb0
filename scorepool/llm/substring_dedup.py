"""Substring dedup by fixed-block anchors.

Each text is a reference in non-overlapping blocks of BLOCK words, which are indexed; every rolling window of BLOCK words
probes them. A run of WINDOW = 2 * BLOCK repeated words holds a whole block of its earlier occurrence, so it cannot pass
unseen. Around the hits runs are extended: a window of WINDOW words can be a repeat only if every rolling block in it occurs
twice and one of them is anchored. Those windows alone are compared over the corpus, and all but the earliest are removed.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scorepool.llm.common import Words, mix64, windows
from scorepool.llm.exchange import Answers, Format, ask, cells, grouped, ids_of, meet, packets

BLOCK = 10
WINDOW = 2 * BLOCK

_REPEATED, _ANCHORED = 1, 2


class _Blocks:
    """Rolling blocks of a packet: hashes at all word positions, and which positions have a whole block in one text."""

    def __init__(self, table: pa.Table):
        self.words = Words(table.column("text").combine_chunks(), lower=False)
        self.text_of = np.repeat(np.arange(len(table)), np.diff(self.words.ptr))
        self.hash = windows(self.words.hash, BLOCK)
        n = len(self.hash)
        self.at = np.flatnonzero(self.text_of[:n] == self.text_of[BLOCK - 1 :]) if n else np.zeros(0, np.int64)
        self.order, self.first = grouped(self.hash[self.at])
        self.keys = self.hash[self.at][self.order[self.first]]

    def inverse(self) -> np.ndarray:
        """The key of each position of `at`."""
        out = np.zeros(len(self.at), np.int64)
        group = np.zeros(len(self.at), np.int64)
        group[self.first[1:]] = 1
        out[self.order] = np.cumsum(group)
        return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256.

    Words [^\\x20\\x09-\\x0D]+ as they are. Every word in a window of WINDOW words whose sequence also starts earlier (smaller
    doc_id, or the same and an earlier start) is removed; windows are judged on the input. A null text has no words and keeps
    the empty string. Rows that share an id have equal places, so neither is earlier than the other at the same start; a null
    id is the smallest. Empty tables and clashing extra columns are allowed; row count is kept.
    """
    n = cells(docs)
    dealt = packets(docs, n)
    probe = Format(n, 5, flags="u1")
    verdict = Answers(verdict="u1")
    repeat = Format(n, 7, doc="<i8", start="<u4", at="<u4")

    def send(packet, table):
        b = _Blocks(table)
        flags = np.zeros(len(b.keys), np.uint8)
        if len(b.keys):
            place = b.at - b.words.ptr[b.text_of[b.at]]
            flags = np.maximum.reduceat((place % BLOCK == 0)[b.order].astype(np.uint8), b.first) * np.uint8(_ANCHORED)
            flags |= (np.diff(np.append(b.first, len(b.at))) > 1).astype(np.uint8) * np.uint8(_REPEATED)
        return probe.write(packet, b.keys, flags=flags)

    def judge(bucket, table):
        who, bounds, keys, values = probe.read(table)
        order, first = grouped(keys)
        many = np.diff(np.append(first, len(keys)))
        flags = np.bitwise_or.reduceat(values["flags"][order], first)
        flags[many > 1] |= _REPEATED
        flags[(flags & _REPEATED) == 0] = 0
        out = np.zeros(len(keys), np.uint8)
        out[order] = np.repeat(flags, many)
        return verdict.write(bucket, who, bounds, verdict=out)

    def extend(packet, table, answers):
        b, ids = _Blocks(table), ids_of(table)[0]
        nothing = repeat.write(packet, np.zeros(0, np.uint64), doc=np.zeros(0), start=np.zeros(0), at=np.zeros(0))
        if not len(b.keys):
            return nothing
        flags = np.zeros(len(b.hash), np.uint8)
        flags[b.at] = verdict.read(answers)["verdict"][b.inverse()]
        m = len(b.hash) - BLOCK
        if m <= 0:
            return nothing
        repeated = np.concatenate([[0], np.cumsum(flags & _REPEATED)])
        anchored = np.concatenate([[0], np.cumsum((flags & _ANCHORED) > 0)])
        s = np.arange(m)
        s = s[(repeated[BLOCK + 1 : BLOCK + 1 + m] - repeated[:m] == BLOCK + 1) & (anchored[BLOCK + 1 : BLOCK + 1 + m] > anchored[:m]) & (b.text_of[:m] == b.text_of[WINDOW - 1 : WINDOW - 1 + m])]
        if not len(s):
            return nothing
        h = mix64(b.hash[s] * np.uint64(0xD1B54A32D192ED03) + b.hash[s + BLOCK])
        order, first = grouped(h)  # stable, and rows are in order of id: the first entry of a key is its earliest place here
        s = s[order]
        doc, start = ids[b.text_of[s]], s - b.words.ptr[b.text_of[s]]
        size = np.diff(np.append(first, len(s)))
        later = (doc != np.repeat(doc[first], size)) | (start != np.repeat(start[first], size))
        out = repeat.write(packet, h[order][first], doc=doc[first], start=start[first], at=s[first])
        known = np.sort(s[later])
        mine = pa.Table.from_arrays([pa.array([packet], pa.int32()), pa.array([packet % n], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([known.astype("<u4").tobytes()], pa.binary())], schema=repeat.arrow)
        equal = np.flatnonzero(~later & (np.arange(len(s)) != np.repeat(first, size)))  # rows repeated under one id share a place
        if len(equal):
            extra = pa.Table.from_arrays([pa.array([packet] * len(equal), pa.int32()), pa.array(((h[order][equal] >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int32)), pa.array([x.tobytes()[: repeat.width] for x in h[order][equal].astype("<u8")], pa.binary()), pa.array([x.tobytes() for x in doc[equal].astype("<i8")], pa.binary()), pa.array([x.tobytes() for x in start[equal].astype("<u4")], pa.binary()), pa.array([x.tobytes() for x in s[equal].astype("<u4")], pa.binary())], schema=repeat.arrow)
            return pa.concat_tables([out, mine, extra])
        return pa.concat_tables([out, mine])

    def earliest(bucket, table):
        asked = table.filter(table.column("keys").is_valid())
        done = table.filter(table.column("keys").is_null())
        where: list[tuple[int, bytes]] = list(zip(done.column("packet").to_pylist(), done.column("at").to_pylist(), strict=True))
        if len(asked):
            who, bounds, keys, v = repeat.read(asked)
            order = np.lexsort((v["start"], v["doc"], keys))
            s = keys[order]
            first = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
            size = np.diff(np.append(first, len(s)))
            doc, start = v["doc"][order], v["start"][order]
            later = np.zeros(len(keys), bool)
            later[order] = (doc != np.repeat(doc[first], size)) | (start != np.repeat(start[first], size))
            for p, a, b in zip(who, bounds[:-1], bounds[1:], strict=True):
                if later[a:b].any():
                    where.append((p, v["at"][a:b][later[a:b]].tobytes()))
        return pa.Table.from_arrays([pa.array([p for p, _ in where], pa.int32()), pa.array([x for _, x in where], pa.binary())], names=["packet", "at"])

    def finish(packet, table, found):
        words = Words(table.column("text").combine_chunks(), lower=False)
        cover = np.zeros(len(words.hash) + WINDOW + 1, np.int32)
        for x in found.column("at"):
            at = np.frombuffer(x.as_buffer(), "<u4")
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
        covered = np.cumsum(cover)[: len(words.hash)] > 0
        sums = np.concatenate([[0], np.cumsum(covered)])
        removed = sums[words.ptr[1:]] - sums[words.ptr[:-1]]
        digest = []
        for i in range(len(table)):
            own = words.text(i).split()
            if removed[i]:
                own = compress(own, ~covered[words.ptr[i] : words.ptr[i + 1]])
            digest.append(hashlib.sha256(b" ".join(own)).hexdigest())
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(np.diff(words.ptr).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    hits = ask(dealt, probe, send, judge, verdict.schema)
    candidates = meet(dealt, hits, extend, repeat.schema)

    def at_bucket(key, table):
        return earliest(key[0].as_py(), table)

    found = candidates.groupBy("bucket").applyInArrow(at_bucket, "packet int, at binary")
    return meet(dealt, found, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
