"""Token counts: greedy longest-match word pieces counted by a linear automaton.

The vocabulary is a trie over byte strings. Each node has a failure link and the number of pieces popped on taking it,
both computed once by breadth-first search, so a word costs one step for each byte and no piece is ever built
(the LinMaxMatch scheme of the public "Fast WordPiece Tokenization" paper, 2021).
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scorepool.llm.common import doc_text, slices, utf8
from scorepool.llm.tokenise import _LETTERS, default_path

#: Words kept in a worker's memo, each of at most LONG_WORD bytes; beyond it the memo starts anew. They change speed only.
MEMO_WORDS, LONG_WORD = 500_000, 200


class MaxMatch:
    """Counts the pieces of greedy longest-match tokenisation. `pieces` are byte strings; a word is matched with `prefix` before it.

    A word in which some position has no matching piece counts as one unknown token.
    """

    def __init__(self, pieces, prefix: bytes = b""):
        self.prefix = prefix
        self.next: list[dict[int, int]] = [{}]
        end = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                to = self.next[node].get(b)
                if to is None:
                    to = self.next[node][b] = len(self.next)
                    self.next.append({})
                    end.append(False)
                node = to
            end[node] = bool(piece)
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            above = queue.popleft()
            for b, node in self.next[above].items():
                queue.append(node)
                if end[node]:  # the whole string is a piece
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, n = self.fail[above], self.popped[above]
                while at >= 0 and b not in self.next[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at][b], n
        self.memo: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """The number of pieces; -1 for a word without a split."""
        node, n = 0, 0
        for b in self.prefix + word:
            while (to := self.next[node].get(b)) is None:
                n += self.popped[node]
                node = self.fail[node]
                if node < 0 or (node == 0 and b not in self.next[0]):
                    return -1
            node = to
        while node > 0:
            n += self.popped[node]
            node = self.fail[node]
        return n if node == 0 else -1

    def counts(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        new = set(words).difference(memo)
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = set(words)
        long = {}
        for w in new:
            (memo if len(w) <= LONG_WORD else long)[w] = self.count(w)
        if long:
            return np.fromiter((long[w] if len(w) > LONG_WORD else memo[w] for w in words), np.int64, len(words))
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file as byte strings."""
    back = {chr(c): b for b, c in _LETTERS.items()}
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {t["content"] for t in held.get("added_tokens", [])}
    return [bytes(back[c] for c in t) for t in held["model"]["vocab"] if t not in special]


@lru_cache(maxsize=2)
def automaton(path: str) -> MaxMatch:
    return MaxMatch(vocabulary(path), prefix=b" ")


def token_counts(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_tokens, n_unknown (words without a split, one token each).

    Words are [^\\x20\\x09-\\x0D]+ of the UTF-8 text, each matched with a space before it. A null or empty text has no words
    and 0 tokens; a very long text makes a slice of its own, and very long words are counted each time; null ids, repeated rows and any other columns are allowed; row count is kept. One narrow pass, no shuffle.
    """
    path = vocabulary_path or default_path("byte_bpe_50k.json")

    def run(batches):
        machine = automaton(path)
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                raw = data.tobytes()
                words = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                n_words = np.fromiter(map(len, words), np.int64, len(words))
                got = machine.counts([w for ws in words for w in ws])
                unknown = got < 0
                sums = np.concatenate([[0], np.cumsum(np.where(unknown, 1, got))])
                unk = np.concatenate([[0], np.cumsum(unknown)])
                ptr = np.concatenate([[0], np.cumsum(n_words)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words), pa.array(sums[ptr[1:]] - sums[ptr[:-1]]), pa.array(unk[ptr[1:]] - unk[ptr[:-1]])],
                    names=["doc_id", "n_words", "n_tokens", "n_unknown"],
                )

    return doc_text(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
