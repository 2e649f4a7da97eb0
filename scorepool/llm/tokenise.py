"""Token ids by public tokenizers, a word at a time: both vocabularies never merge over a plain word boundary, so a bounded
word memo per worker gives the same ids as encoding the whole text. Texts with a special token's name, with a very long word
or with odd white space are encoded whole."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scorepool.llm.common import Words, looked_up, mix64, utf8

#: Words and ids kept in a worker's memo; beyond either it keeps what came again, at most half of that. They change speed only.
MEMO_WORDS, MEMO_IDS = 1 << 20, 1 << 23
#: Text to be tokenised at once, in bytes: a slice's arrays take about 50 times that.
TEXT_BYTES = 1 << 20
#: New words to a text for the library, as its time for each grows with a text's length, and to a piece that it merges.
TEXT_WORDS, PIECE_WORDS = 192, 16
#: Longest word that is kept, in bytes.
LONG_WORD = 200


@lru_cache(maxsize=4)
def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _pieces(path: str):
    """The merges alone, of each line."""
    from tokenizers import Tokenizer, pre_tokenizers

    alone = Tokenizer(_load(path).model)
    alone.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
    return alone


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next code from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b if b in printable else 256 + others.index(b) for b in range(256)}


_LETTERS = _byte_letters()
#: UTF-8 of these letters, in two bytes or, below 0x80, one; a line feed stays as it is, to part words.
_LETTER_BYTES = np.array([list(chr(c if b != 0x0A else b).encode().rjust(2, b"\0")) for b, c in sorted(_LETTERS.items())], np.uint8)

#: How a word begins: after a space, at the start of a text, after a line feed.
SPACED, BARE, AFTER_LINE = 0, 1, 2
#: Stands between words that are merged in one text; plain words have letters only.
_MARK = "!"
#: White space that byte-level splitters see inside or beside words, apart from single spaces and line feeds between two words.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_ODD_LEAD = _ODD_LEAD.tobytes()
#: Bytes of plain words: ASCII letters, and the two-byte letters from U+00C0 to U+00FF, whose second byte is looked up apart.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_LETTER = _LETTER.tobytes()
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_FRONT = (1 << 8 * np.arange(9, dtype=object)) - 1
_FRONT = _FRONT.astype(np.uint64)


def _listed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all lists in a row, and each list's number."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size


def _keys(padded: np.ndarray, start: np.ndarray, size: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and its kind, and its first eight bytes as a number. Eight bytes of it are taken at a time; at least as many follow
    the last word."""
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    front = eight[start]
    front &= _FRONT.take(size, mode="clip")
    key, at, left = mix64(front + (size << 2 | kind).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 8, np.flatnonzero(size > 8)
    while len(left):
        more = size.take(left) - at
        part = eight[start.take(left) + at]
        part &= _FRONT.take(more, mode="clip")
        part *= np.uint64(0xA0761D6478BD642F)
        part += key.take(left)
        key[left] = mix64(part)
        left, at = left[more > 8], at + 8
    return key, front


def _lines(data: np.ndarray, start: np.ndarray, end: np.ndarray, words: int) -> list[str]:
    """Words and the space before each, in byte letters, so many to a line, in texts of a few lines."""
    if not len(start):
        return []
    feed = np.arange(1, len(start) + 1) % words == 0
    feed[-1] = True
    size = end - start + 1 + feed
    ends = np.cumsum(size)
    at = np.repeat(start - 1 - ends + size, size)
    at += np.arange(len(at))
    part = data.take(at)
    part[ends[feed] - 1] = 0x0A
    first, second = _LETTER_BYTES[:, 0].take(part), _LETTER_BYTES[:, 1].take(part)
    two = first > 0
    place = np.cumsum(two) + np.arange(len(two))
    out = np.empty(int(place[-1]) + 1, np.uint8)
    out[place] = second
    out[place[two] - 1] = first[two]
    cut = [0, *(place[ends[feed] - 1][max(1, TEXT_WORDS // words) - 1 :: max(1, TEXT_WORDS // words)] + 1).tolist(), len(out)]
    raw = out.tobytes()
    return [raw[a : b - 1].decode("utf-8") for a, b in zip(cut[:-1], cut[1:], strict=True) if a < b]


class Memo:
    """Ids of words under one vocabulary: an open-addressed table of word hashes, each with a second check of the word's length and
    first eight bytes, and the ids of all of them in a row."""

    def __init__(self, path: str, split: bool):
        self.tokenizer, self.split, self.path = _load(path), split, path
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.heads = ["", "", ""] if split else [" ".translate(_LETTERS), "", ""]
        self.line = [] if split else self._merge("\n".translate(_LETTERS))
        if not split:  # the line feed is a piece of its own before the word
            self.heads[AFTER_LINE] = "\n".translate(_LETTERS) + "\n"
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
            space, letters = self.heads[SPACED], {_LETTERS[b] for b in range(256) if _LETTER[b] or 0x80 <= b < 0xC0}
            self.leads[[i for token, i in vocabulary.items() if token.startswith(space)]] = True
            # words of a piece stay apart if no token goes on over the space after a plain word's letter
            inside = [x for x in vocabulary if space in x[1:] and all(c == space or ord(c) in letters for c in x)]
            self.piece_words = 1 if any(a != space and b == space for x in inside for a, b in zip(x, x[1:], strict=False)) else PIECE_WORDS
        mark = self._merge(_MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.bits = (2 * MEMO_WORDS - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.ptr, self.size, self.flat = np.zeros(MEMO_WORDS, np.int64), np.zeros(MEMO_WORDS, np.int64), np.zeros(1 << 16, "<u4")
        self.again = np.zeros(MEMO_WORDS, bool)
        self.n, self.used = 0, 0
        self._add(np.array([1, 2], np.uint64), np.zeros(2, np.uint64), *_listed([self._merge("."), self._merge(",")]))  # entries 0 and 1

    def _thin(self) -> None:
        """Starts anew with the words that came again since they were added."""
        at = np.flatnonzero(self.keys)
        at = at[self.again[self.entry[at]] & (self.entry[at] > 1)]
        entry = self.entry[at]
        many = self.size[entry]
        if len(at) > MEMO_WORDS // 2 or many.sum() > MEMO_IDS // 2:
            return self.clear()
        key, check = self.keys[at], self.checks[at]
        ids = self.flat[np.repeat(self.ptr[entry] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        self.clear()
        self._add(key, check, ids, many)

    def _merge(self, part: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(part)]

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kinds: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words data[start:end] in a row, and the number of each word's. Plain ones, of letters alone, go straight to the merges. Words
        after a space are encoded in common texts, and told apart by the space that only their first ids hold."""
        spaced = (kinds == SPACED) & (not self.split)
        groups = [np.flatnonzero(x) for x in (plain & spaced, plain & ~spaced, ~plain & spaced, ~plain & ~spaced)]
        bare, joined, rest = ([data[a:b].tobytes() for a, b in zip(start[x].tolist(), end[x].tolist(), strict=True)] for x in groups[1:])
        found = [
            self._apart(_pieces, _lines(data, start[groups[0]], end[groups[0]], 1 if self.split else self.piece_words)),
            self._marked([self.heads[k] + self._part(x) for k, x in zip(kinds[groups[1]].tolist(), bare, strict=True)]),
            self._apart(_load, [b"".join([b" " + x for x in joined[k : k + TEXT_WORDS]]).decode("utf-8") for k in range(0, len(joined), TEXT_WORDS)]),
        ]
        other = self.tokenizer.encode_batch_fast([x.decode("utf-8") for x in rest], add_special_tokens=False)
        found.append(_listed([self.line + g.ids if k == AFTER_LINE else g.ids for k, g in zip(kinds[groups[3]].tolist(), other, strict=True)]))
        size, group = np.zeros(len(start), np.int64), np.zeros(len(start), np.uint8)
        for k, (at, (_, many)) in enumerate(zip(groups, found, strict=True)):
            size[at], group[at] = many, k
        group = np.repeat(group, size)
        out = np.empty(len(group), np.uint32)
        for k, (ids, _) in enumerate(found):
            out[group == k] = ids
        return out, size

    def _part(self, word: bytes) -> str:
        """A plain word in byte letters."""
        if word.isascii():
            return (word.lower() if self.split else word).decode("latin-1")
        return (word.decode("utf-8").lower().encode() if self.split else word).decode("latin-1").translate(_LETTERS)

    def _apart(self, load: Callable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words after spaces in texts, and each word's number."""
        if not texts:
            return _listed([])
        ids = _listed([g.ids for g in load(self.path).encode_batch_fast(texts, add_special_tokens=False)])[0]
        return ids, np.diff(np.flatnonzero(self.leads.take(ids)), append=len(ids))

    def _marked(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts to merge, and each part's number: in common texts, with a mark after each that no part holds."""
        if not parts or self.mark is None:
            return _listed([[i for line in x.split("\n") for i in self._merge(line)] for x in parts])
        texts = ["".join([f"{x}\n{_MARK}\n" for x in parts[k : k + TEXT_WORDS]]) for k in range(0, len(parts), TEXT_WORDS)]
        ids = _listed([g.ids for g in _pieces(self.path).encode_batch_fast(texts, add_special_tokens=False)])[0]
        ends = np.flatnonzero(ids == self.mark)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entries of words, -1 for unknown ones."""
        mask, shift = (1 << self.bits) - 1, np.uint64(64 - self.bits)
        slot = (key >> shift).astype(np.int64)
        out = np.where(self.checks.take(slot) == check, self.entry.take(slot), -1).astype(np.int64)
        held = self.keys.take(slot)
        out[held != key] = -1
        left = np.flatnonzero((out < 0) & (held != 0))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & mask
            held = self.keys.take(slot)
            hit = (held == key[left]) & (self.checks.take(slot) == check[left])
            out[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (held != 0)
            left, slot = left[on], slot[on]
        return out

    def _add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New distinct words: their ids in a row, and the number of each word's."""
        total = len(ids)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used), "<u4")])
        self.flat[self.used : self.used + total] = ids
        at = np.arange(self.n, self.n + len(size))
        self.ptr[at], self.size[at] = self.used + np.cumsum(size) - size, size
        self.n, self.used = self.n + len(size), self.used + total
        mask, slot = (1 << self.bits) - 1, (key >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            free = np.flatnonzero(self.keys.take(slot) == 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.checks[slot[put]], self.entry[slot[put]] = key[left[put]], check[left[put]], at[left[put]]
            on = np.ones(len(left), bool)
            on[put] = False
            left, slot = left[on], slot[on] + 1 & mask

    def _odd(self, array: pa.Array, w: Words, doc_of: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Texts to encode whole."""
        odd = np.zeros(len(array), bool)
        raw = w.data.tobytes()
        for name in self.special:
            if name.encode() in raw:
                odd |= pc.match_substring(array, name).to_numpy(zero_copy_only=False)
        odd[doc_of[size > LONG_WORD]] = True
        if self.split:
            return odd
        # one space or line feed between two words, none before the first and after the last
        inner = np.flatnonzero(doc_of[1:] == doc_of[:-1])
        wide = (w.start[inner + 1] - w.end[inner] != 1) | ~np.isin(w.data[w.end[inner]], (0x20, 0x0A))
        odd[doc_of[inner[wide]]] = True
        filled = w.ptr[1:] > w.ptr[:-1]
        odd |= ~filled & (w.offsets[1:] > w.offsets[:-1])
        first, last = w.ptr[:-1][filled], w.ptr[1:][filled] - 1
        odd[filled] |= (w.start[first] != w.offsets[:-1][filled]) | (w.end[last] != w.offsets[1:][filled])
        lead = looked_up(w.data, _ODD_LEAD).copy()
        two = w.data[:-1] == 0xC2
        lead[:-1] |= two & ((w.data[1:] == 0x85) | (w.data[1:] == 0xA0))
        suspect = np.unique(np.searchsorted(w.offsets, np.flatnonzero(lead), side="right") - 1)
        for i in suspect[~odd[suspect]].tolist():
            odd[i] = bool(_ODD.search(w.text(i).decode("utf-8")))
        return odd

    def ids(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (null counts as empty), and the number of each text's."""
        array = pc.fill_null(array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array, "")
        w = Words(array, lower=False, hashed=False)
        doc_of = np.repeat(np.arange(len(array)), np.diff(w.ptr))
        size = w.end - w.start
        odd = self._odd(array, w, doc_of, size)
        # letters of both vocabularies' splitters, as bytes; a mark after letters alone is a piece of its own
        letter = looked_up(w.data, _LETTER).copy()
        second = np.flatnonzero(w.data == 0xC3) + 1
        letter[second] = _LATIN[w.data[second]]
        strange = np.zeros(len(letter) + 1, np.int64 if len(letter) >> 31 else np.int32)
        np.cumsum(~letter, out=strange[1:])
        mark = np.where(size > 1, w.data[np.maximum(w.end - 1, 0)], 0) if len(size) else size
        marked = ((mark == 0x2E) | (mark == 0x2C)) & (strange[w.end] - strange[w.start] == 1)
        w.end -= marked
        size = size - marked
        plain = strange[w.end] == strange[w.start]
        at = np.flatnonzero(~odd[doc_of]) if odd.any() else np.arange(len(doc_of))
        doc_of, start, end, size = doc_of[at], w.start[at], w.end[at], size[at]
        plain, marked, mark = plain[at], marked[at], mark[at]
        kind = np.zeros(len(at), np.int64)
        if not self.split and len(at):
            fed = w.data[np.maximum(start - 1, 0)] == 0x0A
            kind[fed] = AFTER_LINE
            kind[start == w.offsets[doc_of]] = BARE
        padded = np.concatenate([w.data, np.zeros(8, np.uint8)])
        key, front = _keys(padded, start, size, kind)
        key = np.where(key < 3, key + np.uint64(3), key)  # 0 marks a free place; 1 and 2 are the marks'
        check = front ^ (size.astype(np.uint64) << np.uint64(56))
        entry = self._find(key, check)
        new, first = self._new(entry, key, check)
        self.again[entry[entry >= 0]] = True
        if self.n and len(first) and (self.n + len(first) > MEMO_WORDS or self.used > MEMO_IDS):
            self._thin()
            if self.n + len(first) > MEMO_WORDS:
                self.clear()
            entry = self._find(key, check)
            new, first = self._new(entry, key, check)
        if len(first):
            self._reserve(len(first))
            self._add(key[first], check[first], *self._encode(padded, start[first], end[first], kind[first], plain[first]))
            entry[new] = self._find(key[new], check[new])
        place = np.arange(len(entry)) + np.cumsum(marked) - marked
        every = np.full(len(entry) + int(marked.sum()), 0)
        every[place] = entry
        every[place[marked] + 1] = mark[marked] == 0x2C
        entry, many = every, self.size[every]
        sums = np.concatenate([[0], np.cumsum(many)])
        cut = sums[np.append(place, len(entry))[np.searchsorted(doc_of, np.arange(len(array) + 1))]]
        counts = np.diff(cut)
        at = np.repeat(self.ptr.take(entry) - sums[:-1], many)
        at += np.arange(sums[-1])
        flat = self.flat.take(at)
        if odd.any():
            which = np.flatnonzero(odd).tolist()
            whole = [np.array(g.ids, "<u4") for g in self.tokenizer.encode_batch_fast([w.text(i).decode("utf-8") for i in which], add_special_tokens=False)]
            parts, done = [], 0
            for i, ids in zip(which, whole, strict=True):
                parts += [flat[done : cut[i]], ids]
                counts[i], done = len(ids), cut[i]
            flat = np.concatenate([*parts, flat[done:]])
        return flat, counts

    @staticmethod
    def _new(entry: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of unknown words, and the first place of each distinct one."""
        new = np.flatnonzero(entry < 0)
        order = new[np.lexsort((check[new], key[new]))]
        differ = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        return new, order[np.concatenate([[True], differ])] if len(order) else order

    def _reserve(self, n: int) -> None:
        """Room for n more words; only a slice with more distinct words than the memo holds needs any."""
        if self.n + n > len(self.ptr):
            self.bits = max(self.bits, (2 * n + 7).bit_length())
            self.clear()
            self.ptr, self.size = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.ptr, self.size))
            self.again = np.zeros(len(self.ptr), bool)


@lru_cache(maxsize=4)
def memo(path: str, split: bool) -> Memo:
    return Memo(path, split)


def text_ids(array: pa.Array, path: str, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts and their numbers. `split`: a vocabulary that drops white space; else a byte-level one, whose words carry the space before them."""
    return memo(path, split).ids(array)


def with_end(flat: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by the end id."""
    bounds = np.cumsum(counts + 1)
    out = np.empty(len(flat) + len(counts), "<u4")
    inside = np.ones(len(out), bool)
    inside[bounds - 1] = False
    out[inside], out[bounds - 1] = flat, end
    return out, counts + 1
