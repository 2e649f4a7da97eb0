"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

In each block, order-2 and order-1 contexts each predict one next id, with a confidence, by what followed them last. Order 0
predicts over all ids: adaptive frequencies of classes of ids (a power of two's eighth each), and in a class the id it held
last, with an adaptive probability, against the others evenly. The three are mixed into one distribution by shares that
adapt for each pair of confidences, and that distribution drives the range coder; what is even goes as plain bits beside it.
All numbers are integers below 2^53, held in float64, where each step is exact: files read the same on every machine. Blocks
don't depend on each other: a segment codes its blocks in lockstep, one lane each, in vector operations. A writer, who knows all ids,
finds what the contexts say by sorting, many steps at once, and goes step by step in the range coder alone.

A segment, all integers little-endian: magic, format flags u32, documents u32, blocks u32, crc32 u32 of the tables; ids of
documents i64, their null marks u8, their numbers of tokens u32; numbers of ids u32, coded bytes u32, plain bytes u32 and crc32
u32 of the ids of each block; coded bytes of all blocks, then their plain bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorepool.llm.common import crc, doc_text, materialise, slices
from scorepool.llm.tokenise import TEXT_BYTES, default_path, text_ids, with_end

MAGIC = b"CMR2"
WIDE = 1
#: Ids of a block, and blocks of a segment.
BLOCK = 4096
LANES = 4608
#: Blocks that are coded at once, so that their tables stay in a cache.
RUN = 1536
#: Text of a file's range of documents, in bytes: about 3700 blocks, as each step of theirs has a fixed cost beside that of its lanes.
FILE_BYTES = 36 << 20

_ONE, _TWO = 9, 10  # bits of the tables of contexts
_SHARE, _PLACE = 16, 11  # bits of probabilities: of the orders' shares, of order 0's symbols
_MOST, _LEAST = 62000, 32  # what order 2 and order 1 may take together, and each at least
_PER = 3  # bits of a class's place between two powers of two
_RENEW = 512  # probabilities take up what was seen after 8, 16, 32 ... steps and then after each so many

# the coder's interval lies between _NARROW and _WHOLE, and gives a digit off where it would get narrower
_DIGIT, _NARROW, _WHOLE = 2.0**24, 2.0**28, 2.0**52


def _classes(wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """First id and number of plain bits of each class."""
    k = np.arange((33 - _PER if wide else 17 - _PER) << _PER)
    bits = np.maximum((k >> _PER) - 1, 0)
    return np.where(k < 2 << _PER, k, ((k & ((1 << _PER) - 1)) + (1 << _PER)) << bits), bits


def _class_of(ids: np.ndarray) -> np.ndarray:
    bits = np.maximum(np.frexp(ids.astype(np.float64))[1].astype(np.int64) - _PER - 1, 0)
    return (bits << _PER) + (ids >> bits)


_MIX = np.uint32(0x9E3779B1)  # hashes of contexts are of 32 bits
#: Class and plain bits (and above them, how many) of each id of 16 bits.
_KNOWN = _class_of(np.arange(1 << 16)).astype(np.uint8)
_PLAIN = _classes(False)
_PLAIN = ((_PLAIN[1].take(_KNOWN) << 12) + np.arange(1 << 16) - _PLAIN[0].take(_KNOWN)).astype(np.uint16)


def _first_shares() -> np.ndarray:
    """How often order 2, order 1 or neither is right to begin with, by their confidences: 0 for no prediction, else 1 to 3."""
    sure = np.array([0, 10, 28, 46])
    two, one = np.repeat(sure, 4), np.tile(sure, 4)
    one = (64 - two) * one // 256
    return np.stack([64 - two - one, one, two], 1)


def _packed(plain: np.ndarray, shift: int) -> list[bytes]:
    """Of plain[lane, step] its low bits, as many as it says above them, the lowest first, in a byte string for each lane."""
    (lanes, steps), plain = plain.shape, plain.ravel()
    held = np.flatnonzero(plain)
    lane = held // max(steps, 1)
    value = plain[held].astype(np.uint64)
    many = (value >> np.uint64(shift)).astype(np.int64)
    value &= np.uint64((1 << shift) - 1)
    ends = np.concatenate([[0], np.cumsum(many)])
    first_of = ends[np.searchsorted(lane, np.arange(lanes + 1))]
    cut = np.concatenate([[0], np.cumsum(-(-np.diff(first_of) // 8))])
    place = ends[:-1] + (8 * cut - first_of)[lane]
    out = np.zeros(cut[-1] // 8 + 2, np.uint64)
    if len(place):
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        out[word[first]] = np.add.reduceat(value << shift, first)  # bits never meet, so sums are unions
        over = np.flatnonzero((place & 63) + many > 64)
        out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


class _Decoder:
    def __init__(self, coded: list[bytes], plain: list[bytes], wide: bool):
        self.low, self.range = np.zeros(len(coded)), np.full(len(coded), _WHOLE)
        digits = np.frombuffer(b"".join(coded) + bytes(9), np.uint8).reshape(-1, 3).astype(np.uint32)
        digits = digits[:, 0] << 16 | digits[:, 1] << 8 | digits[:, 2]
        self.data = ((digits[:-1] << 4 | digits[1:] >> 20) & 0xFFFFFF).astype(np.float32)  # an interval ends 4 bits into a digit
        self.at = np.cumsum([0] + [len(x) // 3 for x in coded])[:-1]
        self.low += digits.take(self.at) >> 20
        for _ in range(2):
            self.low = self.low * _DIGIT + self.data.take(self.at)
            self.at += 1
        size = sum(map(len, plain))
        two = np.frombuffer(b"".join(plain) + bytes(8 + size % 2), "<u2").astype(np.int64 if wide else np.uint32)
        self.window = two[:-2] | two[1:-1] << 16 | (two[2:] << 32 if wide else 0)  # from each second byte on, more than a symbol takes
        self.bit = 8 * np.cumsum([0] + [len(x) for x in plain])[:-1]

    def settle(self, live: int) -> None:
        few = (self.range[:live] < _NARROW).nonzero()[0]
        low, at, rng = self.low.take(few), self.at.take(few), self.range.take(few)
        low *= _DIGIT
        low += self.data.take(at, mode="clip")
        at += 1
        rng *= _DIGIT
        self.low[few], self.at[few], self.range[few] = low, at, rng

    def bits(self, who: np.ndarray, many: np.ndarray, below: np.ndarray) -> np.ndarray:
        bit = self.bit.take(who)
        out = self.window.take(bit >> 4, mode="clip").astype(np.int64)
        out >>= bit & 15
        out &= below
        bit += many
        self.bit[who] = bit
        return out


class _Model:
    """What adapts: shares of the orders by their confidences, and spans of order 0's symbols, and beside those two columns for none, whose span is the whole."""

    def __init__(self, lanes: int, symbols: int):
        self.right, self.seen, self.symbols = np.tile(_first_shares(), (lanes, 1)).astype(np.int32), np.zeros((lanes, symbols + 2), np.int32), symbols

    def saw(self, code: np.ndarray, symbol: np.ndarray, group: int = 64) -> None:
        """Takes up confidences in fours, plus which orders were right, and symbols, all [step, lane]; a few lanes at a time, whose counts are close."""
        lanes, columns = self.seen.shape
        for at in range(0, lanes, group):
            many = min(group, lanes - at)
            more = np.bincount((np.ascontiguousarray(code[:, at : at + many].T) + (np.arange(many) << 6)[:, None]).ravel(), minlength=many << 6).reshape(-1, 4)
            more[:, 2] += more[:, 3]
            self.right[at << 4 : at + many << 4] += more[:, :3].astype(np.int32)
            more = np.bincount((np.ascontiguousarray(symbol[:, at : at + many].T) + (np.arange(many) * columns)[:, None]).ravel(), minlength=many * columns)
            self.seen[at : at + many] += more.reshape(many, columns).astype(np.int32)

    def renew(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Up to where order 2's share goes and where order 1's (as one complex number); starts and widths of spans (as one number); widths."""
        part = _MOST / (self.right.sum(1) * float(1 << _SHARE))
        least = _LEAST / (1 << _SHARE)
        shares = np.empty((len(self.right), 2))
        shares[:, 0] = self.right[:, 2] * part + least
        shares[:, 1] = shares[:, 0] + self.right[:, 1] * part + least
        symbols, seen = self.symbols, self.seen[:, : self.symbols]
        width = (seen * 16 + 1) * ((1 << _PLACE) - symbols) / (seen.sum(1, keepdims=True, dtype=np.int32) * 16 + symbols)
        width = width.astype(np.int32) + np.int32(1)  # rounded down exactly, as both numbers are below 2^27
        start = np.cumsum(width, axis=1, dtype=np.int32)
        width[:, -1] += (1 << _PLACE) - start[:, -1]
        start -= width
        start[:, -1] = (1 << _PLACE) - width[:, -1]
        spans = np.ones(self.seen.shape, np.int32)
        spans[:, :symbols] = start << _PLACE + 1 | width
        return shares.view(np.complex128).ravel(), spans.ravel(), width


def _decoded(coder: _Decoder, sizes: np.ndarray, wide: bool) -> np.ndarray:
    """Finds ids[step, lane], in lockstep. Lanes must be in order of size, longest first.

    Inside, an id is its value plus one, and 0 means none.
    """
    lanes, steps, kind = len(sizes), int(sizes.max(initial=0)), np.int64 if wide else np.int32
    got = np.zeros((steps, lanes), np.int64 if wide else np.uint16)
    first, extra = _classes(wide)
    symbols = 2 * len(first)  # a class's last id, or another of the class
    first, extra = np.repeat(first, 2).astype(kind), np.repeat(extra, 2)
    extra[0::2] = 0
    below = (1 << extra) - 1
    one, two = np.zeros(lanes << _ONE, kind), np.zeros(lanes << _TWO, kind)  # id; two bits of order 2's confidence; two of order 1's
    # confidences after a step, by those before it in fours, plus 1 if order 1 was right and 2 if order 2 was; each table looks at its own
    surer = np.array([[[4, 8, 12, 12][k >> 2] if right & 2 else 4, [1, 2, 3, 3][k & 3] if right & 1 else 1] for k in range(16) for right in range(4)]).sum(1).astype(kind)
    model, seen = _Model(lanes, symbols), 0
    codes, taken = np.zeros((_RENEW, lanes), np.uint8), np.full((_RENEW, lanes), symbols, np.uint16 if wide else np.uint8)  # since probabilities took them up
    last = np.zeros(lanes * (symbols + 2) >> 1, got.dtype)
    every = np.arange(lanes)
    in_one, in_two, in_shares = every << _ONE, every << _TWO, every << 4
    names = np.tile(np.arange(symbols, dtype=np.uint8 if symbols <= 256 else np.uint16), lanes)
    # hashes of the last id and the one before
    h, h_before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    live, due = lanes, 0
    for step in range(steps):
        if sizes[live - 1] <= step:
            while sizes[live - 1] <= step:
                live -= 1
            h, h_before, in_one, in_two, in_shares = (x[:live] for x in (h, h_before, in_one, in_two, in_shares))
        if step == due:
            due = step + min(max(8, step), _RENEW)
            if step:
                model.saw(codes[: step - seen], taken[: step - seen])
                taken.fill(symbols)
            seen = step
            shares, spans, width = model.renew()
            named = np.repeat(names, width.ravel())
        # what the contexts say
        h1 = in_one + (h >> np.uint32(32 - _ONE))
        h_before *= np.uint32(5)
        h_before += h
        h_before >>= np.uint32(32 - _TWO)
        h2, h_before = in_two + h_before, h
        c1, c2 = one.take(h1), two.take(h2)
        g1, g2 = c1 >> 4, c2 >> 4
        c1 &= 3
        c2 &= 12
        c1 |= c2
        # one step of the coder: order 2's id, order 1's, or another
        low, rng = coder.low[:live], coder.range[:live]
        both = shares.take(in_shares + c1)
        to2, to1 = both.real * rng, both.imag * rng
        np.floor(to2, out=to2)
        np.floor(to1, out=to1)
        is2, hit = low < to2, low < to1
        found = np.where(is2, g2, g1)
        is1 = found == g1
        is1 &= hit
        who = (~hit).nonzero()[0]
        rest = (low - to1).take(who), (rng - to1).take(who)
        low -= to2 * ~is2  # of lanes with another id, both are set below
        to1 -= to2
        rng[:] = np.where(is2, to2, to1)
        right = is2.view(np.uint8) << np.uint8(1)
        right |= is1.view(np.uint8)
        c1 <<= 2
        c1 |= right
        codes[step - seen, :live] = c1
        if len(who):  # order 0: a class with its last id or another
            low, rng = rest
            rng *= 2.0**-_PLACE
            np.floor(rng, out=rng)
            at = who * (symbols + 2)
            s = low / rng
            s = np.minimum(s, (1 << _PLACE) - 1, out=s).astype(np.int64)  # exact: the quotient is below 2^11
            s += who << _PLACE
            s = named.take(s)
            at += s
            cell = at >> 1
            taken[step - seen][who] = s
            span = spans.take(at)
            low -= rng * (span >> _PLACE + 1)
            span &= (2 << _PLACE) - 1
            rng *= span
            coder.low[who], coder.range[who] = low, rng
            s = s.astype(np.int64)
            v = coder.bits(who, extra.take(s), below.take(s)).astype(kind, copy=False)
            v += first.take(s)
            again = (s & 1 == 0).nonzero()[0]
            v[again] = last.take(cell.take(again))
            last[cell] = v
            v += 1
            found[who] = v
        coder.settle(live)
        got[step, :live] = found - kind(1)
        # learn
        new = found << 4
        new |= surer.take(c1)
        one[h1] = new
        two[h2] = new
        h = found.astype(np.uint32)
        h *= _MIX
    return got


def _foretold(v: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Of each step, what its slot of a table of contexts says, which holds what came last there: the confidence, plus 4 if it is right.
    Slots are sorted, so that steps of one stand side by side."""
    key, at, same, held = _sorted(v, slot)
    right = np.zeros(key.shape, np.uint8)
    right[:, 1:] = same & (held[:, 1:] == held[:, :-1])
    sure = right + np.uint8(1)
    sure[:, 1:] += right[:, 1:] & right[:, :-1]
    right <<= np.uint8(2)
    right[:, 1:] |= sure[:, :-1] * same
    out = np.empty(key.size, np.uint8)
    out[at] = right.ravel()
    return out.reshape(key.shape)


def _sorted(v: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Steps of each lane by slot, then in their order: slots, places in v, whether the slot is that of the step before, and v there."""
    lanes, steps = v.shape
    bits = max(steps - 1, 1).bit_length()
    key = slot << bits
    key |= np.arange(steps, dtype=key.dtype)
    key.sort(axis=1)
    at = np.add(key & ((1 << bits) - 1), (np.arange(lanes) * steps)[:, None], dtype=np.int64).ravel()
    key >>= bits
    return key, at, key[:, 1:] == key[:, :-1], v.ravel().take(at).reshape(lanes, steps)


def _modelled(ids: np.ndarray, wide: bool, short: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of ids[lane, step], known beforehand: each step's confidences in fours, plus 1 if order 1 is right and 2 if order 2 is; its symbol of
    order 0, or one beyond those if another order is right; and the lanes' plain bytes, of which the last lane's end after `short` steps."""
    first, extra = _classes(wide)
    v = ids.astype(np.int64 if wide else np.int32)
    v += 1
    h = v.astype(np.uint32)
    h *= _MIX
    slot = np.zeros(h.shape, np.uint32)
    slot[:, 1:] = h[:, :-1]
    one = _foretold(v, (slot >> np.uint32(32 - _ONE)).view(np.int32))
    slot[:, 2:] += h[:, :-2] * np.uint32(5)
    two = _foretold(v, (slot >> np.uint32(32 - _TWO)).view(np.int32))
    code = ((two & np.uint8(3)) << np.uint8(4)) | ((one & np.uint8(3)) << np.uint8(2)) | ((two >> np.uint8(2)) << np.uint8(1)) | (one >> np.uint8(2))
    kind = _class_of(ids.astype(np.int64)).astype(np.int32) if wide else _KNOWN.take(ids).astype(np.int32)
    hit = (code & np.uint8(3)) > 0
    kind[hit] = len(first)
    key, at, same, held = _sorted(v, kind)
    key <<= 1
    key |= 1  # a class's last id, or another of the class
    key[:, 1:] -= same & (held[:, 1:] == held[:, :-1])
    symbol = np.empty(key.size, np.uint16 if wide else np.uint8)
    symbol[at] = key.ravel()
    symbol = symbol.reshape(key.shape)
    coded = (symbol & 1).astype(bool)
    coded &= ~hit
    if wide:
        k = np.minimum(kind, len(first) - 1)
        plain = ((extra[k] << 32) + (ids - first[k])).astype(np.uint64)
    else:
        plain = _PLAIN.take(ids)
    plain *= coded
    plain[-1, short:] = 0
    return code, symbol, _packed(plain, 32 if wide else 12)


def _coded(code: np.ndarray, symbol: np.ndarray, sizes: np.ndarray, wide: bool) -> list[bytes]:
    """The range coder of all lanes in lockstep, over what _modelled() found, now [step, lane]. Only the last lane may be short.

    A step narrows a lane's interval to a part between two shares, then, for order 0, to a symbol's span; lanes that need no span have the
    whole one. Carries are settled at the end.
    """
    (steps, lanes), symbols = code.shape, 2 * len(_classes(wide)[0])
    model = _Model(lanes, symbols)
    in_code, in_symbols = np.arange(lanes) << 6, np.arange(lanes) * (symbols + 2)
    low, rng = np.zeros(lanes), np.full(lanes, _WHOLE)
    digits = np.empty((steps + 3, lanes), np.int32)  # -1 for none
    part, of, narrow = np.empty(lanes), np.empty(lanes), np.empty(lanes, bool)
    due, short, scales = 0, int(sizes[-1]), np.array([2.0**-_PLACE, 1.0, 1.0, 1.0])
    for begin in range(0, steps, 8):
        if begin == due:
            if begin:
                model.saw(code[seen:begin], symbol[seen:begin])
            seen, due = begin, begin + min(max(8, begin), _RENEW)
            shares, spans, _ = model.renew()
            edges = np.zeros((lanes, 16, 4), np.complex128)  # from and to, by which of the orders is right
            edges[:, :, 0] = shares.imag.reshape(lanes, 16) + 1j
            edges[:, :, 1] = shares.reshape(lanes, 16)
            edges.imag[:, :, 2] = edges.imag[:, :, 3] = shares.real.reshape(lanes, 16)
            edges = edges.ravel()
        end = min(begin + 8, steps)
        outcome, place = code[begin:end] + in_code, symbol[begin:end] + in_symbols
        both, span, scale = edges.take(outcome), spans.take(place), scales.take(code[begin:end] & 3)
        start, width = (span >> _PLACE + 1).astype(np.float64), (span & ((2 << _PLACE) - 1)).astype(np.float64)
        lower, upper = np.ascontiguousarray(both.real), np.ascontiguousarray(both.imag)
        if end > short:  # a lane that has ended stays as it is
            lower[max(short - begin, 0) :, -1], start[max(short - begin, 0) :, -1] = 0, 0
            for x in (upper, scale, width):
                x[max(short - begin, 0) :, -1] = 1
        for k in range(end - begin):
            if begin + k == short:
                rng[-1] = _WHOLE
            np.floor(np.multiply(lower[k], rng, out=part), out=part)
            np.floor(np.multiply(upper[k], rng, out=rng), out=rng)
            rng -= part
            low += part
            rng *= scale[k]
            np.floor(rng, out=rng)
            low += np.multiply(rng, start[k], out=part)
            rng *= width[k]
            # a digit off where the interval is narrow
            np.less(rng, _NARROW, out=narrow)
            np.floor(np.multiply(low, 1 / _NARROW, out=part), out=part)
            part *= narrow
            np.multiply(narrow, _DIGIT - 1, out=of)
            of += 1
            low -= part * _NARROW
            low *= of
            rng *= of
            part -= ~narrow
            digits[begin + k] = part
    for k in range(3):
        digits[steps + k] = np.floor(low * (1 / _NARROW))
        low = (low - digits[steps + k] * _NARROW) * _DIGIT
    return [x for at in range(0, lanes, 256) for x in _settled(np.ascontiguousarray(digits[:, at : at + 256].T))]


def _settled(digits: np.ndarray) -> list[bytes]:
    """Digits of each lane, three bytes each, after their carries."""
    given = digits >= 0
    ends = 3 * np.cumsum(given.sum(1))
    out = digits[given]
    at = np.flatnonzero(out >> 24)
    while len(at):
        out[at] &= 0xFFFFFF
        np.add.at(out, at - 1, 1)
        at = np.unique(at - 1)
        at = at[out[at] >> 24 > 0]
    raw = out.astype(">i4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def encode_blocks(ids: np.ndarray, wide: bool, group: int = 32) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Sizes, coded and plain bytes of the blocks of a run of ids: RUN blocks are coded at a time, and a group of those is modelled at a time."""
    n = -(-len(ids) // BLOCK)
    sizes, coded, plain = np.full(n, BLOCK, np.int64), [], []
    if n:
        sizes[-1] = len(ids) - BLOCK * (n - 1)
    run = -(-n // max(1, -(-n // RUN)))
    for begin in range(0, n, max(1, run)):
        size = sizes[begin : begin + run]
        lanes, steps = len(size), int(size[0])
        code, symbol = np.empty((steps, lanes), np.uint8), np.empty((steps, lanes), np.uint16 if wide else np.uint8)
        for at in range(0, lanes, group):
            many = min(group, lanes - at)
            part = ids[(begin + at) * BLOCK : (begin + at + many) * BLOCK]
            if len(part) < many * steps:  # the rest of a short block, which is cut off
                part = np.concatenate([part, np.zeros(many * steps - len(part), part.dtype)])
            c, y, bits = _modelled(part.reshape(many, steps), wide, int(size[at + many - 1]))
            code[:, at : at + many], symbol[:, at : at + many] = c.T, y.T
            plain += bits
        coded += _coded(code, symbol, size, wide)
    return sizes, coded, plain


def write_segment(doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> bytes:
    """Of documents: their ids, null marks, numbers of tokens and all token ids in a row (unsigned 32 bits)."""
    wide = bool(len(flat) and flat.max() > 0xFFFF)
    flat = np.ascontiguousarray(flat, "<u4")
    checks = [crc(flat[k : k + BLOCK].tobytes()) for k in range(0, len(flat), BLOCK)]
    if not wide:  # held in half the room while blocks are coded
        flat = flat.astype(np.uint16)
    sizes, coded, plain = encode_blocks(flat, wide)
    tables = [doc_ids.astype("<i8"), null.astype("u1"), counts.astype("<u4"), sizes.astype("<u4"), *(np.array([len(x) for x in part], "<u4") for part in (coded, plain)), np.array(checks, "<u4")]
    tables = b"".join(x.tobytes() for x in tables)
    head = MAGIC + np.array([WIDE * wide, len(doc_ids), len(sizes), crc(tables)], "<u4").tobytes()
    return b"".join([head, tables, *coded, *plain])


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their null marks, numbers of tokens, and all ids. ValueError if a checksum does not hold."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    flags, docs, blocks, check = np.frombuffer(data, "<u4", 4, 4).tolist()
    size = docs * 13 + blocks * 16
    tables = data[20 : 20 + size]
    if len(tables) != size or crc(tables) != check:
        raise ValueError("the tables of a token segment are damaged")
    at = 0
    parts = []
    for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), *[("<u4", blocks)] * 4):
        parts.append(np.frombuffer(tables, kind, n, at))
        at += n * np.dtype(kind).itemsize
    doc_ids, null, counts, sizes, coded, plain, checks = parts
    flat = np.zeros(0, "<u4")
    if blocks:
        bounds = (20 + size + np.concatenate([[0], np.cumsum(np.concatenate([coded, plain]), dtype=np.int64)])).tolist()
        pieces = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        grid = _decoded(_Decoder(pieces[:blocks], pieces[blocks:], bool(flags & WIDE)), sizes.astype(np.int64), bool(flags & WIDE))
        flat = np.empty((blocks, len(grid)), "<u4")
        flat[:] = grid.T
        flat = flat.ravel()[: int(sizes.sum())]  # only the last block may be short
    for k, c in enumerate(checks.tolist()):
        if crc(flat[k * BLOCK : (k + 1) * BLOCK].tobytes()) != c:
            raise ValueError(f"block {k} of a token segment is damaged")
    return doc_ids, null.astype(bool), counts, flat


def write_files(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the segments of docs in ascending order of doc_id (nulls first, equal ids by text) and returns them as rows
    (part, segment, n_ids, data), read back from the shared folder."""
    path = vocabulary_path or default_path("byte_bpe_50k.json")
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0

    def run(batches):
        from pyspark import TaskContext

        here, segment = TaskContext.get().partitionId(), 0
        doc_ids, null, counts, ids, n = [], [], [], [], 0

        def flush():
            nonlocal segment, doc_ids, null, counts, ids, n
            held = [np.concatenate(x) for x in (doc_ids, null, counts, ids)]
            ids = []
            data = write_segment(*held[:3], held.pop())
            row = pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([segment], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["part", "segment", "n_ids", "data"])
            segment, doc_ids, null, counts, ids, n = segment + 1, [], [], [], [], 0
            return row

        for batch in batches:
            for part in slices(batch, limit=TEXT_BYTES):
                column = part.column("doc_id")
                doc_ids.append(column.fill_null(0).to_numpy(zero_copy_only=False))
                null.append(column.is_null().to_numpy(zero_copy_only=False))
                flat, many = with_end(*text_ids(part.column("text"), path, split=False), end_id)
                ids.append(flat)
                counts.append(many)
                n += len(flat)
                if n >= BLOCK * LANES - BLOCK * LANES // 8:
                    yield flush()
        if ids:
            yield flush()

    ranged = doc_text(docs).repartitionByRange(max(1, -(-total // FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ranged.mapInArrow(run, "part int, segment int, n_ids long, data binary"), "token-files", "none")


def read_files(files: DataFrame) -> DataFrame:
    """Per document of written segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, null, counts, flat = read_segment(batch.column("data")[k].as_py())
                bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                raw = flat.tobytes()
                checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                rows = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("part")[k].as_py()] * rows, pa.int32()), pa.array([batch.column("segment")[k].as_py()] * rows, pa.int32()), pa.array(doc_ids, pa.int64(), mask=null), pa.array(bounds[:-1]), pa.array(counts.astype(np.int64)), pa.array(checks, pa.int64())],
                    names=["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    # sums of ids before each segment, in two levels: over stretches of 1024 files, then within each
    sizes = files.select("part", "segment", "n_ids", F.floor(F.col("part") / 1024).alias("stretch"))
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = sizes.groupBy("stretch").agg(F.sum("n_ids").alias("n")).select("stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("far"))
    within = Window.partitionBy("stretch").orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("near", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(stretches, "stretch").select("part", "segment", (F.col("far") + F.col("near")).alias("base"))
    rows = files.select("part", "segment", "data").mapInArrow(run, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base.hint("shuffle_merge"), ["part", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 2) -> DataFrame:
    """write_files() and read_files(): a row for each row of docs.

    A null text counts as empty: only the end id. Null ids, repeated rows, very long texts, an empty table and clashing extra
    columns are allowed.
    """
    return read_files(write_files(docs, vocabulary_path, end_id))
