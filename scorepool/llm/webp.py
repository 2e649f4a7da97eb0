"""Lossless WebP: a reader of the VP8L bit stream and a writer for media columns, after the public format specification.

`decode` takes any VP8L image: prefix codes, back-references, colour cache, prefix groups, and the predictor, cross-colour,
subtract-green and palette transforms. `decode_many` reads many images in lockstep, one lane each, when they are plain (a
palette of more than 16 colours, with a predictor over it or without, or no transform; one code for green, one for distances,
constant other channels), and hands the rest to `decode`. `encode` writes one image with chosen features; `encode_tiles` writes
many plain tiles at once, with a palette each, back-references, and a predictor where it helps.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scorepool.llm.common import crc, doc_text, materialise, slices, utf8

# --- fixed values of the format ----------------------------------------------------------------------------------

CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Distance codes 1 to 120 as (columns left, rows up).
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
GREEN, DISTANCES = 256 + 24, 40
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


# --- bits and prefix codes ---------------------------------------------------------------------------------------


class Reader:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.value, self.at, self.end = int.from_bytes(data, "little"), 0, 8 * len(data)
        self.words = data + bytes(16)

    def read(self, n: int) -> int:
        at = self.at
        if at + n > self.end:
            raise ValueError("the image ends too early")
        self.at += n
        return (int.from_bytes(self.words[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)) & ((1 << n) - 1)


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


def code_lengths(counts: list[int], most: int = 15) -> list[int]:
    """Huffman code lengths of at most `most` bits; counts are flattened until they fit."""
    used = [s for s, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    if len(used) == 1:
        lengths[used[0]] = 1
    if len(used) < 2:
        return lengths
    weight = {s: counts[s] for s in used}
    while True:
        heap = [(w, s, k) for k, (s, w) in enumerate(weight.items())]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        for node in range(len(used), 2 * len(used) - 1):
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[2]] = parent[b[2]] = node
            heapq.heapreplace(heap, (a[0] + b[0], min(a[1], b[1]), node))
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth) <= most:
            for k, s in enumerate(used):
                lengths[s] = depth[k]
            return lengths
        weight = {s: (w + 1) // 2 + 1 for s, w in weight.items()}


def _reversed(value: int, bits: int) -> int:
    return int(f"{value:0{bits}b}"[::-1], 2) if bits else 0


#: Numbers of 15 bits, turned.
_TURNED = [_reversed(k, 15) for k in range(1 << 15)]


def codes(lengths: list[int]) -> list[int]:
    """Canonical codes, each with its first bit lowest."""
    out, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = _TURNED[code] >> (15 - n)
        code += 1
    return out


class Code:
    """A prefix code for reading: a table by the next `bits` bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            raise ValueError("a prefix code without symbols")
        self.only = used[0] if len(used) == 1 else None
        if self.only is not None:
            return
        if sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
            raise ValueError("a prefix code that is not complete")
        self.bits = max(lengths)
        self.table = [0] * (1 << self.bits)
        for s, c in enumerate(codes(lengths)):
            if lengths[s]:
                for k in range(c, 1 << self.bits, 1 << lengths[s]):
                    self.table[k] = (s << 4) | lengths[s]

    def read(self, r: Reader) -> int:
        if self.only is not None:
            return self.only
        at = r.at
        e = self.table[(int.from_bytes(r.words[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)) & ((1 << self.bits) - 1)]
        r.at += e & 15
        if r.at > r.end:
            raise ValueError("the image ends too early")
        return e >> 4


def read_lengths(r: Reader, alphabet: int) -> list[int]:
    lengths = [0] * alphabet
    if r.read(1):  # one or two symbols, written out
        two = r.read(1)
        lengths[r.read(8 if r.read(1) else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return lengths
    own = [0] * 19
    for k in range(4 + r.read(4)):
        own[CODE_LENGTH_ORDER[k]] = r.read(3)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    code, at, last = Code(own), 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(r)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
        else:
            n, value = (3 + r.read(2), last) if s == 16 else (3 + r.read(3), 0) if s == 17 else (11 + r.read(7), 0)
            if at + n > alphabet:
                raise ValueError("code lengths run over the alphabet")
            lengths[at : at + n] = [value] * n
            at += n
    return lengths


def write_lengths(w: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if not used or (len(used) <= 2 and used[-1] < 256 and all(lengths[s] == 1 for s in used)):
        w.put(1, 1)
        w.put(int(len(used) == 2), 1)
        w.put(1, 1)
        for s in used or [0]:
            w.put(s, 8)
        return
    runs = []
    for value, same in groupby(lengths):  # (symbol, extra value, extra bits)
        n = len(list(same))
        if value == 0:
            while n >= 11:
                m = min(n, 138)
                runs.append((18, m - 11, 7))
                n -= m
            if n >= 3:
                runs.append((17, n - 3, 3))
                n = 0
        else:
            runs.append((value, 0, 0))
            n -= 1
            while n >= 3:
                m = min(n, 6)
                runs.append((16, m - 3, 2))
                n -= m
        runs += [(value, 0, 0)] * n
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    own = code_lengths(counts, 7)
    w.put(0, 1)
    many = max(4, max(k for k, s in enumerate(CODE_LENGTH_ORDER) if own[s]) + 1)
    w.put(many - 4, 4)
    for k in range(many):
        w.put(own[CODE_LENGTH_ORDER[k]], 3)
    w.put(0, 1)  # the whole alphabet
    c, single = codes(own), sum(n > 0 for n in own) == 1
    for s, extra, bits in runs:
        w.put(c[s], 0 if single else own[s])
        w.put(extra, bits)


def prefix_of(value: int) -> tuple[int, int, int]:
    """A length or distance as (prefix symbol, extra value, extra bits)."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    bits = v.bit_length() - 2
    return 2 * bits + 2 + ((v >> bits) & 1), v & ((1 << bits) - 1), bits


def value_of(symbol: int, r: Reader) -> int:
    if symbol < 4:
        return symbol + 1
    bits = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << bits) + r.read(bits) + 1


def distance_of(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# --- one image, every feature ------------------------------------------------------------------------------------


def _image_data(r: Reader, width: int, height: int, outer: bool) -> list[int]:
    """An entropy-coded image as ARGB integers."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of too many bits")
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift, group_of, across, bits = 32 - cache_bits, None, 0, 0
    if outer and r.read(1):
        bits = 2 + r.read(3)
        across = -(-width // (1 << bits))
        group_of = [(p >> 8) & 0xFFFF for p in _image_data(r, across, -(-height // (1 << bits)), False)]
    groups = []
    for _ in range(max(group_of) + 1 if group_of else 1):
        groups.append([Code(read_lengths(r, n)) for n in (GREEN + (len(cache) if cache else 0), 256, 256, 256, DISTANCES)])
    out, total, group = [], width * height, groups[0]
    while len(out) < total:
        if group_of:
            group = groups[group_of[(len(out) // width >> bits) * across + (len(out) % width >> bits)]]
        s = group[0].read(r)
        if s < 256:
            red = group[1].read(r)
            blue = group[2].read(r)
            new = [(group[3].read(r) << 24) | (red << 16) | (s << 8) | blue]
        elif s < GREEN:
            n = value_of(s - 256, r)
            d = distance_of(value_of(group[4].read(r), r), width)
            if d > len(out) or len(out) + n > total:
                raise ValueError("a reference beyond the image")
            new = []
            for k in range(n):
                new.append(out[len(out) - d + k] if k < d else new[k - d])
        else:
            if not cache or s - GREEN >= len(cache):
                raise ValueError("a colour cache index beyond the cache")
            new = [cache[s - GREEN]]
        out += new
        if cache:
            for p in new:
                cache[((CACHE_FACTOR * p) & 0xFFFFFFFF) >> shift] = p
    return out


def _add(a: int, b: int) -> int:
    return (((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00) | (((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF)


def _subtract(a: int, b: int) -> int:
    out = 0
    for k in (0, 8, 16, 24):
        out |= (((a >> k) - (b >> k)) & 255) << k
    return out


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, (p >> 16) & 255, (p >> 8) & 255, p & 255


def _joined(parts) -> int:
    a, r, g, b = (min(255, max(0, x)) for x in parts)
    return (a << 24) | (r << 16) | (g << 8) | b


def predicted(mode: int, left: int, top: int, top_left: int, top_right: int) -> int:
    if mode == 0 or mode > 13:
        return 0xFF000000
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, top_right), top)
    if mode < 8:
        return _mean(left, (top_left, top)[mode - 6])
    if mode < 10:
        return _mean(top, (top_left, top_right)[mode - 8])
    if mode == 10:
        return _mean(_mean(left, top_left), _mean(top, top_right))
    if mode == 11:  # the neighbour nearer to the gradient's estimate
        l, t, tl = _parts(left), _parts(top), _parts(top_left)
        to_left = sum(abs(t[k] - tl[k]) for k in range(4))
        to_top = sum(abs(l[k] - tl[k]) for k in range(4))
        return left if to_left < to_top else top
    if mode == 12:
        return _joined(l + t - tl for l, t, tl in zip(_parts(left), _parts(top), _parts(top_left), strict=True))
    mean = _parts(_mean(left, top))
    return _joined(m + int((m - tl) / 2) for m, tl in zip(mean, _parts(top_left), strict=True))


def _neighbours(pixels: list[int], i: int, width: int) -> tuple[int, int, int, int]:
    # the pixel right of a row's end is the leftmost one of the row itself, as the two adjoin in memory
    return pixels[i - 1], pixels[i - width], pixels[i - width - 1], pixels[i - width + 1]


def _prediction(pixels: list[int], i: int, width: int, modes: list[int], bits: int, across: int) -> int:
    if i == 0:
        return 0xFF000000
    x, y = i % width, i // width
    if y == 0:
        return pixels[i - 1]
    if x == 0:
        return pixels[i - width]
    return predicted((modes[(y >> bits) * across + (x >> bits)] >> 8) & 15, *_neighbours(pixels, i, width))


def _signed(x: int) -> int:
    return x - 256 if x > 127 else x


def _shade(p: int, element: int, back: bool) -> int:
    """Cross-colour of one pixel: back to the original, or away from it."""
    _, to_blue_from_red, to_blue, to_red = _parts(element)
    a, r, g, b = _parts(p)
    delta = lambda t, c: (_signed(t) * _signed(c)) >> 5
    sign = 1 if back else -1
    new_r = (r + sign * delta(to_red, g)) & 255
    original_r = new_r if back else r
    new_b = (b + sign * (delta(to_blue, g) + delta(to_blue_from_red, original_r))) & 255
    return (a << 24) | (new_r << 16) | (g << 8) | new_b


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _body(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    return data[20 : 20 + int.from_bytes(data[16:20], "little")]


def _to_array(pixels: list[int], width: int, height: int) -> np.ndarray:
    p = np.array(pixels, np.uint32).reshape(height, width)
    return np.stack([(p >> 16) & 255, (p >> 8) & 255, p & 255, p >> 24], 2).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Rows x columns x RGBA of a lossless WebP file. ValueError for a file that breaks the format."""
    r = Reader(_body(data))
    if r.read(8) != 0x2F:
        raise ValueError("not a lossless WebP file")
    full, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("an unknown version")
    width, transforms = full, []
    while r.read(1):
        kind = r.read(2)
        if kind in [t[0] for t in transforms]:
            raise ValueError("a transform given twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = 2 + r.read(3)
            across = -(-width // (1 << bits))
            transforms.append((kind, width, bits, across, _image_data(r, across, -(-height // (1 << bits)), False)))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, width, 0, 0, []))
        else:
            table = _image_data(r, size := r.read(8) + 1, 1, False)
            for k in range(1, size):
                table[k] = _add(table[k], table[k - 1])
            bits = _bundle_bits(size)
            transforms.append((kind, width, bits, 0, table))
            width = -(-width // (1 << bits))
    pixels = _image_data(r, width, height, True)
    for kind, width, bits, across, side in reversed(transforms):
        if kind == PREDICTOR:
            for i in range(len(pixels)):
                pixels[i] = _add(pixels[i], _prediction(pixels, i, width, side, bits, across))
        elif kind == CROSS_COLOUR:
            pixels = [_shade(p, side[(i // width >> bits) * across + (i % width >> bits)], True) for i, p in enumerate(pixels)]
        elif kind == SUBTRACT_GREEN:
            pixels = [(p & 0xFF00FF00) | (((p & 0x00FF00FF) + ((p >> 8) & 255) * 0x10001) & 0x00FF00FF) for p in pixels]
        else:
            per, depth, packed = 1 << bits, 8 >> bits, -(-width // (1 << bits))
            look = lambda k, side=side: side[k] if k < len(side) else 0
            pixels = [look(((pixels[y * packed + (x >> bits)] >> 8) >> (depth * (x & (per - 1)))) & ((1 << depth) - 1)) for y in range(height) for x in range(width)]
    return _to_array(pixels, full, height)


@dataclass
class Features:
    """What `encode` uses. References go `distance` pixels back wherever at least four pixels repeat."""

    predictor: int | None = None
    cross_colour: int | None = None
    subtract_green: bool = False
    palette: bool = False
    cache_bits: int = 0
    distances: tuple[int, ...] = field(default_factory=tuple)
    block_bits: int = 2


def _write_image(w: Writer, pixels: list[int], width: int, cache_bits: int = 0, distances: tuple[int, ...] = (), outer: bool = False) -> None:
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if outer:
        w.put(0, 1)  # one group
    cache: list[int | None] = [None] * (1 << cache_bits)
    near = {distance_of(k + 1, width): k + 1 for k in reversed(range(len(NEAR)))}
    events, i = [], 0  # lists of (alphabet, symbol, extra value, extra bits)
    while i < len(pixels):
        best, far = 0, 0
        for d in distances:
            n = 0
            while d <= i and n < 4096 and i + n < len(pixels) and pixels[i + n] == pixels[i + n - d]:
                n += 1
            if n > best:
                best, far = n, d
        slot = ((CACHE_FACTOR * pixels[i]) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if best >= 4:
            length, away = prefix_of(best), prefix_of(near.get(far, far + len(NEAR)))
            events.append([(0, 256 + length[0], *length[1:]), (4, *away)])
        elif cache_bits and cache[slot] == pixels[i]:
            events.append([(0, GREEN + slot, 0, 0)])
            best = 1
        else:
            a, r, g, b = _parts(pixels[i])
            events.append([(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)])
            best = 1
        for p in pixels[i : i + best]:
            if cache_bits:
                cache[((CACHE_FACTOR * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        i += best
    counts = [[0] * n for n in (GREEN + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)]
    for e in events:
        for k, s, _, _ in e:
            counts[k][s] += 1
    lengths = [code_lengths(c) for c in counts]
    for n in lengths:
        write_lengths(w, n)
    table = [codes(n) for n in lengths]
    single = [sum(x > 0 for x in n) < 2 for n in lengths]
    for e in events:
        for k, s, extra, bits in e:
            w.put(table[k][s], 0 if single[k] else lengths[k][s])
            w.put(extra, bits)


def _framed(body: bytes) -> bytes:
    return b"RIFF" + (12 + len(body) + len(body) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + bytes(len(body) % 2)


def encode(image: np.ndarray, use: Features | None = None) -> bytes:
    """A lossless WebP file of rows x columns x RGBA."""
    use = use or Features()
    height, width = image.shape[:2]
    x = image.astype(np.uint32)
    pixels = ((x[..., 3] << 24) | (x[..., 0] << 16) | (x[..., 1] << 8) | x[..., 2]).ravel().tolist()
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    full, bits = width, use.block_bits
    blocks = lambda: -(-width // (1 << bits)) * -(-height // (1 << bits))
    if use.palette:
        table = sorted(set(pixels))
        if len(table) > 256:
            raise ValueError("too many colours for a palette")
        w.put(1 | PALETTE << 1, 3)
        w.put(len(table) - 1, 8)
        _write_image(w, [_subtract(p, table[k - 1]) if k else p for k, p in enumerate(table)], len(table))
        index, b = {p: k for k, p in enumerate(table)}, _bundle_bits(len(table))
        width = -(-full // (1 << b))
        packed = [0xFF000000] * (width * height)
        for i, p in enumerate(pixels):
            y, c = divmod(i, full)
            packed[y * width + (c >> b)] |= index[p] << (8 + (8 >> b) * (c & ((1 << b) - 1)))
        pixels = packed
    if use.subtract_green:
        w.put(1 | SUBTRACT_GREEN << 1, 3)
        pixels = [(p & 0xFF00FF00) | (((p >> 16) - (p >> 8) & 255) << 16) | (p - (p >> 8) & 255) for p in pixels]
    if use.predictor is not None:
        w.put(1 | PREDICTOR << 1, 3)
        w.put(bits - 2, 3)
        across = -(-width // (1 << bits))
        modes = [0xFF000000 | use.predictor << 8] * blocks()
        _write_image(w, modes, across)
        pixels = [_subtract(p, _prediction(pixels, i, width, modes, bits, across)) for i, p in enumerate(pixels)]
    if use.cross_colour is not None:
        w.put(1 | CROSS_COLOUR << 1, 3)
        w.put(bits - 2, 3)
        _write_image(w, [0xFF000000 | use.cross_colour] * blocks(), -(-width // (1 << bits)))
        pixels = [_shade(p, 0xFF000000 | use.cross_colour, False) for p in pixels]
    w.put(0, 1)
    _write_image(w, pixels, width, use.cache_bits, use.distances, outer=True)
    return _framed(w.bytes())


# --- many plain tiles --------------------------------------------------------------------------------------------

WIDTH = 64
#: Payload bytes of a tile: 64 x 64 samples, one in the green channel of each pixel.
TILE = WIDTH * 64
#: Longest prefix code of plain tiles.
PLAIN_BITS = 11
#: Longest prefix code of their distances, fewest pixels of a back-reference, and bits of a tile's table of earlier places.
DISTANCE_BITS = 9
_MATCH = 6
_TABLE = 12
#: A predictor's block that covers a tile.
_BLOCK_BITS = 9
LEFT, TOP = 1, 2

_TURN = {bits: np.array([_reversed(k, bits) for k in range(1 << bits)]) for bits in (7, 8, PLAIN_BITS, DISTANCE_BITS)}
#: Symbol, extra value and its bits of each length and distance code, and the distance codes of tiles.
_PREFIX = np.array([(0, 0, 0)] + [prefix_of(v) for v in range(1, TILE + len(NEAR) + 1)]).T
_NEAR_CODE = np.arange(TILE + 1) + len(NEAR)
for _k in reversed(range(len(NEAR))):
    if distance_of(_k + 1, WIDTH) <= TILE:
        _NEAR_CODE[distance_of(_k + 1, WIDTH)] = _k + 1


#: Fewest colours of a tile's palette; with fewer, several pixels would share a byte.
_COLOURS = 17


def _palette_head() -> tuple[int, int]:
    """Bits before a tile's palette and their number: any byte of green in eight bits, no red and blue, alpha as one of 0 and 255."""
    w = Writer()
    w.put(0, 1)  # no colour cache
    write_lengths(w, [8] * 256 + [0] * 24)
    for lengths in ([1] + [0] * 255, [1] + [0] * 255, [1] + [0] * 254 + [1], [1] + [0] * (DISTANCES - 1)):
        write_lengths(w, lengths)
    return w.value, w.n


_HEAD, _HEAD_BITS = _palette_head()
#: Bits of a colour: its step from the last one in green, then whether its alpha is 255 more, as it is of the first.
_ENTRY = 9


def _read_palette(r: Reader) -> np.ndarray | None:
    """Green of all indices after a palette transform's mark; null if it is not of the form that encode_tiles() writes."""
    size = r.read(8) + 1
    bits = _HEAD_BITS + _ENTRY * size
    held = (r.value >> r.at) & ((1 << bits) - 1)
    if size < _COLOURS or held & ((1 << _HEAD_BITS) - 1) != _HEAD or r.at + bits > r.end:
        return None
    r.at += bits
    entry = np.frombuffer((held >> _HEAD_BITS).to_bytes(-(-_ENTRY * size // 8), "little"), np.uint8)
    entry = np.unpackbits(entry, bitorder="little")[: _ENTRY * size].reshape(size, _ENTRY)
    if entry[0, 8] != 1 or entry[1:, 8].any():
        return None
    out = np.zeros(256, np.uint8)
    out[:size] = np.cumsum(np.packbits(entry[:, :8], axis=1)[:, 0], dtype=np.uint8)
    return out


def _predictor_head(mode: int) -> tuple[int, int]:
    """Bits of a predictor transform of one mode for the whole tile, and their number."""
    w = Writer()
    w.put(1 | PREDICTOR << 1, 3)
    w.put(_BLOCK_BITS - 2, 3)
    _write_image(w, [0xFF000000 | mode << 8], 1)
    return w.value, w.n


_PREDICTOR_HEADS = {mode: _predictor_head(mode) for mode in (LEFT, TOP)}


def _residuals(data: np.ndarray, first_rows: np.ndarray) -> dict[int, np.ndarray]:
    """What predictors leave of tiles in a row: LEFT's and TOP's. A tile's first row is always predicted from the left, its first column from above."""
    rows = data.reshape(-1, WIDTH)
    down = rows.copy()
    down[1:] -= rows[:-1]
    down[first_rows] = rows[first_rows]
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    left[:, 0] = down[:, 0]
    down[first_rows] = left[first_rows]
    return {LEFT: left.ravel(), TOP: down.ravel()}


def _restored(left_over: np.ndarray, mode: int) -> np.ndarray:
    """Rows of a tile from what a predictor left of them."""
    out = left_over.copy()
    if mode == LEFT:
        out[:, 0] = np.cumsum(out[:, 0], dtype=np.uint8)
        return np.cumsum(out, axis=1, dtype=np.uint8)
    out[0] = np.cumsum(out[0], dtype=np.uint8)
    return np.cumsum(out, axis=0, dtype=np.uint8)


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of each row's symbols by their own frequencies."""
    log = lambda x: x * np.log2(np.maximum(x, 1))
    return log(counts.sum(1)) - log(counts).sum(1)


def _earlier(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each place where _MATCH samples of a tile begin, a place before it in the tile where the same ones do, else -1. Tiles
    advance together, each with a table of the last place by a hash of its samples."""
    key = np.zeros(len(data), np.uint64)
    for k in range(_MATCH):
        key[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE)).astype(np.int32)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    places, at = size[order] - _MATCH + 1, offsets[:-1][order]
    table, row = np.full(len(size) << _TABLE, -1, np.int16), np.arange(len(size)) << _TABLE
    before, live = np.full(len(data), -1, np.int16), len(size)  # as places in the tile
    for step in range(int(places[0])):
        if places[live - 1] <= step:
            live = int(np.searchsorted(-places, -step, side="left"))
            at, row = at[:live], row[:live]
        cell = slot.take(at)
        cell = cell + row
        before[at] = table.take(cell)
        table[cell] = step
        at = at + 1
    before = np.where(before < 0, -1, before + np.repeat(offsets[:-1], size))
    before[key[before] != key] = -1
    return before


def references(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references of tiles in a row: first places, lengths and distances, in order and apart. Each begins at the first place not
    yet covered where samples repeat, and runs while its distance holds."""
    before = _earlier(data, offsets)
    distance = np.where(before >= 0, np.arange(len(data)) - before, 0)
    change = np.diff(distance, prepend=0, append=0) != 0
    change[offsets] = True  # a run ends with its tile
    change = np.flatnonzero(change)
    first, last = change[:-1], change[1:] - 1
    held = distance[first] > 0
    first, last = first[held], last[held]
    after, taken, k = np.searchsorted(last, last + _MATCH).tolist(), [], 0
    while k < len(last):
        taken.append(k)
        k = after[k]
    first, last = first[taken], last[taken]
    start = np.maximum(first, np.concatenate([[0], last[:-1] + _MATCH])[: len(first)])
    return start, last + _MATCH - start, distance[start]


# --- prefix codes and bits of many tiles, in lockstep -----------------------------------------------------------


def lengths_of(counts: np.ndarray, most: int) -> np.ndarray:
    """code_lengths() of each row of counts, in lockstep: the two lightest nodes are at the front of the sorted symbols or of the joined ones."""
    n, m = counts.shape
    out = np.zeros((n, m), np.int64)
    used = np.count_nonzero(counts, axis=1)
    out[used == 1] = counts[used == 1] > 0
    rows = np.flatnonzero(used > 1)
    rows = rows[np.argsort(-used[rows], kind="stable")]
    weight = counts[rows].astype(np.int64)
    while len(rows):
        depth = _depths(weight, used[rows])
        fits = depth.max(axis=1) <= most
        out[rows[fits]] = depth[fits]
        rows, weight = rows[~fits], weight[~fits]
        weight = np.where(weight > 0, (weight + 1) // 2 + 1, 0)
    return out


def _depths(weight: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Depths of used symbols in the rows' Huffman trees; rows by the number of their symbols, most first, two at least."""
    n, m = weight.shape
    none = np.int64(1) << 40
    order = np.argsort(np.where(weight > 0, weight, none), axis=1, kind="stable")
    wide = int(used[0])
    # a row's leaves, then its joined nodes; both are sorted, and a queue's end is heavier than all
    leaf = np.full((n, wide + 1), none)
    leaf[:, :wide] = np.take_along_axis(np.where(weight > 0, weight, none), order[:, :wide], 1)
    joined = np.full((n, wide + 1), none)
    leaf, joined = leaf.ravel(), joined.ravel()
    parent = np.zeros(2 * n * (wide + 1), np.int64)
    base, far = np.arange(n) * (wide + 1), n * (wide + 1)
    a, b, live = base.copy(), base.copy(), n
    for step in range(wide - 1):
        if used[live - 1] - 1 <= step:
            live = int(np.searchsorted(-used, -step - 1, side="left"))
            a, b = a[:live], b[:live]
        total = 0
        for _ in range(2):
            la, lb = leaf.take(a), joined.take(b)
            first = la <= lb
            parent[np.where(first, a, b + far)] = step
            total = total + np.minimum(la, lb)
            a = a + first
            b = b + ~first
        joined[base[:live] + step] = total
    above = parent[far:].reshape(n, -1)
    depth = np.zeros((n, wide + 1), np.int64)
    for step in range(wide - 3, -1, -1):
        live = int(np.searchsorted(-used, -step - 2, side="left"))  # of these it isn't the root
        depth[:live, step] = depth[np.arange(live), above[:live, step]] + 1
    out = np.zeros((n, m), np.int64)
    own = np.take_along_axis(depth, parent[:far].reshape(n, -1)[:, :wide], 1) + 1
    own[np.arange(wide) >= used[:, None]] = 0
    np.put_along_axis(out, order[:, :wide], own, 1)
    return out


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's symbols in the order of their codes, unused ones last, and their lengths (99 for unused ones)."""
    keyed = np.where(lengths > 0, lengths, 99).astype(np.uint8)
    order = np.argsort(keyed, axis=1, kind="stable")
    return order, np.take_along_axis(keyed, order, 1).astype(np.int64)


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """codes() of each row."""
    order, size = _canonical(lengths)
    share = np.where(size < 99, 1 << np.maximum(15 - size, 0), 0)
    code = np.cumsum(share, axis=1) - share  # in units of the longest code
    out = np.zeros(lengths.shape, np.int64)
    np.put_along_axis(out, order, _TURNED_15[np.where(size < 99, code, 0) & 0x7FFF], 1)
    return out


_TURNED_15 = np.array(_TURNED)


def _tables(lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: symbol and length of the code that each of the next `bits` bits begin with, and whether its code is complete."""
    order, size = _canonical(lengths)
    single = size[:, 1] == 99
    size[single, 0] = 0
    held = size <= bits
    good = (np.where(held, 1 << np.maximum(bits - size, 0), 0).sum(1) == 1 << bits) & (order[:, 0] >= 0) & (held | (size == 99)).all(1) & lengths.any(1)
    held &= good[:, None]
    out = np.zeros((len(lengths), 1 << bits), np.int32)
    out[good] = np.repeat((order[held] << 4) | size[held], 1 << (bits - size[held])).reshape(-1, 1 << bits)[:, _TURN[bits]]
    return out, good


class _Parts:
    """Bits of many files: sections of (file, value, bits), each by files and in order, follow one another in every file."""

    def __init__(self, n: int):
        self.n, self.sections, self.total = n, [], np.zeros(n, np.int64)

    def put(self, who: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        sums = np.concatenate([[0], np.cumsum(bits)])
        ptr = np.searchsorted(who, np.arange(self.n + 1))
        self.sections.append((who, value.astype(np.uint64), bits, sums[:-1] + (self.total - sums[ptr[:-1]])[who]))
        self.total = self.total + sums[ptr[1:]] - sums[ptr[:-1]]

    def every(self, value: np.ndarray | int, bits: np.ndarray | int) -> None:
        """One value in each file."""
        every = np.arange(self.n)
        self.put(every, np.broadcast_to(np.asarray(value), self.n), np.broadcast_to(np.asarray(bits), self.n))

    def fixed(self, value: int, bits: int, who: np.ndarray) -> None:
        """The same bits in some files, however many."""
        for at in range(0, bits, 32):
            self.put(who, np.full(len(who), value >> at & 0xFFFFFFFF), np.full(len(who), min(32, bits - at)))

    def files(self) -> list[bytes]:
        begin = np.concatenate([[0], np.cumsum(-(-self.total // 64))]) * 64
        out = np.zeros(begin[-1] // 64 + 2, np.uint64)
        for who, value, bits, place in self.sections:
            if not len(who):
                continue
            place = place + begin[:-1][who]
            word, shift = place >> 6, (place & 63).astype(np.uint64)
            first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
            out[word[first]] |= np.add.reduceat(value << shift, first)  # bits never meet, so sums are unions
            over = np.flatnonzero((place & 63) + bits > 64)
            out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
        raw, begin = out.tobytes(), (begin // 8).tolist()
        return [raw[a : a + n] for a, n in zip(begin[:-1], (-(-self.total // 8)).tolist(), strict=True)]


_RUN_EXTRA = np.array([0] * 16 + [2, 3, 7])
_RUN_LEAST = np.array([1] * 16 + [3, 3, 11])


def _put_lengths(w: _Parts, lengths: np.ndarray) -> None:
    """write_lengths() of each row."""
    n, m = lengths.shape
    used = np.count_nonzero(lengths, axis=1)
    plain = (used <= 2) & ~(lengths > 1).any(1) & ~lengths[:, 256:].any(1)
    who = np.flatnonzero(plain)
    two = (used[who] == 2).astype(np.int64)
    first, last = np.argmax(lengths[who] > 0, axis=1), m - 1 - np.argmax(lengths[who, ::-1] > 0, axis=1)
    w.put(who, 0b101 | two << 1 | first << 3 | np.where(two > 0, last, 0) << 11, 11 + 8 * two)
    rows = np.flatnonzero(~plain)
    flat = lengths[rows].ravel()
    change = np.ones(len(flat), bool)
    change[1:] = flat[1:] != flat[:-1]
    change[::m] = True
    start = np.flatnonzero(change)
    value, many, own = flat[start], np.diff(start, append=len(flat)), start // m
    lead = (value > 0).astype(np.int64)  # a length is written out before it is repeated
    most = np.where(lead > 0, 6, 138)
    full, left = np.divmod(many - lead, most)
    part = left >= 3
    items = lead + full + np.where(part, 1, left)
    run = np.repeat(np.arange(len(items)), items)
    at = np.arange(len(run)) - np.repeat(np.cumsum(items) - items, items)
    at -= lead[run]
    whole, rest = (at >= 0) & (at < full[run]), (at == full[run]) & part[run]
    length = np.where(whole, most[run], np.where(rest, left[run], 1))
    symbol = np.where(whole | rest, np.where(lead[run] > 0, 16, np.where(length >= 11, 18, 17)), value[run])
    extra, own = length - _RUN_LEAST[symbol], own[run]
    lengths = lengths_of(np.bincount(own * 19 + symbol, minlength=len(rows) * 19).reshape(-1, 19), 7)
    code, bits = codes_of(lengths), np.where(np.count_nonzero(lengths, axis=1)[:, None] > 1, lengths, 0)
    listed = lengths[:, CODE_LENGTH_ORDER]
    listed_many = np.maximum(4, 19 - np.argmax(listed[:, ::-1] > 0, axis=1))
    w.put(rows, (listed_many - 4) << 1, np.full(len(rows), 5))
    within = np.arange(19) < listed_many[:, None]
    w.put(rows[np.nonzero(within)[0]], listed[within], np.full(within.sum(), 3))
    w.put(rows, np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64))  # the whole alphabet
    w.put(rows[own], np.where(bits[own, symbol] > 0, code[own, symbol], 0) | extra << bits[own, symbol], bits[own, symbol] + _RUN_EXTRA[symbol])


def encode_tiles(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A file for each stretch of data, of up to TILE bytes and a multiple of WIDTH: the tile's values are its palette, the pixels
    their places in it, predicted from the left or from above where that leaves fewer bits. What repeats is a back-reference."""
    n = len(offsets) - 1
    if not n:
        return []
    size = np.diff(offsets)
    tile_of = np.repeat(np.arange(n), size)
    present = np.bincount(tile_of * 256 + data, minlength=n * 256).reshape(n, 256) > 0
    data = (np.cumsum(present, axis=1) - 1).astype(np.uint8)[tile_of, data]
    best, mode = _entropy(np.bincount(tile_of * 256 + data, minlength=n * 256).reshape(n, 256)), np.zeros(n, np.int64)
    for m, left_over in _residuals(data, offsets[:-1] // WIDTH).items():
        bits = _entropy(np.bincount(tile_of * 256 + left_over, minlength=n * 256).reshape(n, 256)) + _PREDICTOR_HEADS[m][1]
        better = bits < best
        if better.any():
            best, mode = np.where(better, bits, best), np.where(better, m, mode)
    if mode.any():
        left_over = _residuals(data, offsets[:-1] // WIDTH)
        data = np.choose(mode[tile_of], [data, left_over[LEFT], left_over[TOP]])
    start, length, distance = references(data, offsets)
    whose = tile_of[start]
    (long, far), (long_extra, far_extra), (long_bits, far_bits) = (x[[length, _NEAR_CODE[distance]]] for x in _PREFIX)
    cover = np.zeros(len(data) + 1, np.int64)
    cover[start] += 1
    np.add.at(cover, start + length, -1)
    covered = np.cumsum(cover[:-1]) > 0
    literal = np.flatnonzero(~covered)
    counts = np.bincount(np.concatenate([tile_of[literal] * GREEN + data[literal], whose * GREEN + 256 + long]), minlength=n * GREEN).reshape(n, GREEN)
    distances = np.bincount(whose * DISTANCES + far, minlength=n * DISTANCES).reshape(n, DISTANCES)
    w = _Parts(n)
    w.every(0x2F | (WIDTH - 1) << 8 | (size // WIDTH - 1) << 22, 8 + 14 + 14 + 1 + 3)
    colours = present.sum(1)
    entries = np.maximum(colours, _COLOURS)  # padded by repeats of the last one
    w.every(1 | PALETTE << 1 | (entries - 1) << 3, 3 + 8)
    w.fixed(_HEAD, _HEAD_BITS, np.arange(n))
    who, value = np.nonzero(present)
    step = np.diff(value, prepend=0)
    first = np.cumsum(colours) - colours
    step[first] = value[first]
    listed = np.zeros((n, int(entries.max())), np.int64)
    listed[who, np.arange(len(who)) - first[who]] = _TURN[8][step]
    listed[:, 0] |= 256
    held = np.arange(listed.shape[1]) < entries[:, None]
    w.put(np.repeat(np.arange(n), entries), listed[held], np.full(int(entries.sum()), _ENTRY))
    for m, (value, bits) in _PREDICTOR_HEADS.items():
        w.fixed(value, bits, np.flatnonzero(mode == m))
    w.every(0, 3)  # no other transform, no colour cache, one group
    lengths = lengths_of(counts, PLAIN_BITS)
    _put_lengths(w, lengths)
    code, bits_of = codes_of(lengths), np.where(np.count_nonzero(counts, axis=1)[:, None] > 1, lengths, 0)
    w.every(0b101 | 0b101 << 11 | (0b101 | np.where(mode > 0, 0, 255) << 3) << 22, 33)  # red, blue, alpha
    lengths = lengths_of(distances, DISTANCE_BITS)
    _put_lengths(w, lengths)
    far_code, far_bits_of = codes_of(lengths), np.where(np.count_nonzero(distances, axis=1)[:, None] > 1, lengths, 0)
    code[bits_of == 0], far_code[far_bits_of == 0] = 0, 0
    # a reference is one value: its length's code and extra bits, then its distance's
    value, bits = code[whose, 256 + long], bits_of[whose, 256 + long]
    for part, many in ((long_extra, long_bits), (far_code[whose, far], far_bits_of[whose, far]), (far_extra, far_bits)):
        value = value | part << bits
        bits = bits + many
    own, symbol = tile_of[literal], data[literal]
    values, sizes = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    values[literal], sizes[literal] = code[own, symbol], bits_of[own, symbol]
    values[start], sizes[start] = value, bits
    covered[start] = False
    held = np.flatnonzero(~covered)
    w.put(tile_of[held], values[held], sizes[held])
    return [_framed(x) for x in w.files()]


@dataclass
class _Plain:
    width: int
    height: int
    first_bit: int
    lengths: list[int]
    fixed: tuple[int, ...]
    distances: list[int]
    palette: np.ndarray | None
    mode: int


def _plain(body: bytes) -> _Plain | None:
    """The header of an image with no more than a palette and a predictor of one mode over it, without cache or groups, of a green code
    within PLAIN_BITS, a distance code within DISTANCE_BITS and constant other channels."""
    r = Reader(body)
    if r.read(8) != 0x2F:
        return None
    width, height = r.read(14) + 1, r.read(14) + 1
    if r.read(4) >> 1:
        return None
    palette, mode = None, 0
    if r.read(1):
        if r.read(2) != PALETTE or (palette := _read_palette(r)) is None:
            return None
        if r.read(1):
            if r.read(2) != PREDICTOR or max(width, height) > 1 << (2 + r.read(3)):
                return None
            mode = (_image_data(r, 1, 1, False)[0] >> 8) & 15
            if mode not in (LEFT, TOP) or r.read(1):
                return None
    if r.read(2):
        return None
    lengths = read_lengths(r, GREEN)
    if not 0 < max(lengths) <= PLAIN_BITS:
        return None
    fixed = []
    for n in (256, 256, 256):
        own = read_lengths(r, n)
        used = [s for s, x in enumerate(own) if x]
        if len(used) != 1:
            return None
        fixed.append(used[0])
    distances = read_lengths(r, DISTANCES)
    return _Plain(width, height, r.at, lengths, tuple(fixed), distances, palette, mode) if 0 < max(distances) <= DISTANCE_BITS else None


class _Heads:
    """Reads headers of the form that encode_tiles() writes, a lane for each body; `good` lanes have it."""

    def __init__(self, bodies: list[bytes]):
        size = np.array([len(b) for b in bodies], np.int64)
        data = np.frombuffer(b"".join(bodies) + bytes(16), np.uint8)
        self.words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        self.bit = 8 * (np.cumsum(size) - size)
        self.stop, self.good = self.bit + 8 * size, np.ones(len(bodies), bool)
        head = self.read(40)
        self.width, self.height = (head >> 8 & 0x3FFF) + 1, (head >> 22 & 0x3FFF) + 1
        self.good &= (head & 0xFF == 0x2F) & (head >> 37 == 0)
        head = self.read(11)
        size = (head >> 3) + 1
        self.good &= (head & 7 == 1 | PALETTE << 1) & (size >= _COLOURS) & self.follows(_HEAD, _HEAD_BITS)
        self.bit += _HEAD_BITS
        entry = self.ahead(self.bit[:, None] + _ENTRY * np.arange(256)) & 511
        inside = np.arange(256) < size[:, None]
        self.good &= ((entry >> 8 > 0) & inside == (np.arange(256) == 0)).all(1)
        self.palette = np.cumsum(np.where(inside, _TURN[8][entry & 255], 0), axis=1).astype(np.uint8) * inside
        self.bit += _ENTRY * size
        self.mode = np.zeros(len(bodies), np.int64)
        for m, (value, bits) in _PREDICTOR_HEADS.items():
            has = self.follows(value, bits)
            self.mode[has] = m
            self.bit += bits * has
        self.good &= (np.maximum(self.width, self.height) <= 1 << _BLOCK_BITS) | (self.mode == 0)
        self.good &= self.read(3) == 0
        self.lengths = self.read_lengths(GREEN)
        fixed = self.read(33)
        self.good &= (fixed & 7 == 5) & (fixed >> 11 & 7 == 5) & (fixed >> 22 & 7 == 5)
        self.distances = self.read_lengths(DISTANCES)
        for lengths, most in ((self.lengths, PLAIN_BITS), (self.distances, DISTANCE_BITS)):
            self.good &= (lengths.max(1, initial=0) > 0) & (lengths.max(1, initial=0) <= most)
        self.good &= self.bit <= self.stop

    def ahead(self, bit: np.ndarray) -> np.ndarray:
        """At least 56 bits."""
        return (self.words[np.minimum(bit >> 3, len(self.words) - 1)] >> (bit & 7).astype(np.uint64)).view(np.int64) & ((1 << 56) - 1)

    def read(self, bits: int) -> np.ndarray:
        out = self.ahead(self.bit) & ((1 << bits) - 1)
        self.bit = self.bit + bits
        return out

    def follows(self, value: int, bits: int) -> np.ndarray:
        out = np.ones(len(self.bit), bool)
        for at in range(0, bits, 32):
            most = (1 << min(32, bits - at)) - 1
            out &= self.ahead(self.bit + at) & most == value >> at & most
        return out

    def read_lengths(self, alphabet: int) -> np.ndarray:
        """read_lengths() of each lane; forms that aren't written here are not good."""
        lengths = np.zeros((len(self.bit), alphabet), np.int64)
        head = self.ahead(self.bit)
        few = head & 1 > 0
        rows = np.flatnonzero(few)
        two, first, second = head[rows] >> 1 & 1, head[rows] >> 3 & 255, head[rows] >> 11 & 255
        self.good[rows] &= (head[rows] >> 2 & 1 > 0) & (np.maximum(first, second * two) < alphabet)
        lengths[rows, np.minimum(first, alphabet - 1)] = 1
        lengths[rows[two > 0], np.minimum(second, alphabet - 1)[two > 0]] = 1
        self.bit[rows] += 11 + 8 * two
        rows = np.flatnonzero(~few)
        many = 4 + (head[rows] >> 1 & 15)
        own, bit = np.zeros((len(rows), 19), np.int64), self.bit[rows]
        listed = self.ahead(bit[:, None] + 5 + 3 * np.arange(19)) & 7
        own[:, CODE_LENGTH_ORDER] = listed * (np.arange(19) < many[:, None])
        bit = bit + 5 + 3 * many
        table, good = _tables(own, 7)
        good &= self.ahead(bit) & 1 == 0  # the whole alphabet
        self.good[rows[~good]] = False
        rows, bit, table = rows[good], bit[good] + 1, table[good].ravel()
        lane, at, last = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.full(len(rows), 8)
        found = []
        while len(lane):
            window = self.ahead(bit)
            e = table.take((window & 127) + (lane << 7)).astype(np.int64)
            symbol, size = e >> 4, e & 15
            extra = _RUN_EXTRA.take(symbol)
            n = _RUN_LEAST.take(symbol) + (window >> size & (1 << extra) - 1)
            bit = bit + size + extra
            value = np.where(symbol < 16, symbol, np.where(symbol == 16, last, 0))
            last = np.where((symbol > 0) & (symbol < 16), symbol, last)
            found.append((rows.take(lane) * alphabet + at, n, value))
            at = at + n
            done = at >= alphabet
            if done.any():
                self.good[rows[lane[at > alphabet]]] = False
                self.bit[rows[lane[done]]] = bit[done]
                lane, at, last, bit = (x[~done] for x in (lane, at, last, bit))
        if found:
            place, n, value = (np.concatenate(x) for x in zip(*found, strict=True))
            held = np.flatnonzero((value > 0) & self.good[place // alphabet])
            place, n = place[held], n[held]
            lengths.ravel()[np.repeat(place - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.repeat(value[held], n)
        return lengths


def _copied(samples: np.ndarray, at: np.ndarray, many: np.ndarray, back: np.ndarray) -> None:
    """Fills back-references in: sources that are themselves copies are followed to what was written out, doubling the steps."""
    place = np.repeat(at - (np.cumsum(many) - many), many) + np.arange(many.sum())
    source = np.arange(len(samples), dtype=np.int32)
    own = (place - np.repeat(back, many)).astype(np.int32)
    written = np.ones(len(samples), bool)
    written[place] = False
    source[place] = own
    todo = place
    while len(todo):
        left = np.flatnonzero(~written.take(own))
        todo, own = todo.take(left), source.take(own.take(left))
        source[todo] = own
    samples[place] = samples.take(source.take(place))


#: Of NEAR's distance codes, columns left and rows up.
_NEAR_LEFT, _NEAR_UP = np.array(NEAR).T
#: Extra bits and least value of each length and distance symbol.
_EXTRAS = np.maximum(np.arange(DISTANCES) - 2, 0) >> 1
_LEAST = np.where(np.arange(DISTANCES) < 4, np.arange(DISTANCES), (2 + (np.arange(DISTANCES) & 1)) << _EXTRAS) + 1


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """decode() of every file; plain ones advance together, a symbol each at a time."""
    out = []
    for image, fixed in _decoded(files):
        if fixed is not None:
            green, image = image, np.empty((*image.shape, 4), np.uint8)
            image[..., 1] = green
            image[..., 0], image[..., 2], image[..., 3] = fixed
        out.append(image)
    return out


def greens(files: list[bytes]) -> list[np.ndarray]:
    """The green channels of decode_many()."""
    return [image if fixed is not None else image[..., 1] for image, fixed in _decoded(files)]


def _decoded(files: list[bytes]) -> list[tuple[np.ndarray, tuple[int, int, int] | None]]:
    """Images, and None; of plain ones their green channel, and what red, blue and alpha are throughout."""
    out: list[tuple | None] = [None] * len(files)
    bodies = [_body(f) for f in files]
    if not files:
        return out
    read = _Heads(bodies)
    others = {i: _plain(bodies[i]) for i in np.flatnonzero(~read.good).tolist()}
    for i, h in others.items():
        if h is None:
            out[i] = decode(files[i]), None
            continue
        read.good[i] = True
        read.width[i], read.height[i], read.bit[i], read.mode[i], read.lengths[i], read.distances[i] = h.width, h.height, h.first_bit + read.stop[i] - 8 * len(bodies[i]), h.mode, h.lengths, h.distances
        if h.palette is not None:
            read.palette[i] = h.palette
    lanes = np.flatnonzero(read.good).tolist()
    if not lanes:
        return out
    wide, high, mode, palette = (x[lanes] for x in (read.width, read.height, read.mode, read.palette))
    sizes = wide * high
    base = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(bodies) + bytes(8), np.uint8).astype(np.uint32)
    at32 = (data[:-3] | (data[1:-2] << 8) | (data[2:-1] << 16) | (data[3:] << 24)).astype(np.int64)
    bit, stop = read.bit[lanes], read.stop[lanes]
    (table, whole), (far_table, far_whole) = _tables(read.lengths[lanes], PLAIN_BITS), _tables(read.distances[lanes], DISTANCE_BITS)
    if not (whole & far_whole).all():
        raise ValueError("a prefix code that is not complete")
    table, far_table = table.ravel(), far_table.ravel()
    copies = []
    samples = np.zeros(base[-1], np.uint8)
    where, limit = base[:-1].copy(), base[1:]
    live = np.arange(len(lanes))
    position, here, top, row = where[live], bit[live], limit[live], live << PLAIN_BITS
    mask = (1 << PLAIN_BITS) - 1

    def ahead(bit: np.ndarray) -> np.ndarray:
        out = at32.take(bit >> 3, mode="clip")
        out >>= bit & 7
        return out

    def value_ahead(symbol: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """value_of() in lockstep; moves bit on."""
        value, extra = ahead(bit), _EXTRAS.take(symbol)
        value &= (1 << extra) - 1
        value += _LEAST.take(symbol)
        bit += extra
        return value

    while len(live):
        at = ahead(here)
        at &= mask
        at += row
        e = table.take(at)
        symbol = e >> 4
        e &= 15
        here += e
        refers = np.flatnonzero(symbol >= 256)
        samples[position] = symbol  # a reference's first sample is filled in later
        if len(refers):
            lane, bit, at = live.take(refers), here.take(refers), position.take(refers)
            many = value_ahead(symbol.take(refers) - 256, bit)
            far = ahead(bit)
            far &= (1 << DISTANCE_BITS) - 1
            far += lane << DISTANCE_BITS
            far = far_table.take(far)
            bit += far & 15
            copies.append((at, many, value_ahead(far >> 4, bit), lane))
            here[refers] = bit
            position += 1
            position[refers] = at + many
        else:
            position += 1
        done = position >= top
        if done.any():
            if (here[done] > stop[live[done]]).any():
                raise ValueError("the image ends too early")
            keep = ~done
            live, position, here, top, row = live[keep], position[keep], here[keep], top[keep], row[keep]
    if copies:
        at, many, code, lane = (np.concatenate(x) for x in zip(*copies, strict=True))
        near = np.minimum(code, len(NEAR)) - 1
        back = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, _NEAR_LEFT[near] + _NEAR_UP[near] * wide[lane]))
        if (at - back < base[lane]).any() or (at + many > limit[lane]).any():
            raise ValueError("a reference beyond the image")
        _copied(samples, at, many, back)
    coloured = np.array([i not in others or others[i].palette is not None for i in lanes])
    tile_of = np.repeat(np.arange(len(lanes)), sizes)
    for k in np.flatnonzero(mode).tolist():
        own = samples[base[k] : base[k + 1]].reshape(high[k], wide[k])
        own[:] = _restored(own, int(mode[k]))
    palette[~coloured] = np.arange(256)
    samples = palette.ravel().take((tile_of << 8) + samples)
    for k, i in enumerate(lanes):
        out[i] = samples[base[k] : base[k + 1]].reshape(high[k], wide[k]), (0, 0, 255) if coloured[k] else others[i].fixed
    return out


# --- media columns -----------------------------------------------------------------------------------------------


def split_files(media: bytes) -> list[bytes]:
    """The files of a media value: they follow one another."""
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + n])
        at += n
    return out


def store(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, media - the text as tiles of samples in lossless WebP files, one after the other.

    The payload is the UTF-8 text and zeros up to a positive multiple of 64. A null text counts as empty. Null ids, repeated
    rows, an empty table and clashing extra columns are allowed; row count is kept.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                size = np.diff(offsets)
                padded = np.maximum(WIDTH, -(-size // WIDTH) * WIDTH)
                bounds = np.concatenate([[0], np.cumsum(padded)])
                payload = np.zeros(bounds[-1], np.uint8)
                payload[np.arange(len(data)) + np.repeat(bounds[:-1] - offsets[:-1], size)] = data
                cuts = [np.arange(a, b, TILE) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                files = encode_tiles(payload, np.append(np.concatenate(cuts), bounds[-1])) if cuts else []
                media, at = [], 0
                for c in cuts:
                    media.append(b"".join(files[at : at + len(c)]))
                    at += len(c)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return doc_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature(payload: np.ndarray) -> str:
    """Mean, spread and the shares of eight ranges of values, in thousandths."""
    share = np.bincount(payload >> 5, minlength=8) * 1000 // len(payload)
    return f"{len(payload) // WIDTH}x{WIDTH}:{payload.mean():.3f}:{payload.std():.3f}:" + "-".join(map(str, share))


def load(stored: DataFrame) -> DataFrame:
    """Reads media values back: per row doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media", 2 << 20):
                media = [x.as_py() for x in part.column("media")]
                files = [split_files(m) for m in media]
                images, at, rows = greens([f for fs in files for f in fs]), 0, []
                for m, fs in zip(media, files, strict=True):
                    payload = np.concatenate([i.ravel() for i in images[at : at + len(fs)]])
                    at += len(fs)
                    raw = payload.tobytes()
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest(), crc(raw[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(payload)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *map(pa.array, cols)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored_media(docs: DataFrame) -> DataFrame:
    """store(), written to the shared folder, and load() of what was written."""
    return load(materialise(store(docs), "media", "none"))
