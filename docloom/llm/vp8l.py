"""Lossless WebP (VP8L): a complete decoder and an encoder, from the public format description.

Decoder: prefix codes (simple and length-coded), meta prefix images, back-references with
the two-dimensional distance map, colour cache, and the inverse of the predictor,
cross-colour, subtract-green and palette transforms with pixel bundling.

Encoder: ``encode`` takes one image and writes any of the features above; ``vp8l_batch``
writes and reads many images at once.

Pixels are uint8 arrays (height, width, 4) in the order red, green, blue, alpha.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

MAX_SIDE = 1 << 14
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: (x, y) of the short distance codes 1 to 120.
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_HASH = 0x1E35A7BD


# --- prefix codes -----------------------------------------------------------------------


def _reverse_table() -> np.ndarray:
    r = np.zeros(1 << 15, np.int64)
    for bit in range(15):
        r |= ((np.arange(1 << 15) >> bit) & 1) << (14 - bit)
    return r


_REV15 = _reverse_table()


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol, its first bit lowest; lengths of at most 15."""
    lengths = np.asarray(lengths, np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order]
    codes = np.zeros(len(lengths), np.int64)
    if len(order):
        steps = np.int64(1) << (15 - size)
        first = np.cumsum(steps) - steps  # left-aligned in 15 bits
        codes[order] = _REV15[first]
    return codes


def decode_table(lengths: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Indexed by the next bits: symbol << 4 | length.  A lone symbol takes no bits."""
    lengths = np.asarray(lengths, np.int64)
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return np.full(1 << (bits or 0), used[0] << 4, np.int64)
    top = int(lengths.max(initial=0))
    if not top or int((1 << (15 - lengths[used])).sum()) != 1 << 15:
        raise ValueError("a prefix code is not complete")
    bits = top if bits is None else bits
    order = used[np.lexsort((used, lengths[used]))]
    straight = np.repeat((order << 4) | lengths[order], 1 << (bits - lengths[order]))
    return straight[_REV15[: 1 << bits] >> (15 - bits)]


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths of at most ``limit``; a lone symbol gets length 1."""
    counts = np.asarray(counts, np.int64)
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    weight = counts[used]
    while True:
        heap = [(w, i) for i, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        n = len(used)
        parent = [0] * (2 * n - 1)
        for node in range(n, 2 * n - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            heapq.heapreplace(heap, (a + b, node))
            parent[i] = parent[j] = node
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= limit:
            out[used] = depth[:n]
            return out
        weight = (weight + 1) // 2 + int(weight.sum() >> (limit + 1))


# --- bits -------------------------------------------------------------------------------


class _Bits:
    """Reader: 57 bits or more at any position."""

    def __init__(self, data: bytes, start: int = 0):
        a = np.frombuffer(data + b"\0" * 16, np.uint8).astype(np.uint64)
        w = np.zeros(len(a) - 8, np.uint64)
        for k in range(8):
            w |= a[k : len(a) - 8 + k] << np.uint64(8 * k)
        self.words, self.at, self.end = w.tolist(), start, 8 * len(data)

    def read(self, n: int) -> int:
        v = (self.words[self.at >> 3] >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends too early")
        return v


class _Writer:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


# --- decoder ----------------------------------------------------------------------------


@lru_cache(256)
def _length_table(lengths: bytes) -> tuple[int, list[int]]:
    """Mask and table of a code for code lengths; encoders use few of them."""
    table = decode_table(np.frombuffer(lengths, np.int64))
    return len(table) - 1, table.tolist()


def _read_lengths(b: _Bits, size: int) -> np.ndarray:
    lengths = np.zeros(size, np.int64)
    if b.read(1):
        two = b.read(1)
        first = b.read(8 if b.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[b.read(8)] = 1
        return lengths
    clc = np.zeros(19, np.int64)
    for k in range(4 + b.read(4)):
        clc[_LENGTH_ORDER[k]] = b.read(3)
    mask, table = _length_table(clc.tobytes())
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    i, last = 0, 8
    words, at = b.words, b.at
    while i < size and left:
        left -= 1
        v = words[at >> 3] >> (at & 7)
        e = table[v & mask]
        n, s = e & 15, e >> 4
        v >>= n
        at += n
        if s < 16:
            lengths[i] = s
            i += 1
            if s:
                last = s
        elif s == 16:
            run = 3 + (v & 3)
            at += 2
            lengths[i : i + run] = last
            i += run
        else:
            run, bits = (3 + (v & 7), 3) if s == 17 else (11 + (v & 127), 7)
            at += bits
            i += run
    b.at = at
    if i > size or at > b.end:
        raise ValueError("code lengths run over")
    return lengths


def _extended(b: _Bits, s: int) -> int:
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + b.read(extra) + 1


def _entropy_image(b: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB of width * height pixels as uint32."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    meta, meta_bits, groups = None, 0, 1
    if main and b.read(1):
        meta_bits = b.read(3) + 2
        mw, mh = (width + (1 << meta_bits) - 1) >> meta_bits, (height + (1 << meta_bits) - 1) >> meta_bits
        meta = ((_entropy_image(b, mw, mh, False) >> 8) & 0xFFFF).astype(np.int64)
        groups, meta = int(meta.max()) + 1, meta.tolist()
    tables = []
    for _ in range(groups):
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        codes = []
        for size in sizes:
            lengths = _read_lengths(b, size)
            t = decode_table(lengths) if lengths.any() else np.zeros(1, np.int64)
            codes += [t.tolist(), len(t) - 1]
        tables.append(codes)
    out = [0] * (width * height)
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    words, at, i, n = b.words, b.at, 0, width * height
    g, gm, r, rm, bl, bm, al, am, di, dm = tables[0]
    row_blocks = (width + (1 << meta_bits) - 1) >> meta_bits
    while i < n:
        if meta is not None:
            g, gm, r, rm, bl, bm, al, am, di, dm = tables[meta[(i // width >> meta_bits) * row_blocks + (i % width >> meta_bits)]]
        v = words[at >> 3] >> (at & 7)
        e = g[v & gm]
        k = e & 15
        s = e >> 4
        if s < 256:
            v >>= k
            x = r[v & rm]
            v >>= x & 15
            y = bl[v & bm]
            v >>= y & 15
            z = al[v & am]
            at += k + (x & 15) + (y & 15) + (z & 15)
            c = (z >> 4) << 24 | (x >> 4) << 16 | s << 8 | y >> 4
            out[i] = c
            i += 1
            if cache_bits:
                cache[(_HASH * c & 0xFFFFFFFF) >> shift] = c
        elif s < 280:
            b.at = at + k
            length = _extended(b, s - 256)
            v = words[b.at >> 3] >> (b.at & 7)
            e = di[v & dm]
            b.at += e & 15
            d = _extended(b, e >> 4)
            at = b.at
            if d > 120:
                d -= 120
            else:
                dx, dy = _NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            for j in range(i, i + length):
                c = out[j] = out[j - d]
                if cache_bits:
                    cache[(_HASH * c & 0xFFFFFFFF) >> shift] = c
            i += length
        else:
            at += k
            c = out[i] = cache[s - 280]
            cache[(_HASH * c & 0xFFFFFFFF) >> shift] = c
            i += 1
    b.at = at
    if at > b.end:
        raise ValueError("the stream ends too early")
    return np.array(out, np.uint32)


def _rgba(argb: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.stack([(argb >> s & 255).astype(np.uint8) for s in (16, 8, 0, 24)], axis=-1).reshape(height, width, 4)


def _avg(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """The format's predictors 1 to 13 on int channels; 0, 14 and 15 are opaque black."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return top_right
        case 4:
            return top_left
        case 5:
            return _avg(_avg(left, top_right), top)
        case 6:
            return _avg(left, top_left)
        case 7:
            return _avg(left, top)
        case 8:
            return _avg(top_left, top)
        case 9:
            return _avg(top, top_right)
        case 10:
            return _avg(_avg(left, top_left), _avg(top, top_right))
        case 11:
            return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
        case 12:
            return np.clip(left + top - top_left, 0, 255)
        case 13:
            mean = _avg(left, top)
            gap = mean - top_left
            return np.clip(mean + np.where(gap < 0, -(-gap >> 1), gap >> 1), 0, 255)
    return np.array([0, 0, 0, 255])


def _predicted(px: np.ndarray, x: int, y: int, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w = px.shape[:2]
    if y == 0:
        return px[0, x - 1] if x else np.array([0, 0, 0, 255])
    if x == 0:
        return px[y - 1, 0]
    right = px[y - 1, x + 1] if x + 1 < w else px[y, 0]
    return _predict(int(modes[y >> bits, x >> bits]), px[y, x - 1], px[y - 1, x], px[y - 1, x - 1], right)


def _undo_predictor(px: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    out = px.astype(np.int64)
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            out[y, x] = (out[y, x] + _predicted(out, x, y, modes, bits)) & 255
    return out.astype(np.uint8)


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int64) * c.astype(np.uint8).astype(np.int8).astype(np.int64)) >> 5


def _spread(sub: np.ndarray, bits: int, h: int, w: int) -> np.ndarray:
    return sub[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits]


def _cross_colour(px: np.ndarray, elements: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    h, w = px.shape[:2]
    e = _spread(elements, bits, h, w)  # red holds red-to-blue, green holds green-to-blue, blue holds green-to-red
    red, green, blue = (px[..., k].astype(np.int64) for k in range(3))
    sign = 1 if undo else -1
    new_red = (red + sign * _delta(e[..., 2], green)) & 255
    plain_red = new_red if undo else red
    new_blue = (blue + sign * (_delta(e[..., 1], green) + _delta(e[..., 0], plain_red))) & 255
    return np.stack([new_red, green, new_blue, px[..., 3]], axis=-1).astype(np.uint8)


def _green(px: np.ndarray, sign: int) -> np.ndarray:
    out = px.astype(np.int64)
    out[..., 0] += sign * out[..., 1]
    out[..., 2] += sign * out[..., 1]
    return (out & 255).astype(np.uint8)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(px: np.ndarray, table: np.ndarray, bits: int, width: int) -> np.ndarray:
    x = np.arange(width)
    each = 8 >> bits
    index = (px[:, x >> bits, 1].astype(np.int64) >> (each * (x & ((1 << bits) - 1)))) & ((1 << each) - 1)
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index]


def _payload(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    n = struct.unpack_from("<I", data, 16)[0]
    if len(data) < 20 + n or n < 5 or data[20] != 0x2F:
        raise ValueError("not a lossless WebP stream")
    return data[20 : 20 + n]


def decode(data: bytes) -> np.ndarray:
    """Pixels of one lossless WebP file."""
    b = _Bits(_payload(data), 8)
    width, height, alpha = b.read(14) + 1, b.read(14) + 1, b.read(1)
    if b.read(3):
        raise ValueError("unknown version")
    full_width, undo = width, []
    while b.read(1):
        kind = b.read(2)
        if kind in (0, 1):
            bits = b.read(3) + 2
            w, h = (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            undo.append((kind, _rgba(_entropy_image(b, w, h, False), h, w), bits, width))
        elif kind == 2:
            undo.append((2, None, 0, width))
        else:
            n = b.read(8) + 1
            table = np.cumsum(_rgba(_entropy_image(b, n, 1, False), 1, n)[0].astype(np.int64), axis=0) & 255
            bits = _bundle_bits(n)
            undo.append((3, table.astype(np.uint8), bits, width))
            width = (width + (1 << bits) - 1) >> bits
    px = _rgba(_entropy_image(b, width, height, True), height, width)
    for kind, sub, bits, wide in reversed(undo):
        if kind == 0:
            px = _undo_predictor(px, sub[..., 1], bits)
        elif kind == 1:
            px = _cross_colour(px, sub, bits, True)
        elif kind == 2:
            px = _green(px, 1)
        else:
            px = _undo_palette(px, sub, bits, wide)
    if not alpha:
        px[..., 3] = 255
    assert px.shape[1] == full_width
    return px


# --- encoder ----------------------------------------------------------------------------


_CLC = np.zeros(19, np.int64)
_CLC[[*range(14), 17, 18]] = 4  # lengths 0 to 13 and the two kinds of zero runs, four bits each
_CLC_CODES = canonical(_CLC).tolist()


def _put_lengths(w: _Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        two = len(used) == 2
        first = int(used[0]) if len(used) else 0
        w.put(1 | two << 1 | 1 << 2 | first << 3, 11)
        if two:
            w.put(int(used[1]), 8)
        return
    if len(used) == 1:  # a lone symbol over 255 needs a second one
        lengths = lengths.copy()
        lengths[0] = 1
    if lengths.max() > 13:
        raise ValueError("lengths of at most 13 can be written")
    value, n = 15 << 1, 5
    for k in _LENGTH_ORDER:
        value |= int(_CLC[k]) << n
        n += 3
    n += 1  # all symbols are given
    codes = _CLC_CODES
    i, size, ls = 0, len(lengths), lengths.tolist()
    while i < size:
        s = ls[i]
        if s:
            value |= codes[s] << n
            n += 4
            i += 1
            continue
        j = i
        while j < size and not ls[j]:
            j += 1
        run = j - i
        while run >= 11:
            m = min(run, 138)
            value |= (codes[18] | (m - 11) << 4) << n
            n += 11
            run -= m
        if run >= 3:
            value |= (codes[17] | (run - 3) << 4) << n
            n += 7
            run = 0
        for _ in range(run):
            value |= codes[0] << n
            n += 4
        i = j
    w.put(value, n)


def _prefix(v: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number for a length or distance."""
    v -= 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + (v >> extra & 1), v & ((1 << extra) - 1), extra


def _tokens(argb: list[int], width: int, cache_bits: int, lz: bool) -> list[tuple]:
    """('p', colour), ('c', index) or ('m', length, distance code)."""
    out: list[tuple] = []
    cache: dict[int, int] = {}
    seen: dict[tuple, int] = {}
    i, n = 0, len(argb)

    def remember(c: int) -> None:
        if cache_bits:
            cache[(_HASH * c & 0xFFFFFFFF) >> (32 - cache_bits)] = c

    near = {}
    for code, (dx, dy) in reversed(list(enumerate(_NEAR, 1))):
        near[max(1, dx + dy * width)] = code
    while i < n:
        length = 0
        if lz and i + 3 <= n:
            key = tuple(argb[i : i + 3])
            j = seen.get(key)
            if j is not None:
                while length < 4096 and i + length < n and argb[j + length] == argb[i + length]:
                    length += 1
            seen[key] = i
        if length >= 3:
            d = i - j
            out.append(("m", length, near.get(d, d + 120)))
            for c in argb[i : i + length]:
                remember(c)
            i += length
            continue
        c = argb[i]
        at = (_HASH * c & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else -1
        out.append(("c", at) if cache_bits and cache.get(at) == c else ("p", c))
        remember(c)
        i += 1
    return out


def _put_image(w: _Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, lz: bool = False, meta: np.ndarray | None = None, meta_bits: int = 0) -> None:
    w.put(1 | cache_bits << 1, 5) if cache_bits else w.put(0, 1)
    groups = 1
    if main:
        w.put(int(meta is not None), 1)
        if meta is not None:
            w.put(meta_bits - 2, 3)
            _put_image(w, (meta.astype(np.int64) << 8).ravel() | 0xFF000000, meta.shape[1], False)
            groups = int(meta.max()) + 1
    tokens = _tokens(argb.tolist(), width, cache_bits, lz)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(s, np.int64) for s in sizes] for _ in range(groups)]
    places, at = [], 0
    for t in tokens:
        g = 0 if meta is None else int(meta[at // width >> meta_bits, at % width >> meta_bits])
        c = counts[g]
        if t[0] == "p":
            for k, s in enumerate((8, 16, 0, 24)):
                c[k][t[1] >> s & 255] += 1
            at += 1
        elif t[0] == "c":
            c[0][280 + t[1]] += 1
            at += 1
        else:
            c[0][256 + _prefix(t[1])[0]] += 1
            c[4][_prefix(t[2])[0]] += 1
            at += t[1]
        places.append(g)
    lengths = [[code_lengths(x, 13) for x in c] for c in counts]
    for group in lengths:
        for x in group:
            _put_lengths(w, x)
    codes = [[(canonical(x).tolist(), (x * (np.count_nonzero(x) > 1 or (k == 0 and np.flatnonzero(x).max(initial=0) > 255))).tolist()) for k, x in enumerate(group)] for group in lengths]
    for group, sets in zip(lengths, codes):
        if np.count_nonzero(group[0]) == 1 and np.flatnonzero(group[0])[0] > 255:
            lone = group[0].copy()
            lone[0] = 1
            sets[0] = (canonical(lone).tolist(), lone.tolist())
    for t, g in zip(tokens, places):
        c = codes[g]
        if t[0] == "p":
            for k, s in enumerate((8, 16, 0, 24)):
                v = t[1] >> s & 255
                w.put(c[k][0][v], c[k][1][v])
        elif t[0] == "c":
            w.put(c[0][0][280 + t[1]], c[0][1][280 + t[1]])
        else:
            for k, base, v in ((0, 256, t[1]), (4, 0, t[2])):
                s, extra, bits = _prefix(v)
                w.put(c[k][0][base + s], c[k][1][base + s])
                w.put(extra, bits)


def _argb(px: np.ndarray) -> np.ndarray:
    p = px.astype(np.int64)
    return (p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]).ravel()


def _riff(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def _head(width: int, height: int, alpha: bool) -> int:
    return 0x2F | (width - 1) << 8 | (height - 1) << 22 | int(alpha) << 36


def encode(
    px: np.ndarray, *, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, subtract_green: bool = False, palette: bool = False,
    bits: int = 2, cache_bits: int = 0, lz: bool = True, meta: np.ndarray | None = None,
) -> bytes:
    """One image; predictor holds a mode, cross (red-to-blue, green-to-blue, green-to-red) for each block of 1 << bits pixels."""
    height, width = px.shape[:2]
    w = _Writer()
    w.put(_head(width, height, bool((px[..., 3] != 255).any())), 40)
    if palette:
        table, index = np.unique(px.reshape(-1, 4), axis=0, return_inverse=True)
        if len(table) > 256:
            raise ValueError("too many colours for a palette")
        w.put(1 | 3 << 1 | (len(table) - 1) << 3, 11)
        _put_image(w, _argb(np.diff(table.astype(np.int64), axis=0, prepend=0) & 255), len(table), False)
        pack = _bundle_bits(len(table))
        wide = (width + (1 << pack) - 1) >> pack
        green = np.zeros((height, wide), np.int64)
        x = np.arange(width)
        np.bitwise_or.at(green, (slice(None), x >> pack), index.reshape(height, width) << ((8 >> pack) * (x & ((1 << pack) - 1))))
        px = np.stack([np.zeros_like(green), green, np.zeros_like(green), np.full_like(green, 255)], axis=-1)
        width = wide
    if subtract_green:
        w.put(1 | 2 << 1, 3)
        px = _green(px, -1)
    if cross is not None:
        w.put(1 | 1 << 1 | (bits - 2) << 3, 6)
        sub = np.concatenate([cross, np.full((*cross.shape[:2], 1), 255)], axis=-1)
        _put_image(w, _argb(sub & 255), cross.shape[1], False)
        px = _cross_colour(np.asarray(px, np.uint8), (cross & 255).astype(np.uint8), bits, False)
    if predictor is not None:
        w.put(1 | 0 << 1 | (bits - 2) << 3, 6)
        modes = np.asarray(predictor, np.int64)
        _put_image(w, modes.ravel() << 8 | 0xFF000000, modes.shape[1], False)
        whole = np.asarray(px, np.int64)
        rest = [[(whole[y, x] - _predicted(whole, x, y, modes, bits)) & 255 for x in range(width)] for y in range(height)]
        px = np.array(rest)
    w.put(0, 1)
    _put_image(w, _argb(np.asarray(px)), width, True, cache_bits, lz, meta, bits)
    return _riff(w.bytes())
