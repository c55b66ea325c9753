"""Lossless WebP for many opaque images at once: the whole format's tools, in numpy.

Encoder.  Each image gets the transform of least estimated entropy (none, subtract-green,
cross-colour, or a predictor: left or top).  Back-references go to the last place of the same
four pixels (found by one sort for all images), their lengths follow from neighbours with the
same distance, and the longest at each place is taken from left to right.  Other pixels are
literals, or entries of a colour cache where that holds a quarter of an image's literals.  Prefix
codes of at most ``BITS`` bits are made for all images at once.

Decoder.  ``decode_many`` reads a token of all images at a time: no token's length depends on
a pixel.  Copies and cache entries become pointers to earlier pixels, which are followed by
doubling; a cache entry points to the last pixel with its hash.  Then transforms are undone.
Files with several code groups, longer codes or a palette go through ``vp8l.decode``.
"""

from __future__ import annotations

import numpy as np

from docloom.llm import vp8l

BITS = 10
LANES = 2048
FEW = 24
CACHE_BITS = 6
CACHE_LEAST = 4  # a cache is used where it holds one in so many literals
MIN_MATCH = 4
ROW_STEP = 4  # the entropy under each transform is estimated on one row in so many
MAX_MATCH = 4096
_GREEN = 280 + (1 << CACHE_BITS)
_NONE, _GREEN_OFF, _CROSS, _LEFT, _TOP = range(5)
_BLOCK_BITS = 9


# --- prefix codes -------------------------------------------------------------------------


def complete_lengths(counts: np.ndarray) -> np.ndarray:
    """Complete code lengths of at most BITS for each row of counts; rows with one symbol give it 1.

    Lengths are the rounded-up information of each symbol; what that leaves free shortens
    symbols from short to long until the code is complete.
    """
    used = counts > 0
    some = np.flatnonzero(used.sum(axis=1) > 1)
    out = used.astype(np.int64)
    if not len(some):
        return out
    c, u = counts[some].astype(np.float64), used[some]
    weight = np.where(u, np.maximum(c, c.sum(axis=1, keepdims=True) / 600), 0)
    with np.errstate(divide="ignore"):
        length = np.where(u, np.ceil(np.log2(weight.sum(axis=1, keepdims=True) / weight) - 1e-9), 0).astype(np.int64)
    length[u] = np.clip(length[u], 1, BITS)
    free = (1 << BITS) - np.where(u, 1 << (BITS - length), 0).sum(axis=1)
    if (free < 0).any():
        raise ValueError("too many symbols for codes of this length")
    while free.any():
        for size in range(2, BITS + 1):
            mask = length == size
            n = np.minimum(mask.sum(axis=1), free >> (BITS - size))
            if not n.any():
                continue
            pick = mask & (np.cumsum(mask, axis=1) <= n[:, None])
            length -= pick
            free -= n << (BITS - size)
    out[some] = length
    return out


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code bits, first bit lowest, and their number, by row and symbol; a lone symbol takes no bits."""
    rows, size = lengths.shape
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    sorted_ = np.take_along_axis(lengths, order, 1)
    steps = np.where(sorted_ > 0, 1 << (15 - np.minimum(sorted_, 15)), 0)
    first = np.cumsum(steps, axis=1) - steps
    codes = np.zeros_like(lengths)
    np.put_along_axis(codes, order, np.where(sorted_ > 0, vp8l._REV15[np.minimum(first, (1 << 15) - 1)], 0), 1)
    lone = (lengths > 0).sum(axis=1) < 2
    codes[lone] = 0
    return codes, np.where(lone[:, None], 0, lengths)


def _prefixes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number of lengths or distances."""
    v = v - 1
    top = np.log2(np.maximum(v, 1)).astype(np.int64)
    extra = np.maximum(top - 1, 0)
    small = v < 4
    return np.where(small, v, 2 * top + (v >> extra & 1)), np.where(small, 0, v & ((1 << extra) - 1)), np.where(small, 0, extra)


# --- transforms ---------------------------------------------------------------------------


def _bits_of(px: np.ndarray, image: np.ndarray, n: int) -> np.ndarray:
    """Estimated bits of each image, its channels coded apart; red and blue share a code."""
    total = np.zeros(n)
    for channels in ((1,), (0, 2)):
        hist = sum(np.bincount(image * 256 + px[:, c], minlength=n * 256) for c in channels).reshape(n, 256).astype(np.float64)
        all_ = hist.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.nansum(np.where(hist > 0, hist * np.log2(all_ / hist), 0), axis=1)
    return total


def _residuals(px: np.ndarray, first: np.ndarray, image: np.ndarray, width: int, at: np.ndarray, slopes: np.ndarray | None = None) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """These pixels under each transform, and the cross-colour elements of each image, taken from them if not given."""
    of, now = image[at], px[at]
    place = at - first[of]
    left, above = px[np.maximum(at - 1, 0)], px[np.maximum(at - width, 0)]
    at_left, at_top, none = place % width == 0, place < width, (place == 0)[:, None]
    by_left = np.where(none, np.uint8(0), np.where((at_left & ~at_top)[:, None], above, left))
    by_top = np.where(none, np.uint8(0), np.where(at_top[:, None], left, above))
    green = now.copy()
    green[:, 0] -= now[:, 1]
    green[:, 2] -= now[:, 1]
    signed = now.view(np.int8).astype(np.int64)
    if slopes is None:
        n = len(first)
        spread = np.maximum(np.bincount(of, signed[:, 1] ** 2, n), 1)
        slopes = np.stack([np.clip(np.round(32 * np.bincount(of, signed[:, 1] * signed[:, c], n) / spread), -128, 127) for c in (0, 2)], axis=1).astype(np.int64)
    cross = now.copy()
    for c, s in zip((0, 2), slopes.T):
        cross[:, c] = (now[:, c] - (signed[:, 1] * s[of] >> 5)) & 255
    return {_NONE: now, _GREEN_OFF: green, _CROSS: cross, _LEFT: now - by_left, _TOP: now - by_top}, slopes


def _undo(px: np.ndarray, kind: int, sub: np.ndarray | None, bits: int) -> np.ndarray:
    """One transform of (height, width, 4) pixels undone."""
    if kind == 1:
        return vp8l._cross_colour(px, sub, bits, True)
    if kind == 2:
        return vp8l._green(px, 1)
    modes = np.unique(sub[..., 1] & 15)
    if len(modes) > 1 or modes[0] not in (1, 2):
        return vp8l._undo_predictor(px, sub[..., 1], bits)
    out = px.astype(np.int64)
    out[0, 0, 3] += 255
    if modes[0] == 1:
        out[:, 0] = np.cumsum(out[:, 0], axis=0)
        return (np.cumsum(out, axis=1) & 255).astype(np.uint8)
    out[0] = np.cumsum(out[0], axis=0)
    return (np.cumsum(out, axis=0) & 255).astype(np.uint8)


# --- encoder ------------------------------------------------------------------------------


def _matches(v: np.ndarray, image: np.ndarray, stop: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Places, lengths and distances of the back-references, from left to right; ``stop`` is each pixel's image end."""
    n = len(v)
    if n < MIN_MATCH + 1:
        return [], [], []
    u = v.astype(np.uint64)
    h = image[: n - 3].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
        h = (h ^ (h >> np.uint64(29))) + u[k : n - 3 + k] * np.uint64(m)
    inside = np.flatnonzero(np.arange(n - 3) + MIN_MATCH <= stop[: n - 3])
    order = inside[np.argsort(h[inside], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    before = np.full(n + 1, -2)
    before[order[1:][same]] = order[:-1][same]
    at = np.flatnonzero(before[:n] >= 0)
    ok = np.ones(len(at), bool)
    for k in range(MIN_MATCH):
        ok &= v[at + k] == v[before[at] + k]
    before[at[~ok]] = -2
    if not ok.any():
        return [], [], []
    breaks = np.flatnonzero((before[1:] != before[:-1] + 1) | (before[:-1] < 0))
    end = breaks[np.searchsorted(breaks, np.arange(n))]
    size = np.minimum(np.minimum(MIN_MATCH + end - np.arange(n), stop - np.arange(n)), MAX_MATCH)
    following = np.minimum.accumulate(np.where(before[:n] >= 0, np.arange(n), n)[::-1])[::-1].tolist()
    sizes, prior, now = size.tolist(), before.tolist(), 0
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    while now < n:
        i = following[now]
        if i == n:
            break
        out[0].append(i)
        out[1].append(sizes[i])
        out[2].append(i - prior[i])
        now = i + sizes[i]
    return out


def _cache_hits(argb: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cache index of each pixel, and whether the cache holds the pixel just before it."""
    index = (argb * np.int64(vp8l._HASH) & 0xFFFFFFFF) >> (32 - CACHE_BITS)
    key = image << CACHE_BITS | index
    order = np.argsort(key, kind="stable")
    hit = np.zeros(len(argb), bool)
    same = (key[order[1:]] == key[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
    hit[order[1:]] = same
    return index, hit


def encode_many(payloads: list[np.ndarray], width: int) -> list[bytes]:
    """Opaque images of red-green-blue bytes, ``3 * width`` a row."""
    if not payloads:
        return []
    n = len(payloads)
    sizes = np.array([len(p) // 3 for p in payloads])
    bound = np.concatenate([[0], np.cumsum(sizes)])
    px, image = np.concatenate(payloads).reshape(-1, 3), np.repeat(np.arange(n), sizes)
    first = bound[:-1]
    rows = (np.arange(len(px)) - first[image]) // width
    some = np.flatnonzero(rows % ROW_STEP == 0)
    forms, slopes = _residuals(px, first, image, width, some)
    # other than none must gain more than its header
    cost = np.stack([_bits_of(forms[k], image[some], n) + (0 if k == _NONE else 120) for k in sorted(forms)])
    kind = cost.argmin(axis=0)
    if kind.any():
        own = np.flatnonzero((kind > 0)[image])
        forms, _ = _residuals(px, first, image, width, own, slopes)
        px = px.copy()
        px[own] = np.choose(kind[image[own]][:, None], [forms[k] for k in sorted(forms)])
    alpha = np.where(kind >= _LEFT, 0, 255)
    argb = alpha[image] << 24 | px[:, 0].astype(np.int64) << 16 | px[:, 1].astype(np.int64) << 8 | px[:, 2]
    at, length, far = (np.array(x, np.int64) for x in _matches(argb, image, bound[1:][image]))
    covered = np.zeros(len(px) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + length, -1)
    single = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    index, hit = _cache_hits(argb, image)
    by_image = lambda x: np.bincount(image[x], minlength=n)
    cached = by_image(single[hit[single]]) * CACHE_LEAST >= np.maximum(by_image(single), 1)
    as_entry = hit[single] & cached[image[single]]
    plain, entry = single[~as_entry], single[as_entry]
    near = np.zeros(8 * width + 8, np.int64)
    for code, (dx, dy) in reversed(list(enumerate(vp8l._NEAR, 1))):
        near[max(1, dx + dy * width)] = code
    short = near[np.minimum(far, len(near) - 1)]
    code_of = np.where((far < len(near)) & (short > 0), short, far + 120)
    (ls, lx, ln), (ds, dx_, dn) = _prefixes(length), _prefixes(code_of)

    green = np.bincount(np.concatenate([image[plain] * _GREEN + px[plain, 1], image[entry] * _GREEN + 280 + index[entry], image[at] * _GREEN + 256 + ls]), minlength=n * _GREEN).reshape(n, _GREEN)
    other = (np.bincount(image[plain] * 256 + px[plain, 0], minlength=n * 256) + np.bincount(image[plain] * 256 + px[plain, 2], minlength=n * 256)).reshape(n, 256)
    apart = np.bincount(image[at] * 40 + ds, minlength=n * 40).reshape(n, 40)
    lengths = [complete_lengths(x) for x in (green, other, apart)]
    (gc, gn), (oc, on), (dc, dl) = (_codes(x) for x in lengths)

    ip, ie, im = image[plain], image[entry], image[at]
    g, r, b_ = px[plain, 1], px[plain, 0], px[plain, 2]
    ng, nr, nb = gn[ip, g], on[ip, r], on[ip, b_]
    nl = gn[im, 256 + ls]
    # all of a literal, and a back-reference up to its distance symbol, are one field of at most 30 bits
    value = np.concatenate([gc[ip, g] | oc[ip, r] << ng | oc[ip, b_] << ng + nr, gc[ie, 280 + index[entry]], gc[im, 256 + ls] | lx << nl | dc[im, ds] << nl + ln, dx_])
    size = np.concatenate([ng + nr + nb, gn[ie, 280 + index[entry]], nl + ln + dl[im, ds], dn])
    tokens = np.concatenate([2 * plain, 2 * entry, 2 * at, 2 * at + 1])
    order = np.argsort(tokens, kind="stable")
    return _packed(_headers(kind, slopes, sizes, width, cached, lengths, alpha), value[order].astype(np.uint64), size[order], image[tokens[order] >> 1])


def _headers(kind: np.ndarray, slopes: np.ndarray, sizes: np.ndarray, width: int, cached: np.ndarray, lengths: list[np.ndarray], alpha: np.ndarray) -> list[vp8l._Writer]:
    out = []
    for i, k in enumerate(kind.tolist()):
        height = int(sizes[i]) // width
        w = vp8l._Writer()
        w.put(vp8l._head(width, height, False), 40)
        blocks = (height + (1 << _BLOCK_BITS) - 1) >> _BLOCK_BITS
        if k == _GREEN_OFF:
            w.put(1 | 2 << 1, 3)
        elif k != _NONE:
            w.put(1 | (1 if k == _CROSS else 0) << 1 | (_BLOCK_BITS - 2) << 3, 6)
            if k == _CROSS:  # red holds red-to-blue, green holds green-to-blue, blue holds green-to-red
                element = 0xFF000000 | (int(slopes[i, 1]) & 255) << 8 | int(slopes[i, 0]) & 255
            else:
                element = 0xFF000000 | (1 if k == _LEFT else 2) << 8
            vp8l._put_image(w, np.full(blocks, element, np.int64), 1, False)
        w.put(0, 1)
        w.put(1 | CACHE_BITS << 1, 5) if cached[i] else w.put(0, 1)
        w.put(0, 1)
        one = vp8l._Writer()
        vp8l._put_lengths(one, lengths[1][i])
        vp8l._put_lengths(w, lengths[0][i] if cached[i] else lengths[0][i, :280])
        w.put(one.value, one.n)
        w.put(one.value, one.n)
        w.put(1 | 1 << 2 | int(alpha[i]) << 3, 11)
        vp8l._put_lengths(w, lengths[2][i])
        out.append(w)
    return out


def _packed(heads: list[vp8l._Writer], value: np.ndarray, size: np.ndarray, of: np.ndarray) -> list[bytes]:
    """The files: each head, then the fields of its image, the first bit lowest."""
    n = len(heads)
    own = np.bincount(of, size, n).astype(np.int64)
    total = own + np.array([w.n for w in heads])
    start = np.concatenate([[0], np.cumsum(-(-total // 32) * 4)])
    end = np.cumsum(size)
    before = np.cumsum(own) - own
    pos = end - size + (start[:-1] * 8 + np.array([w.n for w in heads]) - before)[of]
    shifted = value << (pos & 31).astype(np.uint64)
    word, n_words = pos >> 5, int(start[-1] >> 2) + 2
    words = np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)
    words[1:] += np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n_words)[:-1]
    raw = words.astype(np.uint32).astype("<u4").tobytes()
    out = []
    for i, w in enumerate(heads):
        body = bytearray(raw[start[i] : start[i] + -(-int(total[i]) // 8)])
        head = w.bytes()
        if len(body) < len(head):
            body.extend(bytes(len(head) - len(body)))
        last = len(head) - 1
        body[:last] = head[:last]
        body[last] |= head[last]
        out.append(vp8l._riff(bytes(body)))
    return out


# --- decoder ------------------------------------------------------------------------------


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """Pixels (height, width, 4) of each file."""
    out: list[np.ndarray | None] = [None] * len(files)
    ready = []
    for k, data in enumerate(files):
        got = _opened(data)
        if got is None:
            out[k] = vp8l.decode(data)
        else:
            ready.append((k, got))
    ready.sort(key=lambda x: -len(x[1][2]))
    for i in range(0, len(ready), LANES):
        part = ready[i : i + LANES]
        for (k, (h, w, _, _, _, undo, alpha, _)), rgb in zip(part, _lockstep([x for _, x in part])):
            if rgb is None:
                out[k] = vp8l.decode(files[k])
                continue
            px = np.concatenate([rgb, np.full((h * w, 1), alpha, np.uint8)], axis=1).reshape(h, w, 4)
            for kind, sub, bits in reversed(undo):
                px = _undo(px, kind, sub, bits)
            px[..., 3] = 255
            out[k] = px
    return out


def _opened(data: bytes) -> tuple | None:
    """(height, width, stream, first bit, tables, transforms, alpha, cache bits) of what is read in lockstep, else None."""
    stream = vp8l._payload(data)
    b = vp8l._Bits(stream[:2048], 8)
    try:
        width, height, alpha = b.read(14) + 1, b.read(14) + 1, b.read(1)
        if b.read(3) or alpha:
            return None
        undo = []
        while b.read(1):
            kind = b.read(2)
            if kind == 3:
                return None
            if kind == 2:
                undo.append((2, None, 0))
                continue
            bits = b.read(3) + 2
            w, h = (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            undo.append((kind, vp8l._rgba(vp8l._entropy_image(b, w, h, False), h, w), bits))
        cache = b.read(4) if b.read(1) else 0
        if cache > CACHE_BITS or b.read(1):
            return None
        lengths = [vp8l._read_lengths(b, s) for s in (280 + (1 << cache if cache else 0), 256, 256, 256, 40)]
        opaque = np.flatnonzero(lengths[3])
        if len(opaque) != 1 or max(x.max(initial=0) for x in lengths) > BITS or not all(x.any() for x in lengths[:3]):
            return None
        made: dict[bytes, np.ndarray] = {}
        for x in (lengths[0], lengths[1], lengths[2], lengths[4]):
            if x.tobytes() not in made:
                made[x.tobytes()] = (vp8l.decode_table(x, BITS) if x.any() else np.zeros(1 << BITS, np.int64)).astype(np.uint16)
        tables = [made[x.tobytes()] for x in (lengths[0], lengths[1], lengths[2], lengths[4])]
    except (ValueError, IndexError):
        return None
    return height, width, stream, b.at, tables, undo, int(opaque[0]), cache


def _extended(s: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and number of extra bits of a length or distance symbol, v being the bits behind it."""
    extra = np.where(s < 4, 0, (s - 2) >> 1)
    more = (v & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    return np.where(s < 4, s + 1, ((2 + (s & 1)) << extra) + more + 1), extra


def _lockstep(images: list[tuple]) -> list[np.ndarray | None]:
    """Red, green and blue of each image before its transforms are undone, a token of all of them at a time.

    The last few images, longer than all others, are None: they are sooner read one by one.
    """
    n_px = np.array([h * w for h, w, *_ in images])
    widths = np.array([x[1] for x in images])
    table = np.concatenate([t for x in images for t in x[4]])
    streams = [x[2] for x in images]
    start = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    raw = np.frombuffer(b"".join(streams) + b"\0" * 16, np.uint8)
    word = np.zeros(len(raw) - 8, np.uint64)
    for k in range(8):
        word |= raw[k : len(raw) - 8 + k].astype(np.uint64) << np.uint64(8 * k)
    size = 1 << BITS
    first = np.concatenate([[0], np.cumsum(n_px)])
    colour, src = np.zeros(int(first[-1]) + 1, np.int32), np.arange(int(first[-1]) + 1, dtype=np.int32)
    pos, base = start[:-1] * 8 + np.array([x[3] for x in images]), np.arange(len(images)) * 4 * size
    at, stop, lane = first[:-1].copy(), first[1:].copy(), np.arange(len(images))
    last_bit = start[1:] * 8
    near = np.array(vp8l._NEAR)
    copies: list[tuple[np.ndarray, ...]] = []
    entries: list[tuple[np.ndarray, ...]] = []
    mask = np.uint64(size - 1)
    ends, alive, nowhere = np.zeros(len(images), np.int64), np.ones(len(images), np.int64), len(colour) - 1
    n_alive, with_entries, base_r, base_b = len(lane), any(x[7] for x in images), base + size, base + 2 * size
    while n_alive >= FEW:
        v = word.take(pos >> 3, mode="clip") >> (pos & 7).view(np.uint64)
        e = table.take(base + (v & mask).view(np.int64), mode="clip")
        symbol, step = e >> 4, e & 15
        rest = v >> step.astype(np.uint64)
        r = table.take(base_r + (rest & mask).view(np.int64), mode="clip")
        own = r & 15
        rest >>= own.astype(np.uint64)
        b = table.take(base_b + (rest & mask).view(np.int64), mode="clip")
        colour[at] = (r >> 4).astype(np.int32) << 16 | symbol << 8 | b >> 4
        bits, go = (step + own + (b & 15)).astype(np.int64), alive.copy()
        odd = ((symbol > 255) & (alive > 0)).nonzero()[0]
        if len(odd):
            s = symbol[odd].astype(np.int64)
            if with_entries:
                entry = s >= 280
                bits[odd[entry]] = step[odd[entry]]
                entries.append((at[odd[entry]], s[entry] - 280))
                odd, s = odd[~entry], s[~entry]
            s, o, p, t = s - 256, odd, at[odd], v[odd] >> step[odd].astype(np.uint64)
            length, extra = _extended(s, t)
            t = t >> extra.astype(np.uint64)
            d = table[base[o] + 3 * size + (t & mask).astype(np.int64)].astype(np.int64)
            far, more = _extended(d >> 4, t >> (d & 15).astype(np.uint64))
            short = near[np.minimum(far, 120) - 1]
            far = np.where(far > 120, far - 120, np.maximum(1, short[:, 0] + short[:, 1] * widths[lane[o]]))
            if (far > p - first[lane[o]]).any() or (p + length > stop[o]).any():
                raise ValueError("a back-reference leaves the image")
            copies.append((p, length, far))
            bits[o] = step[o] + extra + (d & 15) + more
            go[o] = length
        pos = pos + bits
        at = at + go
        done = ((at >= stop) & (alive > 0)).nonzero()[0]
        if len(done):
            ends[lane[done]] = pos[done]
            alive[done], at[done] = 0, nowhere
            n_alive -= len(done)
            if n_alive * 8 < 7 * len(lane):  # those that have ended write nowhere until there are enough of them
                left = alive.nonzero()[0]
                lane, pos, base, at, stop, alive = lane[left], pos[left], base[left], at[left], stop[left], alive[left]
                base_r, base_b = base + size, base + 2 * size
    if (ends > last_bit).any():
        raise ValueError("the stream ends too early")
    _point(src, copies)
    if entries:
        at, index = (np.concatenate(x) for x in zip(*entries))
        if len(at):
            hashed = np.zeros(len(colour), np.int64)
            cache = np.array([x[7] for x in images])
            own = np.repeat(np.arange(len(images)), n_px)
            alpha = np.array([x[6] for x in images])[own]
            bits = cache[own]
            literal = (colour[:-1].astype(np.int64) | alpha << 24) * np.int64(vp8l._HASH) & 0xFFFFFFFF
            hashed[:-1] = literal >> (32 - bits)
            hashed[at] = index
            with_cache = np.flatnonzero(bits > 0)
            key = own[with_cache] << CACHE_BITS | hashed[src[with_cache]]
            order = np.argsort(key, kind="stable")
            before = np.full(len(colour), -1, np.int64)
            same = key[order[1:]] == key[order[:-1]]
            before[with_cache[order[1:][same]]] = with_cache[order[:-1][same]]
            blank = at[before[at] < 0]
            src[at] = before[at]
            src[blank] = nowhere  # an entry that nothing has set is 0
            colour[nowhere] = 0
            _follow(src)
    rgb = colour[src[:-1]]
    out = np.stack([(rgb >> s & 255).astype(np.uint8) for s in (16, 8, 0)], axis=1)
    unread = set(lane[alive > 0].tolist())
    return [None if k in unread else out[x:y] for k, (x, y) in enumerate(zip(first[:-1], first[1:]))]


def _point(src: np.ndarray, copies: list[tuple[np.ndarray, ...]]) -> None:
    """Let copied pixels point to the pixels that they are copies of, and follow them."""
    if not copies:
        return
    at, length, far = (np.concatenate(x) for x in zip(*copies))
    if len(at):
        to = np.repeat(at, length) + (np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length))
        src[to] = to - np.repeat(far, length)
        _follow(src)


def _follow(src: np.ndarray) -> None:
    moving = np.flatnonzero(src != np.arange(len(src)))
    while len(moving):
        now = src[moving]
        to = src[now]
        change = to != now
        src[moving] = to
        moving = moving[change]
