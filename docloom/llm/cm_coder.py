"""Adaptive context-mixing range coder for token ids, many blocks in lockstep.

A block of ids is coded on its own: the model starts anew, and a CRC-32 of the ids stands
in its header, beside the sorted list of the ids that occur.  Three predictors are mixed
into one distribution over these ids for each position:

* order 2: the id last confirmed after the two last ids (hashed table with confidence),
* order 1: the id last confirmed after the last id,
* order 0: adaptive frequencies, summed up anew whenever the coded part has doubled.

The mixing weights are hit rates, kept for each pair of confidences and for whether the
two single predictions agree; like the frequencies they are renewed as the block goes on.  The mixture drives a range coder with 48-bit
registers and 16-bit words; carries run through the words at the end of a block, so a step
puts out one word at most, and the decoder keeps only the distance of code and low end.
Quotients come from doubles: operands below 1 << 48 and quotients below 1 << 16 make their
floors exact, so the decoder repeats the encoder on any machine.  Blocks are independent,
so numpy works on one position of all of them at a time.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMX3"
_HEAD = struct.Struct("<4sIIIII")  # magic, ids, crc32 of the ids, ids of its own, bytes of their list, 16-bit words
MAX_BLOCK = 2048
FIRST_REBUILD = 16
_SLOT_BITS = 10
_GAIN = 8
_ROWS = 64  # positions that the encoder mixes at a time, and that the weights take in
_SLAB = 256  # blocks whose distributions are made at a time
_P0 = 11  # order-0 frequencies add up to 1 << 11, as many as a block can have ids of its own
_DENSE = 1 << 20
_FULL = (1 << 48) - 1
_LEAST = 1 << 32


def _pack_ids(own: np.ndarray) -> bytes:
    """Sorted distinct ids as gaps: a byte each, and four bytes behind them for each gap of 255 or more."""
    gaps = own.copy()
    gaps[1:] -= own[:-1] + 1
    far = gaps[gaps >= 255]
    return np.minimum(gaps, 255).astype(np.uint8).tobytes() + far.astype("<u4").tobytes()


def _unpack_ids(data: bytes, n: int) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8, n).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data, "<u4", -1, n)
    return np.cumsum(gaps + 1) - 1


def _turned(table: np.ndarray) -> np.ndarray:
    """Rows as columns, some rows at a time."""
    out = np.empty(table.shape[::-1], table.dtype)
    for i in range(0, len(table), _ROWS):
        out[:, i : i + _ROWS] = table[i : i + _ROWS].T
    return out


class _Places:
    """Distinct ids of a block and the place of each of its ids among them, from 1."""

    def __init__(self) -> None:
        self.place = np.zeros(_DENSE, np.int32)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(ids) or int(ids.max()) >= _DENSE:
            own, at = np.unique(ids, return_inverse=True)
            return own, at + 1
        sorted_ = np.sort(ids.astype(np.int32))
        first = np.ones(len(ids), bool)
        np.not_equal(sorted_[1:], sorted_[:-1], out=first[1:])
        own = sorted_[first]
        self.place[own] = np.arange(1, len(own) + 1)
        return own, self.place[ids]


class _Slots:
    """The ids last seen behind one and behind two ids, for ``lanes`` blocks; a step reads and renews both slots of each.

    A slot holds id << 2 | confidence, from 1 to 3 as hits follow one another; 0 is empty.
    Ids are places in the blocks' own id lists, 0 stands for none.
    """

    def __init__(self, lanes: int, width: int):
        lane = np.arange(lanes)
        self.table = np.zeros(lanes * width + (lanes << _SLOT_BITS), np.uint16)
        self.base = np.stack([lane * width, lanes * width + (lane << _SLOT_BITS)])
        self.key, self.hashed = np.zeros((2, lanes), np.uint16), np.zeros(lanes, np.uint16)  # of the last id: times 40503

    def look(self, a: int) -> np.ndarray:
        """The slots of the first ``a`` blocks, a row for each order."""
        self.at = self.base[:, :a] + self.key[:, :a]
        return self.table.take(self.at, mode="clip")

    def renew(self, ids: np.ndarray, slots: np.ndarray) -> None:
        """slots: as looked up."""
        a, new = len(ids), ids << 2
        sure = slots ^ new
        hit = sure < 4  # the slot has this id
        np.minimum(sure, 2, out=sure)
        sure *= hit
        sure += new | 1
        self.table[self.at] = sure
        self.key[0, :a] = ids
        np.bitwise_and(self.hashed[:a] + ids, (1 << _SLOT_BITS) - 1, out=self.key[1, :a])
        np.multiply(ids, 40503, out=self.hashed[:a])  # low 16 bits


def _state(s: np.ndarray, agree: np.ndarray) -> np.ndarray:
    sure = s & 3
    state = sure[1] << 2
    state |= sure[0]
    state |= agree.view(np.uint8) << 4
    return state


class _Mixture:
    """Order-0 distribution and the weights of the three predictors, renewed when the coded part has doubled."""

    def __init__(self, own: np.ndarray, longest: int, decoding: bool):
        lanes, self.width = len(own), int(own.max(initial=1)) + 1
        self.decoding, self.summed = decoding, 0
        lane = np.arange(lanes)
        place = np.arange(self.width, dtype=np.int32)[None, :]
        self.own = own.astype(np.int32)[:, None]
        self.count = ((place > 0) & (place <= self.own)).astype(np.int32)
        self.cum, self.slot = np.zeros(self.count.size, np.uint16), np.zeros(lanes << _P0 if decoding else 0, np.uint16)
        self.base_cum, self.base_state, self.base_slot = lane * self.width, lane * 32, lane << _P0
        self.tally = np.zeros((lanes, 32, 3), np.int64)  # none, only order 1, order 2 was right
        self.ids, self.slots = np.zeros((longest, lanes), np.uint16), np.zeros((2, longest, lanes), np.uint16)
        self.renew(0)

    def renew(self, upto: int) -> None:
        """Take in the positions before ``upto``."""
        for lane in range(0, len(self.own), _SLAB):
            self._distribute(slice(lane, lane + _SLAB), slice(self.summed, upto))
        for i in range(self.summed, upto, _ROWS):
            part = slice(i, min(i + _ROWS, upto))
            ids, s = self.ids[part], self.slots[:, part]
            p1, p2 = s >> 2
            hit2 = p2 == ids
            kind = (p1 == ids).view(np.uint8) | hit2.view(np.uint8) << 1
            np.minimum(kind, 2, out=kind)
            at = (_state(s, p1 == p2) + self.base_state.astype(np.int32)) * 3 + kind
            self.tally += np.bincount(at.ravel(), minlength=self.tally.size).reshape(self.tally.shape)
        self.summed = max(self.summed, upto)
        n, state = self.tally.sum(axis=2) + 2, np.arange(32)
        w2 = (self.tally[:, :, 2] * 4 + 2) * (7 << 11) // n * (state >> 2 & 3 > 0)
        w1 = (self.tally[:, :, 1] * 4 + 1) * (7 << 11) // n * (state & 3 > 0)
        self.w2, self.w12 = w2.astype(np.int32).ravel(), (w2 + w1).astype(np.int32).ravel()

    def _distribute(self, lanes: slice, new: slice) -> None:
        """Take these positions into the order-0 distributions of some blocks, so few that their tables stay near."""
        count, own, place = self.count[lanes], self.own[lanes], np.arange(self.width, dtype=np.int32)
        at = _turned(self.ids[new, lanes]) + self.base_cum[: len(own), None]
        counted = np.bincount(at.ravel(), minlength=count.size).reshape(count.shape)
        counted *= _GAIN
        count += counted
        count[:, 0] = 0
        sums = np.cumsum(count, axis=1, dtype=np.int32)
        share = ((1 << _P0) - own) / np.maximum(sums[:, -1:], 1)
        cum = (sums * share).astype(np.int32)
        cum += np.minimum(place, own)
        cum[place >= own] = 1 << _P0
        cum[:, 0] = 0
        self.cum.reshape(self.count.shape)[lanes] = cum
        if self.decoding:
            places = np.broadcast_to(place[1:].astype(np.uint16), (len(own), self.width - 1))
            self.slot.reshape(-1, 1 << _P0)[lanes] = np.repeat(places.ravel(), np.diff(cum, axis=1).ravel()).reshape(-1, 1 << _P0)

    def order0(self, at: np.ndarray, w12: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids at these cells within what the single predictions leave."""
        w0 = (1 << 16) - w12
        from0 = self.cum.take(at - 1, mode="clip") * w0 >> _P0
        return w12 + from0, (self.cum.take(at, mode="clip") * w0 >> _P0) - from0


def _due(i: int) -> bool:
    return i >= FIRST_REBUILD and not i & (i - 1)


def _running(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks from long to short, and for each step how many are still running."""
    order = np.argsort(-np.array(sizes), kind="stable")
    sorted_ = np.array(sizes)[order]
    return order, np.searchsorted(-sorted_, -np.arange(int(sorted_[0])), "left")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Header, id list and payload of each block of at most MAX_BLOCK ids below 1 << 31."""
    if not blocks:
        return []
    sizes = [len(b) for b in blocks]
    if max(sizes) > MAX_BLOCK:
        raise ValueError(f"a block has at most {MAX_BLOCK} ids")
    order, running = _running(sizes)
    lanes, longest, lists, places = len(blocks), max(sizes), [], _Places()
    whole = np.zeros((lanes, longest), np.uint16)
    for lane, b in enumerate(order):
        own, at = places.of(blocks[b])
        whole[lane, : sizes[b]] = at
        lists.append(own)
    m = _Mixture(np.array([len(x) for x in lists]), longest, False)
    m.ids = whole = _turned(whole)
    slots = _Slots(lanes, m.width)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, _FULL)
    room = longest + 4
    out, first = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room
    put, i = first.copy(), 0
    while i < longest:
        if _due(i):
            m.renew(i)
        j, top = min(longest, i + _ROWS - i % _ROWS, 2 * i if i >= FIRST_REBUILD else FIRST_REBUILD), int(running[i])
        for k in range(i, j):
            a = int(running[k])
            m.slots[:, k, :a] = found = slots.look(a)
            slots.renew(whole[k, :a], found)
        starts, widths = _intervals(m, slice(i, j), top)
        for k in range(i, j):
            a = int(running[k])
            lo, sp, p = low[:a], span[:a], put[:a]
            sp >>= 16
            lo += sp * starts[k - i, :a]
            sp *= widths[k - i, :a]
            full = (sp < _LEAST).astype(np.int64)
            digit = (lo >> 32) & -full
            out[p] = digit
            p += full
            lo -= digit << 32
            full <<= 4
            lo <<= full
            sp <<= full
        i = j
    for shift in (32, 16, 0):
        out[put] = low >> 32 if shift == 32 else (low >> shift) & 0xFFFF
        put += 1
    over = np.flatnonzero(out >> 16)
    while len(over):
        out[over] &= 0xFFFF
        out[over - 1] += 1
        over = (over - 1)[out[over - 1] >> 16 > 0]
    words, result = out.astype("<u2"), [b""] * lanes
    for lane, b in enumerate(order):
        packed = _pack_ids(lists[lane])
        crc = zlib.crc32(np.ascontiguousarray(blocks[b], "<u4").tobytes())
        result[b] = _HEAD.pack(MAGIC, sizes[b], crc, len(lists[lane]), len(packed), int(put[lane] - first[lane])) + packed + words[first[lane] : put[lane]].tobytes()
    return result


def _first_or_second(hit2: np.ndarray, w2: np.ndarray, w12: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of order 2's part or of order 1's part; by products, as choosing at random is slow."""
    start = w2 * ~hit2
    size = w2 - start
    size += (w12 - w2) * ~hit2
    return start, size


def _intervals(m: _Mixture, rows: slice, a: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size, of 1 << 16, of the ids of these positions."""
    ids, s = m.ids[rows, :a], m.slots[:, rows, :a]
    p1, p2 = s >> 2
    at = _state(s, p1 == p2) + m.base_state[:a]
    w2, w12 = m.w2.take(at, mode="clip"), m.w12.take(at, mode="clip")
    hit2 = p2 == ids
    start, size = _first_or_second(hit2, w2, w12)
    rest = (~((p1 == ids) | hit2)).ravel().nonzero()[0]
    cell = (ids + m.base_cum[:a]).ravel()[rest]
    start.ravel()[rest], size.ravel()[rest] = m.order0(cell, w12.ravel()[rest])
    return start, size


def decode(blobs: list[bytes]) -> list[np.ndarray]:
    """The blocks of ids; raises ValueError where a block's checksum or form is wrong."""
    if not blobs:
        return []
    heads = []
    for blob in blobs:
        head = _HEAD.unpack_from(blob) if len(blob) >= _HEAD.size else (b"",) * 6
        if head[0] != MAGIC or len(blob) != _HEAD.size + head[4] + 2 * head[5] or head[1] > MAX_BLOCK or not head[3] <= min(head[4], MAX_BLOCK) or (head[4] - head[3]) % 4:
            raise ValueError("not a block of ids")
        heads.append(head)
    sizes = [h[1] for h in heads]
    order, running = _running(sizes)
    lanes, longest = len(blobs), max(sizes)
    room = max(h[5] for h in heads) + 4
    data, lists = np.zeros(lanes * room, np.uint16), []
    for lane, b in enumerate(order):
        _, _, _, n_own, packed, words = heads[b]
        try:
            lists.append(_unpack_ids(blobs[b][_HEAD.size : _HEAD.size + packed], n_own))
        except ValueError:
            raise ValueError("the id list of a block is damaged") from None
        data[lane * room : lane * room + words] = np.frombuffer(blobs[b], "<u2", words, _HEAD.size + packed)
    m = _Mixture(np.array([len(x) for x in lists]), longest, True)
    slots, get = _Slots(lanes, m.width), np.arange(lanes) * room
    code, span = np.zeros(lanes), np.full(lanes, float(_FULL))  # whole numbers below 1 << 48, so doubles are exact
    for _ in range(3):
        code = code * 65536 + data[get]
        get += 1
    for i in range(longest):
        if _due(i):
            m.renew(i)
        a = int(running[i])
        m.slots[:, i, :a] = found = slots.look(a)
        p1, p2 = found >> 2
        at = _state(found, p1 == p2) + m.base_state[:a]
        w2, w12 = m.w2.take(at, mode="clip"), m.w12.take(at, mode="clip")
        co, sp, g = code[:a], span[:a], get[:a]
        sp *= 1 / 65536
        np.floor(sp, out=sp)
        v = (co / sp).astype(np.int32)
        by2 = v < w2
        start, size = _first_or_second(by2, w2, w12)
        ids = p1 ^ ((p1 ^ p2) * by2)
        rest = (v >= w12).nonzero()[0]
        w = w12[rest]
        u = (((v[rest] - w << _P0) + ((1 << _P0) - 1)) / ((1 << 16) - w)).astype(np.int64)
        u += m.base_slot[rest]
        ids[rest] = own = m.slot.take(u, mode="clip")
        start[rest], size[rest] = m.order0(m.base_cum[rest] + own, w)
        co -= sp * start
        sp *= size
        full = sp < _LEAST
        word = data.take(g, mode="clip")
        word *= full
        g += full
        grow = full * 65535.0
        grow += 1
        sp *= grow
        co *= grow
        co += word
        m.ids[i, :a] = ids
        slots.renew(ids, found)
    whole = _turned(m.ids)
    result: list[np.ndarray] = [np.zeros(0, np.int64)] * lanes
    for lane, b in enumerate(order):
        at = whole[lane, : sizes[b]].astype(np.int64) - 1
        got = lists[lane].take(at, mode="clip") if sizes[b] and len(lists[lane]) else np.zeros(0, np.int64)
        if len(got) != sizes[b] or zlib.crc32(got.astype("<u4").tobytes()) != heads[b][2]:
            raise ValueError("checksum of a block of ids is wrong")
        result[b] = got
    return result
