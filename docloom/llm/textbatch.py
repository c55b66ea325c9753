"""Batch text kernels shared by the operators: numpy over Arrow string buffers.

A column batch is cut into runs of whole rows of about ``CHUNK_BYTES`` so that the
working arrays of a task stay small whatever the batch size is; a row longer than
that is a run of its own.  Texts are never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
FRUGAL = 16

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim  # of the C library on Linux
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return freed memory to the system: workers stay, and what one step has freed the next one's JVM may need."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives back what it has freed, after every ``FRUGAL`` batches and at its end."""

    @wraps(run)
    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(run(batches), 1):
            yield batch
            if k % FRUGAL == 0:
                give_back()
        give_back()

    return done


def word_table() -> np.ndarray:
    """Byte -> lower-cased byte for word bytes (0-9, A-Z, a-z, all from 0x80), else 0."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            table[b] = c
    return table


WORD = word_table()


def column_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def text_runs(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for each run of a string column."""
    buf, off = column_buffer(col)
    for i, j in runs(off, limit):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


def spans(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of true bytes; rows never share a run."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    head = np.empty(n, bool)
    head[0] = True
    np.not_equal(mask[1:], mask[:-1], out=head[1:])
    edges = off[:-1]
    head[edges[edges < n]] = True
    at = np.flatnonzero(head)
    end = np.append(at[1:], n)
    keep = mask[at]
    at, end = at[keep], end[keep]
    return at, end, np.searchsorted(off, at, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, p in enumerate((_P, _PINV)):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS[0], _POWERS[1]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
        out += h[j : j + n]
    return mix(out)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (0 where no word is), and start, end and row of each word."""
    low = WORD[buf]
    return low, *spans(low != 0, off)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def group_bounds(row: np.ndarray, n_rows: int) -> np.ndarray:
    """First position of each row in a sorted row index; n_rows + 1 values."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def arrow_lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """List array of values[bounds[i]:bounds[i+1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def lowered(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes with A-Z at these places in lower case."""
    out = buf.copy()
    out[at] = np.where((out[at] >= 65) & (out[at] <= 90), out[at] + 32, out[at])
    return out
