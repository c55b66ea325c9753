"""Byte-level BPE by a monoid tree reduction.

Encoding halves a text until a part has at most ``leaf`` characters and encodes the parts: a
part is cut into matches of the pattern, and in each match the adjacent pair of least rank is
merged until no pair has a rank.  A join re-encodes a window around the boundary of two
neighbours.  On its left the window begins behind the last match that no character beyond
the boundary can have touched: a match is settled once ``LOOK`` characters follow it.  On its
right it ends where a settled match of the window ends at the same place as a match of the
right part: from there on both are cut alike, as a match depends on nothing before it.  The
window doubles until there is such a place or the part is at its end.  So the tokens outside
of it are provably those of the whole text, for any pattern that covers all characters,
never looks back and looks at most ``LOOK`` characters ahead of a match, and the join is
exact and associative.  Decoding halves the ids and concatenates up the tree.

The matches of a batch that are not remembered are merged in lockstep, a pair of each at a
time.

Null texts are empty and have no ids.  Repeated rows give a row each.  An empty table gives
no rows.  Texts may have any length; very long ones only take more levels.  Other columns of
the input are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textbatch as tb
from docloom.llm.tables import table

LEAF_CHARS = 512
LEAF_IDS = 1024
WINDOW = 16
LOOK = 2
BATCH_CHARS = 1 << 20
MEMO = 250_000
LOCKSTEP_BYTES = 64
FEW = 24  # matches that are sooner merged one by one
_NONE = np.iinfo(np.int32).max


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merger:
    """Merges the bytes of matches by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self._keys = np.array([k for k, _ in pairs] or [-1])
        self._merged = np.array([r for _, r in pairs] or [_NONE], np.int32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._merged[at], _NONE)

    def many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...] | None] = [None] * len(pieces)
        short = []
        for k, x in enumerate(pieces):
            whole = self.ranks.get(x)
            if whole is not None:
                out[k] = (whole,)
            elif len(x) <= LOCKSTEP_BYTES:
                short.append((len(x), k))
            else:
                out[k] = self.one(x)
        if len(short) < FEW:
            for _, k in short:
                out[k] = self.one(pieces[k])
            return out
        short.sort()
        for i in range(0, len(short), 4096):
            own = [k for _, k in short[i : i + 4096]]
            for k, ids in zip(own, self._lockstep([pieces[k] for k in own])):
                out[k] = ids
        return out

    def _lockstep(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        size = np.array([len(x) for x in pieces])
        width = int(size.max())
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(-1, width)
        ids = np.concatenate([self._byte[raw], np.zeros((len(pieces), 1), np.int32)], axis=1)
        cols = np.arange(width + 1)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        rank[cols[None, :-1] >= size[:, None] - 1] = _NONE
        rank = np.concatenate([rank, np.full((len(pieces), 1), _NONE, np.int32)], axis=1)
        done: list[tuple[int, ...] | None] = [None] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            over = best == _NONE
            if over.any():
                for k, own, n in zip(row[over].tolist(), ids[over].tolist(), size[over].tolist()):
                    done[k] = tuple(own[:n])
                left = ~over
                row, ids, rank, size, at, best = row[left], ids[left], rank[left], size[left], at[left], best[left]
                if not len(row):
                    break
            # the pair becomes one token, all behind it moves up
            from_ = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width)
            ids, rank, size = np.take_along_axis(ids, from_, 1), np.take_along_axis(rank, from_, 1), size - 1
            here = np.arange(len(row))
            ids[here, at] = best
            rank[here, at] = np.where(at + 1 < size, self._rank(best, ids[here, np.minimum(at + 1, width)]), _NONE)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self._rank(ids[before, at[before] - 1], best[before])
        return done

    def one(self, piece: bytes) -> tuple[int, ...]:
        """One long match, the next pair from a heap."""
        ranks, n = self.ranks, len(piece)
        end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int) -> int | None:
            j = nxt[i]
            return ranks.get(piece[i : end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], nxt[i], alive[j] = stop, nxt[j], False
            if nxt[j] < n:
                prv[nxt[j]] = i
            for k in (i, prv[i]):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k, end[nxt[k]]))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


Node = tuple[list[int], list[str]]  # the ids of a part, and its matches


class TreeCodec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF_CHARS):
        ranks = _ranks(path)
        self._leaf, self._merger, self._find = leaf, Merger(ranks), regex.compile(pattern).findall
        self._memo: dict[str, tuple[int, ...]] = {}
        self._token = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self._token[i] = token

    def encode(self, text: str) -> list[int]:
        return next(self.encode_many([text]))

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        if len(self._memo) > MEMO:
            self._memo.clear()
        parts = [self._matches(t[a:b]) for t in texts for a, b in self._leaves(0, len(t))]
        self._remember(set(chain.from_iterable(parts)))
        leaves = iter(parts)
        for t in texts:
            yield self._node(t, 0, len(t), leaves)[0]

    def _leaves(self, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        if hi - lo <= self._leaf:
            yield lo, hi
        else:
            mid = (lo + hi) // 2
            yield from self._leaves(lo, mid)
            yield from self._leaves(mid, hi)

    def _matches(self, text: str) -> list[str]:
        found = self._find(text)
        if sum(map(len, found)) != len(text):
            raise ValueError("the pattern must match all characters")
        return found

    def _remember(self, pieces: set[str]) -> None:
        new = [x for x in pieces if x not in self._memo]
        if new:
            self._memo.update(zip(new, self._merger.many([x.encode() for x in new])))

    def _ids(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self._memo.__getitem__, pieces)))

    def _node(self, text: str, lo: int, hi: int, leaves: Iterator[list[str]]) -> Node:
        if hi - lo <= self._leaf:
            pieces = next(leaves)
            return self._ids(pieces), pieces
        mid = (lo + hi) // 2
        left = self._node(text, lo, mid, leaves)
        return self._join(text, mid, hi, left, self._node(text, mid, hi, leaves))

    def _join(self, text: str, mid: int, hi: int, left: Node, right: Node) -> Node:
        memo, (ids, pieces), (more_ids, more) = self._memo, left, right
        keep, begin = len(pieces), mid
        while keep and begin + LOOK > mid:
            keep -= 1
            begin -= len(pieces[keep])
        reach = WINDOW
        while True:
            stop = min(hi, mid + reach)
            found = self._matches(text[begin:stop])
            ends = dict(zip(accumulate(map(len, more), initial=mid), range(len(more) + 1))) if stop == hi else self._ends(more, mid, stop)
            at = begin
            for n, x in enumerate(found, 1):
                at += len(x)
                if at >= mid and at in ends and (at + LOOK <= stop or stop == hi):
                    window, skip = found[:n], ends[at]
                    break
            else:
                reach *= 2
                continue
            break
        self._remember(set(window))
        dropped = sum(len(memo[x]) for x in pieces[keep:])
        skipped = sum(len(memo[x]) for x in more[:skip])
        del ids[len(ids) - dropped :], pieces[keep:]
        ids += self._ids(window)
        ids += more_ids[skipped:]
        pieces += window
        pieces += more[skip:]
        return ids, pieces

    @staticmethod
    def _ends(pieces: list[str], at: int, stop: int) -> dict[int, int]:
        """Place -> number of pieces that end there, up to stop."""
        out = {at: 0}
        for n, x in enumerate(pieces, 1):
            at += len(x)
            if at > stop:
                break
            out[at] = n
        return out

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self._token.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(2)
def codec(path: str, pattern: str) -> TreeCodec:
    return TreeCodec(path, pattern)


def _batches(col: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of runs of about ``BATCH_CHARS`` characters."""
    first, texts, n = 0, [], 0
    for k, t in enumerate(col):
        text = t.as_py() or ""
        if texts and n + len(text) > BATCH_CHARS:
            yield first, texts
            first, texts, n = k, [], 0
        texts.append(text)
        n += len(text)
    if texts:
        yield first, texts


def _defaults() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for i, texts in _batches(batch.column(1)):
                ids = [np.array(x, np.int32) for x in c.encode_many(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tb.frugal(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): adds the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                decoded = [c.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(tb.frugal(run), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids as little-endian 32-bit binary, decoded): encoding and decoding in one pass of one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for i, texts in _batches(batch.column(1)):
                ids, decoded = [], []
                for own in c.encode_many(texts):
                    ids.append(np.array(own, "<u4").tobytes())
                    decoded.append(c.decode(own))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tb.frugal(run), "doc_id long, ids binary, decoded binary")


def digest_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded."""
    both = round_trip(docs, *_defaults())
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
