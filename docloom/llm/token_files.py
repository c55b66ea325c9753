"""Token-id files: ids of all documents in ascending doc_id order, in context-mixed blocks.

Writing: rows are range-partitioned and sorted by doc_id (then by a hash of the text, so
one id with many texts is split too), encoded with the tokenizers library, ended with
``end_id`` and cut into segments of whole documents; a segment's ids are coded in blocks of
``MAX_BLOCK`` ids, each reset and checksummed by itself (see ``cm_coder``).  A file row is
one segment: its partition and place in it, the documents' ids and lengths and the coded
blocks.  The files are Spark-written Parquet in the shared folder, so any executor can read
any of them again.

Encoding remembers the ids of stretches: the pre-tokenizer of byte-level files never
matches white space behind another character, nor a punctuation mark behind a letter or
digit, so there always starts a new pre-token, and the stretches between such places are
encoded independently by the library itself: new ones that begin with white space and end with none
stand behind one another in one text, whose ids are cut by the bytes of their tokens.  Files of another
kind get whole texts.  Strings of special tokens in a text become those tokens, as the library does by default.

Null texts are empty documents of one id, the end id.  Repeated rows give a document
each; equal doc_ids, nulls first among all, stand in the order of their texts' hashes.  An
empty table gives no rows.  Texts may have any length; they are never cut.  Other columns of
the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import cm_coder
from docloom.llm import textbatch as tb
from docloom.llm.tables import table, written

SEGMENT_IDS = 1 << 15
LANES = 4096
RUN_BYTES = 1 << 23
JOINED_BYTES = 1 << 18
MEMO = 1_200_000
MEMO_IDS = 12_000_000
_FILE = "part int, base long, n_ids long, doc_ids array<long>, lengths array<int>, blocks array<binary>"
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_BEFORE, _LAST = np.zeros(256, bool), np.zeros(256, bool)  # the last two bytes of white space beyond ASCII are such a pair
_BEFORE[[0xC2, 0x80, 0x81, 0x9A]] = True
_LAST[[*range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


_ALNUM = np.zeros(256, bool)
_ALNUM[[*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True


def _maybe_white(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether white space may end with these last two bytes."""
    return _WHITE[last] | _BEFORE[before] & _LAST[last]


def _stretches(buf: np.ndarray, off: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """First bytes of the stretches: of each text, at ASCII white space behind what is surely none, and at marks behind letters or digits."""
    kinds = (_WHITE | marks << 1).astype(np.uint8).tobytes()
    head = np.frombuffer(bytearray(buf.tobytes().translate(kinds)), np.uint8)
    at = np.flatnonzero(head[1:]) + 1
    last = buf[at - 1]
    head[at] = np.where(head[at] == 1, ~_maybe_white(buf[np.maximum(at - 2, 0)], last), _ALNUM[last])
    head[:1] = 0
    starts = off[:-1]
    head[starts[starts < len(buf)]] = 1
    return np.flatnonzero(head)


class TextEncoder:
    """The tokenizers library, remembering the ids of stretches."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task is the unit of parallel work; the library's threads wait busily
        self._t = Tokenizer.from_file(path)
        spec = json.loads(self._t.to_str())
        kind = spec["pre_tokenizer"] or {}
        self._by_stretch = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not spec["normalizer"] and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
        self._marks = np.zeros(256, bool)
        self._marks[[c for c in range(33, 127) if not chr(c).isalnum() and not any(chr(c) in x["content"] for x in spec["added_tokens"])]] = True
        self._bytes = np.zeros(0, np.int64)  # of each token
        if self._by_stretch:
            sizes = {i: len(token) for token, i in self._t.get_vocab(with_added_tokens=False).items()}  # a sign of a byte-level token stands for a byte
            sizes |= {x["id"]: len(x["content"].encode()) for x in spec["added_tokens"]}
            self._bytes = np.zeros(max(sizes) + 1, np.int64)
            self._bytes[list(sizes)] = list(sizes.values())
        self._forget()

    def _forget(self) -> None:
        self._known = pa.array([], pa.large_binary())
        self._ids, self._bound, self._runs = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _forget_rare(self) -> None:
        """Only what occurred in more than one run since the last time is kept, if that is not too much itself."""
        keep = np.flatnonzero(self._runs > 1)
        size = np.diff(self._bound)[keep]
        if len(keep) > MEMO // 2 or int(size.sum()) > MEMO_IDS // 2:
            return self._forget()
        self._known = self._known.take(pa.array(keep))
        bound = np.concatenate([[0], np.cumsum(size)])
        self._ids = self._ids[np.arange(bound[-1]) + np.repeat(self._bound[keep] - bound[:-1], size)]
        self._bound, self._runs = bound, np.zeros(len(keep), np.int32)

    def _apart(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self._t.encode_batch_fast(stretches.cast(pa.large_string()).to_pylist(), add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64)

    def _together(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For stretches that begin with white space and end with none: encoded as one text, cut where their bytes end."""
        ends = np.frombuffer(stretches.buffers()[1], np.int64)[stretches.offset :][: len(stretches) + 1]
        text = bytes(memoryview(stretches.buffers()[2])[ends[0] : ends[-1]]).decode()
        ids = np.array(self._t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        done = np.cumsum(self._bytes[ids])
        last = np.searchsorted(done, ends[1:] - ends[0])
        if not len(done) or done[-1] != ends[-1] - ends[0] or np.any(done[last] != ends[1:] - ends[0]):
            return self._apart(stretches)  # a token of unknown length
        return ids, np.diff(last, prepend=-1)

    def _library(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of these stretches, one after another, and how many each has."""
        if not self._by_stretch:
            return self._apart(new)
        ends = np.frombuffer(new.buffers()[1], np.int64)[new.offset :][: len(new) + 1]
        buf = np.frombuffer(new.buffers()[2], np.uint8)
        whole = _WHITE[buf[ends[:-1]]] & ~_maybe_white(buf[np.maximum(ends[1:] - 2, 0)], buf[ends[1:] - 1])
        size, own = np.zeros(len(new), np.int64), np.flatnonzero(whole)
        joined, parts = new.filter(pa.array(whole)), []
        at = np.cumsum(np.diff(ends)[own])
        cuts = np.unique(np.searchsorted(at, np.arange(0, int(at[-1]) if len(at) else 0, JOINED_BYTES), "right"))
        for a, b in zip(cuts, [*cuts[1:], len(own)]):
            ids, size[own[a:b]] = self._together(joined.slice(a, b - a))
            parts.append(ids)
        rest, size[~whole] = self._apart(new.filter(pa.array(~whole)))
        flat = np.concatenate([*parts, rest])
        order = np.concatenate([own, np.flatnonzero(~whole)])
        start = np.zeros(len(new), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return flat[np.arange(len(flat)) + np.repeat(start - (np.cumsum(size) - size), size)], size

    def _places(self, stretches: pa.Array) -> np.ndarray:
        """Where the ids of each of these are remembered; unknown ones are encoded first."""
        at = pc.index_in(stretches, value_set=self._known)
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        if at.null_count:
            new = stretches.filter(pc.is_null(at))
            ids, size = self._library(new)
            place[place < 0] = np.arange(len(new)) + len(self._known)
            self._known = pa.concat_arrays([self._known, new])
            self._ids = np.concatenate([self._ids, ids])
            self._bound = np.concatenate([self._bound, self._bound[-1] + np.cumsum(size)])
            self._runs = np.concatenate([self._runs, np.zeros(len(new), np.int32)])
        self._runs[place] += 1
        return place

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all these texts, one after another, and where each text's begin and end."""
        at = _stretches(buf, off, self._marks) if self._by_stretch else np.unique(off[:-1][off[:-1] < len(buf)])
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        ends = pa.py_buffer(np.append(at, len(buf)))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, ends, pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        place = self._places(parts.dictionary)[parts.indices.to_numpy()]
        start = self._bound[:-1].astype(np.int32)[place]
        size = np.diff(self._bound).astype(np.int32)[place]
        bound = np.concatenate([[0], np.cumsum(size)])
        shift = np.repeat(start - bound[:-1].astype(np.int32), size)
        shift += np.arange(len(shift), dtype=np.int32)
        ids = self._ids[shift]
        if len(self._known) > MEMO or len(self._ids) > MEMO_IDS:
            self._forget_rare()
        return ids, bound[np.searchsorted(at, off)]


@lru_cache(2)
def _encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def _groups(blocks: list) -> Iterator[list]:
    """Blocks that are coded together, of even number: up to an eighth beyond ``LANES``, as a small rest takes as many steps."""
    n = max(1, -(-len(blocks) // (LANES + LANES // 8)))
    for k in range(n):
        yield blocks[len(blocks) * k // n : len(blocks) * (k + 1) // n]


def _flush(segments: list[tuple[list[int], list[np.ndarray]]], part: int, base: int) -> Iterator[pa.RecordBatch]:
    """Code the blocks of several segments together; a row for each."""
    blocks, rows = [], []
    for docs, ids in segments:
        flat = np.concatenate(ids)
        cut = [flat[i : i + cm_coder.MAX_BLOCK] for i in range(0, len(flat), cm_coder.MAX_BLOCK)]
        rows.append((base, len(flat), docs, [len(x) for x in ids], len(blocks), len(blocks) + len(cut)))
        blocks += cut
        base += len(flat)
    coded = []
    for group in _groups(blocks):
        coded += cm_coder.encode(group)
    for base_, n, docs, lengths, a, b in rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([base_]), pa.array([n]), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([coded[a:b]], pa.list_(pa.binary()))],
            names=["part", "base", "n_ids", "doc_ids", "lengths", "blocks"],
        )


def write_token_files(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and return them as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base = TaskContext.get().partitionId(), 0
        enc = _encoder(path)
        segments, n_blocks = [], 0
        names, ids, n = [], [], 0
        for batch in batches:
            own_names = batch.column(0).to_pylist()
            for i, _, buf, off in tb.text_runs(batch.column(1), RUN_BYTES):
                flat, bound = enc.encode(buf, off)
                for k in range(len(bound) - 1):
                    own = np.append(flat[bound[k] : bound[k + 1]], np.uint32(end_id))
                    names.append(own_names[i + k])
                    ids.append(own)
                    n += len(own)
                    if n < SEGMENT_IDS:
                        continue
                    segments.append((names, ids))
                    n_blocks += -(-n // cm_coder.MAX_BLOCK)
                    names, ids, n = [], [], 0
                    if n_blocks >= LANES:
                        yield from _flush(segments, part, base)
                        base += sum(len(x) for _, s in segments for x in s)
                        segments, n_blocks = [], 0
        if ids:
            segments.append((names, ids))
        if segments:
            yield from _flush(segments, part, base)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return written(dealt.select("doc_id", "text").mapInArrow(run, _FILE), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids as little-endian 32-bit binary): every document, start counts all ids before it."""
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row a partition
    before, starts = 0, {}
    for r in sizes:
        starts[r.part] = before
        before += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        n_blocks = 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(("part", "base", "n_ids", "doc_ids", "lengths", "blocks"))}
                rows.append(row)
                n_blocks += len(row["blocks"])
                if n_blocks >= LANES:
                    yield from _documents(rows, starts)
                    rows, n_blocks = [], 0
        yield from _documents(rows, starts)

    return files.select("part", "base", "n_ids", "doc_ids", "lengths", "blocks").mapInArrow(run, "doc_id long, start long, ids binary")


def _documents(rows: list[dict], starts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    blocks = [b for r in rows for b in r["blocks"]]
    ids: list[np.ndarray] = []
    for group in _groups(blocks):
        ids += cm_coder.decode(group)
    at = 0
    for r in rows:
        own = np.concatenate(ids[at : at + len(r["blocks"])])
        at += len(r["blocks"])
        if len(own) != r["n_ids"]:
            raise ValueError("a segment has lost ids")
        end = np.cumsum(r["lengths"])
        start = end - r["lengths"]
        raw = own.astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(r["doc_ids"], pa.int64()), pa.array(start + (starts[r["part"]] + r["base"])), pa.array([raw[4 * a : 4 * b] for a, b in zip(start.tolist(), end.tolist())], pa.binary())],
            names=["doc_id", "start", "ids"],
        )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    docs = read_token_files(files)
    return docs.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
