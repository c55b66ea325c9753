"""Media columns: texts stored as lossless WebP and read back.

A payload is the text's UTF-8 bytes and blanks up to a positive multiple of 192: rows of
64 red-green-blue pixels.  An image has at most 16,384 rows; a longer payload is a
sequence of such files, one after another.  Every image gets the transform that suits it and
back-references, and a colour cache where it helps (see ``vp8l_batch``); images of few
colours get a palette instead.  Null texts are empty.  Repeated rows give a row each, with
equal media.  Texts may have any length.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textbatch as tb
from docloom.llm import vp8l, vp8l_batch
from docloom.llm.tables import table

WIDTH = 64
UNIT = 3 * WIDTH
MAX_BYTES = UNIT * vp8l.MAX_SIDE
PALETTE = 256


def _payload_of(text: np.ndarray) -> np.ndarray:
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    out = np.full(size, 32, np.uint8)
    out[: len(text)] = text
    return out


def store(payloads: list[np.ndarray]) -> list[bytes]:
    """The media of each payload."""
    parts = [p[i : i + MAX_BYTES] for p in payloads for i in range(0, len(p), MAX_BYTES)]
    few = [_few_colours(p) for p in parts]
    others = iter(vp8l_batch.encode_many([p for p, f in zip(parts, few) if not f], WIDTH))
    files = iter([_with_palette(p) if f else next(others) for p, f in zip(parts, few)])
    return [b"".join(next(files) for _ in range(0, len(p), MAX_BYTES)) for p in payloads]


def _few_colours(payload: np.ndarray) -> bool:
    """At most ``PALETTE`` colours, and far fewer than pixels."""
    px = payload.reshape(-1, 3).astype(np.int32)
    value = px[:, 0] << 16 | px[:, 1] << 8 | px[:, 2]
    return len(np.unique(value[:512])) <= PALETTE and len(np.unique(value)) <= min(PALETTE, len(value) // 8)


def _with_palette(payload: np.ndarray) -> bytes:
    rgb = payload.reshape(-1, WIDTH, 3)
    return vp8l.encode(np.concatenate([rgb, np.full((*rgb.shape[:2], 1), 255, np.uint8)], axis=2), palette=True)


def split_files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + n])
        at += n
    return out


def load(media: list[bytes]) -> list[list[np.ndarray]]:
    """The images of each medium as pixel arrays (height, width, 4)."""
    files = [split_files(m) for m in media]
    images = iter(vp8l_batch.decode_many([f for fs in files for f in fs]))
    return [[next(images) for _ in fs] for fs in files]


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tb.text_runs(batch.column(1), tb.CHUNK_BYTES // 2):
                media = store([_payload_of(buf[a:b]) for a, b in zip(off[:-1], off[1:])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _feature(images: list[np.ndarray], payload: np.ndarray) -> str:
    """Size, channel means and a 64-bit hash of which of 8 by 8 cells lie above the mean."""
    px = payload.reshape(-1, 3)
    mean = px.mean(axis=0)
    light = px.sum(axis=1, dtype=np.int64)
    cells = np.add.reduceat(light, np.arange(64) * len(light) // 64) / np.maximum(np.diff(np.append(np.arange(64) * len(light) // 64, len(light))), 1)
    bits = int("".join("1" if c else "0" for c in (cells > cells.mean()).tolist()), 2)
    return f"{WIDTH}x{sum(len(i) for i in images)};{mean[0]:.3f},{mean[1]:.3f},{mean[2]:.3f};{bits:016x}"


def load_documents(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload, feature): the pixel bytes read back, and features of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, vp8l_batch.LANES):
                part = batch.slice(i, vp8l_batch.LANES)
                images = load(part.column(2).to_pylist())
                payloads = [np.concatenate([x[..., :3].reshape(-1) for x in im]) for im in images]
                features = [_feature(im, p) for im, p in zip(images, payloads)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([p.tobytes() for p in payloads], pa.binary()), pa.array(features)], names=["doc_id", "n_bytes", "media", "payload", "feature"])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = load_documents(store_documents(table(spark, sf_dir, "documents")))
    return got.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
