"""Markdown chunker: sections by heading, else paragraphs, else sentences, packed to a token range.

The rules are sequential within a document (a small section is carried to the next), so a
document is one small Python step inside an Arrow batch; documents are spread by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")
CHARS_A_TOKEN = 4


def token_count(text: str) -> int:
    """A quarter of the characters, at least one for any text."""
    return max(1, len(text) // CHARS_A_TOKEN) if text else 0


def _sections(text: str) -> list[tuple[str, str]]:
    out, path, lines = [], [], []

    def close() -> None:
        body = "\n".join(lines).strip()
        if body:
            out.append((" > ".join(path), body))
        lines.clear()

    for line in text.split("\n"):
        m = _HEADING.match(line)
        if m:
            close()
            del path[len(m[1]) - 1 :]
            path.append(m[2])
        lines.append(line)
    close()
    return out


def _pack(parts: list[str], joint: str, most: int) -> list[str]:
    out, now = [], ""
    for p in parts:
        both = f"{now}{joint}{p}" if now else p
        if now and token_count(both) > most:
            out.append(now)
            now = p
        else:
            now = both
    return [*out, now] if now else out


def _split(text: str, most: int) -> list[str]:
    """Paragraphs packed to the limit; larger ones by sentences; a longer sentence stays whole."""
    pieces: list[str] = []
    for p in re.split(r"\n\s*\n", text):
        p = p.strip()
        if p:
            pieces += [p] if token_count(p) <= most else _pack(re.split(r"(?<=[.!?])\s+", p), " ", most)
    return _pack(pieces, "\n\n", most)


def chunk(text: str, most: int = 800, least: int = 100) -> list[tuple[str, str]]:
    """(section hierarchy, content) of each chunk."""
    out: list[tuple[str, str]] = []
    carried = ""
    for path, body in _sections(text):
        body = f"{carried}\n\n{body}" if carried else body
        carried = ""
        if token_count(body) < least:
            carried = body
        else:
            out += [(path, c) for c in _split(body, most)]
    if carried and not out:
        out.append(("", carried))
    elif carried:
        out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{carried}")
    return out


def chunk_documents(docs: DataFrame, most: int = 800, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a chunk of each text.  No text is lost: a small last section joins the chunk before."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, c, token_count(c), path) for d, t in zip(frame[id_col], frame[text_col]) for i, (path, c) in enumerate(chunk(t or "", most, least))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "content", "token_count", "section_hierarchy"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, chunk_index int, content string, token_count int, section_hierarchy string")


def fixed_windows(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a window of ``size`` tokens, each but the first beginning ``overlap`` tokens before the end of the one before."""
    step = CHARS_A_TOKEN * (size - overlap)
    rows = docs.select(id_col, text_col, F.posexplode(F.sequence(F.lit(0), F.greatest(F.length(text_col), F.lit(1)) - 1, F.lit(step))).alias("chunk_index", "start"))
    cut = rows.select(id_col, "chunk_index", F.substr(text_col, F.col("start") + 1, F.lit(CHARS_A_TOKEN * size)).alias("content"))
    tokens = F.when(F.length("content") > 0, F.greatest(F.lit(1), F.floor(F.length("content") / CHARS_A_TOKEN))).otherwise(0).cast("int")
    return cut.select(id_col, "chunk_index", "content", tokens.alias("token_count"), F.lit("").alias("section_hierarchy"))
