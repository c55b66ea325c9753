"""Language identification: known words first, then ever shorter character n-grams.

A word (a run of letters, lower-cased) that the training text knows votes with its log
frequency in each language.  Any other word falls back to its character n-grams, word
ends marked, from five letters down to one: the longest order of which any n-gram is
known votes with the mean log frequency of the known ones.  Frequencies are smoothed by
``SMOOTH`` counts.  The language with the largest sum wins; ``score`` is its softmax share
over the mean votes.

The model is fitted on a bounded sample, ``MAX_ROWS`` rows of a language in expectation,
chosen by a hash of the id; it keeps every word and n-gram of their whole texts, with the
languages each occurs in, so its size follows the sample and not the table, and it is
broadcast.  Prediction reads whole texts of all rows, of any length.

Nulls, empty texts and texts without letters give ``und`` with score 0.  Rows with a
null language or text teach nothing; labels may be any strings, in any number.  Without any
training row all is ``und``, and an empty table gives no rows.  Repeated rows give a row each
and teach as often as they stand there; ties go to the language first in the alphabet.  Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textbatch as tb
from docloom.llm.tables import crc32_of_id, table, written

MAX_ROWS = 2000
MAX_ORDER = 5
SMOOTH = 0.5
_EDGE = 0x20


@dataclass
class Level:
    """Words (order 0) or n-grams of one order: which languages know each, and how much more that votes than not to know it."""

    keys: np.ndarray  # sorted hashes
    first: np.ndarray  # the first cell of each key, and the end
    lang: np.ndarray  # by cell
    more: np.ndarray  # by cell
    none: np.ndarray  # log frequency of what a language doesn't know, by language

    def votes(self, at: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Sums by row and language of the weighted votes of the keys at these places."""
        n_lang, size = len(self.none), self.first[at + 1] - self.first[at]
        bound = np.cumsum(size) - size
        cell = np.arange(int(size.sum())) + np.repeat(self.first[at] - bound, size)
        to, w = np.repeat(row, size) * n_lang + self.lang[cell], np.repeat(weight, size)
        sums = np.bincount(to, self.more[cell] * w, n * n_lang).reshape(n, n_lang)
        return sums + np.bincount(row, weight, n)[:, None] * self.none[None, :]


@dataclass
class Model:
    langs: list[str]
    levels: list[Level]  # by order, 0 for whole words


@lru_cache(1)
def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point of the first plane: is it a letter, and its lower case."""
    chars = [chr(c) for c in range(1 << 16)]
    lower = [c.lower() for c in chars]
    return np.array([c.isalpha() for c in chars]), np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(lower)], np.uint32)


def _letters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points; start, end and row of each run of letters."""
    alpha, lower = _letter_tables()
    code = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    near = np.minimum(code, 0xFFFF)
    is_letter = alpha[near]
    low = lower[near]
    far = np.flatnonzero(code > 0xFFFF)
    if len(far):
        is_letter[far] = [chr(c).isalpha() for c in code[far].tolist()]
        low[far] = code[far]
    return low, *tb.spans(is_letter, lead[off])


def _padded(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given words one after another with an edge mark on both sides, and their bounds."""
    size = end - start + 2
    bound = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(bound[-1]) - np.repeat(bound[:-1] + 1 - start, size)
    out = low[np.clip(at, 0, len(low) - 1)] if len(low) else np.zeros(0, np.uint32)
    out[bound[:-1]] = _EDGE
    out[bound[1:] - 1] = _EDGE
    return out, bound


def _grams(code: np.ndarray, bound: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word index of each n-gram of the padded words (for order 1, edges are left out)."""
    word = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    at = np.arange(max(0, len(code) - order + 1))
    at = at[word[at] == word[at + order - 1]]
    if order == 1:
        at = at[code[at] != _EDGE]
    return tb.span_hashes(code, at, at + order), word[at]


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def _counts(rows: DataFrame) -> DataFrame:
    """(lang, ord, h, n): word (ord 0) and n-gram counts, summed within each run before they leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for i, j, buf, off in tb.text_runs(batch.column(1)):
                low, start, end, row = _letters(buf, off)
                if not len(start):
                    continue
                names, lang_of = np.unique(langs[i:j], return_inverse=True)
                code, bound = _padded(low, start, end)
                for order in range(MAX_ORDER + 1):
                    if order:
                        h, word = _grams(code, bound, order)
                    else:
                        h, word = tb.span_hashes(low, start, end), np.arange(len(start))
                    of = lang_of[row[word]]
                    for k, name in enumerate(names):
                        seen, n = np.unique(h[of == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(np.full(len(seen), order, np.int32)), pa.array(tb.signed(seen)), pa.array(n.astype(np.int64))], names=["lang", "ord", "h", "n"])

    return rows.mapInArrow(run, "lang string, ord int, h long, n long").groupBy("lang", "ord", "h").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, lang: Column, text: Column, key: Column, max_rows: int = MAX_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows; ``key`` is hashed to choose them."""
    known = rows.select(lang.alias("lang"), text.alias("text"), key.alias("k")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], [])
    share = F.create_map(*[F.lit(x) for s in langs for x in (s, min(1.0, max_rows / sizes[s]))])
    drawn = F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share[F.col("lang")]
    place = F.create_map(*[F.lit(x) for k, s in enumerate(langs) for x in (s, k)])
    counts = written(_counts(known.filter(drawn).select("lang", "text")).select(place[F.col("lang")].alias("lang"), "ord", "h", "n"), "langid-counts")
    levels = []
    for order in range(MAX_ORDER + 1):
        got = counts.filter(F.col("ord") == order).select("lang", "h", "n").toArrow()
        h, of, n = got["h"].to_numpy().view(np.uint64), got["lang"].to_numpy(), got["n"].to_numpy()
        by = np.lexsort((of, h))
        h, of, n = h[by], of[by], n[by]
        keys, first = np.unique(h, return_index=True)
        total = np.log(np.bincount(of, n, len(langs)) + SMOOTH * (len(keys) + 1))
        none = np.log(SMOOTH) - total
        levels.append(Level(keys, np.append(first, len(h)), of.astype(np.int32), (np.log(n + SMOOTH) - np.log(SMOOTH)).astype(np.float32), none))
    return Model(langs, levels)


def _votes(model: Model, buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of votes by row and language, votes by row, words by row."""
    low, start, end, row = _letters(buf, off)
    h = tb.span_hashes(low, start, end)
    seen, of = np.unique(h, return_inverse=True)
    at = _find(model.levels[0].keys, seen)[of]
    known = at >= 0
    sums = model.levels[0].votes(at[known], row[known], np.ones(int(known.sum())), n)
    got = np.bincount(row[known], minlength=n)
    left = np.flatnonzero(~known)
    for order in range(MAX_ORDER, 0, -1):
        if not len(left):
            break
        code, bound = _padded(low, start[left], end[left])
        h, word = _grams(code, bound, order)
        at = _find(model.levels[order].keys, h)
        word, at = word[at >= 0], at[at >= 0]
        n_known = np.bincount(word, minlength=len(left))
        sums += model.levels[order].votes(at, row[left[word]], 1.0 / n_known[word], n)
        got += np.bincount(row[left[n_known > 0]], minlength=n)
        left = left[n_known == 0]
    return sums, got, np.bincount(row, minlength=n)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for i, j, buf, off in tb.text_runs(batch.column(1)):
                n = j - i
                pick, score = np.full(n, len(m.langs)), np.zeros(n)
                if m.langs:
                    sums, got, n_words = _votes(m, buf, off, n)
                    mean = sums / np.maximum(got, 1)[:, None]
                    p = np.exp(mean - mean.max(axis=1, keepdims=True))
                    best = np.argmax(mean, axis=1)
                    has = n_words > 0
                    pick[has] = best[has]
                    score[has] = (p[np.arange(n), best] / p.sum(axis=1))[has]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(names[pick], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_of_id("doc_id") % 3 == 1, F.lit(False))
    model = fit(docs.filter(~held_out), F.col("lang"), F.col("text"), F.col("doc_id"))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
