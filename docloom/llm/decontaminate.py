"""Benchmark decontamination by winnowing.

Of every ``window`` (10) words of a text, the smallest of the hashes of their k-grams (k = 5)
is kept, the rightmost of equal ones; neighbouring windows mostly keep the same one, so about
a third of the k-grams remain as fingerprints, each with its place.  Equal windows keep the
same k-gram, so every span of ten or more shared words meets in at least one fingerprint.
Training fingerprints are first held against a Bloom filter of the benchmark's, sized by their
number.  What passes is extended to the left and right, on both sides, to the windows that hold
its k-gram, and joined on the fingerprint and the words of the whole window: that verifies and
extends at once, and as a benchmark window is a row however often it recurs, a place of a
document meets one row at most, also where one word is repeated without end.  The hit words of
a document are the union of its windows, given as ranges; which items they name is looked up
once for each document and window.  Items shorter than a window are one fingerprint of their
own length.

Nulls and texts without words have no windows: n_words 0, n_hit 0.  Items without words or
without an id never match; repeated items and rows are harmless and give one result row for
each row; rows with the same doc_id but other texts are judged apart; ties between equal
k-grams are decided alike on both sides.  Texts may have any length.  An empty benchmark hits
nothing, an empty table gives no rows.  Other columns are ignored, whatever their names, and
come back as they are from ``clean_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from docloom.llm import textbatch as tb
from docloom.llm.tables import quoted, table, whole_row, written

WINDOW = 10
KGRAM = 5
BLOOM_BITS_EACH = 16
BLOOM_HASHES = 3
MOST_BLOOM_BITS = 1 << 30  # 128 MB; a larger benchmark is joined without a filter

_PRINT = "pos int, len int, fp long, gram string, left array<string>, right array<string>"


def _kept(h: np.ndarray, row: np.ndarray, window: int, k: int) -> np.ndarray:
    """First words of the k-grams that some window keeps."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    grams = tb.gram_hashes(h, k)
    low, at = grams[:n].copy(), np.arange(n)
    for j in range(1, window - k + 1):
        less = grams[j : j + n] <= low
        low[less] = grams[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at[row[:n] == row[window - 1 : window - 1 + n]])


def _prints(h: np.ndarray, row: np.ndarray, window: int, k: int, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, length and fingerprint: kept k-grams (length ``window``), and all grams of the other sizes."""
    at = _kept(h, row, window, k)
    out = [(at, np.full(len(at), window), tb.gram_hashes(h, k)[at] if len(at) else np.zeros(0, np.uint64))]
    for size in sizes:
        grams = tb.gram_hashes(h, size)
        own = np.flatnonzero(row[: len(grams)] == row[size - 1 :][: len(grams)])
        out.append((own, np.full(len(own), size), grams[own] ^ np.uint64(size)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _print_columns(low: np.ndarray, start: np.ndarray, end: np.ndarray, bound: np.ndarray, row: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], window: int, k: int) -> list[pa.Array]:
    """The columns of ``_PRINT``; left words stand from near to far."""
    raw = low.tobytes()
    word = lambda i: raw[start[i] : end[i]].decode()
    grams, left, right = [], [], []
    for at, size in zip(found[0].tolist(), found[1].tolist()):
        n = k if size == window else size
        more = window - k if size == window else 0
        lo, hi = int(bound[row[at]]), int(bound[row[at] + 1])
        grams.append(" ".join(map(word, range(at, at + n))))
        left.append([word(i) for i in range(at - 1, max(lo, at - more) - 1, -1)])
        right.append([word(i) for i in range(at + n, min(hi, at + n + more))])
    place = found[0] - bound[row[found[0]]]
    words = pa.list_(pa.string())
    return [pa.array(place.astype(np.int32)), pa.array(found[1].astype(np.int32)), pa.array(tb.signed(found[2])), pa.array(grams, pa.string()), pa.array(left, words), pa.array(right, words)]


def _bloom_slots(fp: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    a, b = fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32)
    for j in range(BLOOM_HASHES):
        yield ((a + np.uint64(j) * b) % np.uint64(bits)).astype(np.int64)


def benchmark_filter(keys: DataFrame, most_bits: int = MOST_BLOOM_BITS) -> np.ndarray | None:
    """Bloom filter of the fp column, built by a distributed bit_or; None where it would be too large."""
    n = keys.count()
    bits = 1 << max(16, (n * BLOOM_BITS_EACH - 1).bit_length())
    if bits > most_bits:
        return None
    slots = F.explode(F.array(*[F.pmod(F.col("fp").bitwiseAND(0xFFFFFFFF) + F.lit(j) * F.shiftrightunsigned("fp", 32), F.lit(bits)) for j in range(BLOOM_HASHES)]))
    at = keys.select(slots.alias("slot"))
    cells = at.groupBy(F.shiftright("slot", 6).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("mask"))
    words = np.zeros(bits // 64, np.int64)
    got = cells.toArrow()
    words[got["cell"].to_numpy()] = got["mask"].to_numpy()
    return words


def item_prints(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """(item_id as string, pos, len, fp, gram, left, right) of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tb.text_runs(batch.column(1)):
                low, start, end, row = tb.words(buf, off)
                h, bound = tb.span_hashes(low, start, end), tb.group_bounds(row, j - i)
                n_words = np.diff(bound)
                at, size, fp = _prints(h, row, window, k, sorted({int(n) for n in n_words if 0 < n < window}))
                own = (size == window) | (n_words[row[at]] == size) if len(at) else np.zeros(0, bool)
                found = at[own], size[own], fp[own]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[found[0]] + i)), *_print_columns(low, start, end, bound, row, found, window, k)], names=["item_id", "pos", "len", "fp", "gram", "left", "right"])

    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).filter("item_id IS NOT NULL")
    return rows.mapInArrow(tb.frugal(run), f"item_id string, {_PRINT}")


def candidate_prints(docs: DataFrame, bloom: np.ndarray | None, short: list[int], window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """(doc_id, copy_key, pos, len, fp, gram, left, right) of the fingerprints that the filter lets pass; docs has doc_id, text, copy_key."""
    held = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if held.value is None else np.unpackbits(held.value.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            for i, j, buf, off in tb.text_runs(batch.column(1)):
                low, start, end, row = tb.words(buf, off)
                h, bound = tb.span_hashes(low, start, end), tb.group_bounds(row, j - i)
                at, size, fp = _prints(h, row, window, k, short)
                if bits is not None:
                    ok = np.ones(len(at), bool)
                    for slot in _bloom_slots(fp, len(bits)):
                        ok &= bits[slot]
                    at, size, fp = at[ok], size[ok], fp[ok]
                of = pa.array(row[at] + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), *_print_columns(low, start, end, bound, row, (at, size, fp), window, k)], names=["doc_id", "copy_key", "pos", "len", "fp", "gram", "left", "right"])

    return docs.select("doc_id", "text", "copy_key").mapInArrow(tb.frugal(run), f"doc_id long, copy_key long, {_PRINT}")


def _extended(prints: DataFrame, window: int, k: int) -> DataFrame:
    """Each fingerprint extended to the windows that hold its k-gram: (..., fp, len, first, words), the place and the words of each.

    A window is the words of the k-gram, some to the left and the rest to the right, as far
    as the text has them; an item shorter than a window is its own.
    """
    more = window - k
    shift = F.explode(F.when(F.col("len") == window, F.sequence(F.greatest(F.lit(0), more - F.size("right")), F.least(F.lit(more), F.size("left")))).otherwise(F.array(F.lit(0))))
    # a sequence runs down where its end is below its start: those windows don't fit
    fits = (F.col("len") != window) | (F.size("left") + F.size("right") >= more)
    at = prints.filter(fits).withColumn("shift", shift)
    before = F.reverse(F.slice("left", F.lit(1), F.col("shift")))
    behind = F.when(F.col("len") == window, F.slice("right", F.lit(1), more - F.col("shift"))).otherwise(F.array().cast("array<string>"))
    words = F.array_join(F.concat(before, F.array("gram"), behind), " ")
    return at.select(*[c for c in prints.columns if c not in ("pos", "gram", "left", "right")], (F.col("pos") - F.col("shift")).alias("first"), words.alias("words"))


def _merged_ranges(hits: Column) -> Column:
    """Ranges (first, size) that cover the same words as these, in order and apart."""
    start = F.array().cast("array<struct<first: int, size: int>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        end, own = last["first"] + last["size"], x["first"] + x["size"]
        joined = F.struct(last["first"].alias("first"), (F.greatest(end, own) - last["first"]).alias("size"))
        return F.when(F.coalesce(x["first"] <= end, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(hits), start, add)


@F.arrow_udf(LongType())
def word_counts(texts: pa.Array) -> pa.Array:
    """Words of each text."""
    out = [np.diff(tb.group_bounds(tb.words(buf, off)[3], j - i)) for i, j, buf, off in tb.text_runs(texts)]
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hit_ranges(docs: DataFrame, items: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = KGRAM, most_bits: int = MOST_BLOOM_BITS) -> DataFrame:
    """(doc_id, copy_key, items, hits) of the documents that are hit; docs has doc_id, text, copy_key."""
    bench = item_prints(items, item_col, item_text, window, k).distinct()
    keys = bench.select("fp", "len").distinct()
    bloom = benchmark_filter(keys, most_bits)
    short = [r[0] for r in keys.filter(F.col("len") < window).select("len").distinct().orderBy("len").collect()]  # at most window - 1
    # windows are told apart once, however often they recur on either side
    of_item = written(_extended(bench, window, k).select("fp", "len", "words", "item_id").distinct(), "benchmark-windows")
    windows = of_item.select("fp", "len", "words").distinct()
    met = written(_extended(candidate_prints(docs, bloom, short, window, k), window, k).join(windows, ["fp", "len", "words"]).distinct(), "met-windows")
    ranges = met.groupBy("doc_id", "copy_key").agg(F.collect_set(F.struct(F.col("first"), F.col("len").alias("size"))).alias("hits"))
    found = met.select("doc_id", "copy_key", "fp", "len", "words").distinct().join(of_item, ["fp", "len", "words"])
    names = found.groupBy("doc_id", "copy_key").agg(F.collect_set("item_id").alias("items")).select(F.col("doc_id").alias("d"), F.col("copy_key").alias("c"), "items")
    both = ranges.join(names, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy_key") == F.col("c")))
    return both.select("doc_id", "copy_key", "items", _merged_ranges(F.col("hits")).alias("hits"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One row a document: doc_id, text_hash (xxhash64), n_words, n_hit, items (array), hits (array of word ranges' starts and lengths)."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"), text_key(quoted(text_col)).alias("copy_key"))
    found = hit_ranges(rows, items, **options).select(F.col("doc_id").alias("hit_id"), F.col("copy_key").alias("hit_key"), "items", "hits")
    all_ = rows.select("doc_id", "copy_key", word_counts("text").alias("n_words"))
    both = all_.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("copy_key") == F.col("hit_key")), "left")
    covered = F.aggregate("hits", F.lit(0), lambda n, x: n + x["size"])
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id",
        F.col("copy_key").alias("text_hash"),
        "n_words",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort("items"), none).alias("items"),
        F.coalesce("hits", F.array().cast("array<struct<first: int, size: int>>")).alias("hits"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with an item; columns as they are, null ids included."""
    rows = docs.select(whole_row(docs).alias("row"), quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"), text_key(quoted(text_col)).alias("copy_key"))
    dirty = hit_ranges(rows, items).select(F.col("doc_id").alias("hit_id"), F.col("copy_key").alias("hit_key"))
    return rows.join(dirty, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("copy_key") == F.col("hit_key")), "left_anti").select("row.*")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
