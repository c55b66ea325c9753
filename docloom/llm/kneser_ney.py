"""Quality classifier: interpolated modified Kneser-Ney model of the characters of trusted text.

Training.  Each task counts the character ``ORDER``-grams of the trusted training documents
(a start mark stands ``ORDER - 1`` times before a text); the counts are summed by gram over
shards.  Lower orders hold continuation counts: the number of different characters in front
of a gram.  Joins of each order's counts with the totals and counts of counts of their
contexts and with the probabilities of the order below give discounts D1, D2, D3+ of every
order, back-off weights and interpolated probabilities.  Nothing is pruned: grams seen once
count like all others, and the table grows with the text (far slower than it, as grams of
characters recur).  A table row is (key, value, gain): for a gram its log probability and
the log gain over backing off, for a context its log back-off weight, twice.

Scoring.  Where the table was counted to have at most ``BROADCAST_ENTRIES`` rows (16 bytes
each) it is broadcast: the longest known gram gives the value, the contexts above it their
weights.  Beyond that the keys of all orders, counted within a segment of a text, are joined
with the sharded table and their gains summed.  Both give the same sums.

Decision.  Held-out trusted documents give a quantile (``QUANTILE``) of three measures for
each language, and a document is rejected if one of its own lies above it: the log
perplexity (mean negative log likelihood of a character); that of its worst segment of
``SEGMENT`` characters (the last one takes the rest), so good text around does not hide junk;
and the largest share in a segment of ``WORD_SEGMENT`` words that repeat the last or last but
one (at least ``LEAST_REPEAT``), as repetition is not improbable to the model.  Likelihoods
are drawn to the language's median as if by ``PRIOR_CHARS`` more characters, shares to 0 by
``PRIOR_WORDS`` more words.  Languages with fewer than ``MIN_HELD_OUT`` held-out documents,
and rows without a language, use all languages'.

Null and empty texts have no characters and are kept; without trusted text all is kept.  A
document is trusted if it has labels and all of them are good.  Repeated rows count as often
as they stand there and give a row each; ties with a threshold are kept.  Texts may have any
length.  Other columns stay as they are, whatever their names; those named like a result
are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import textbatch as tb
from docloom.llm.tables import bounded_broadcast, crc32_of_id, quoted, table, written

ORDER = 5
BROADCAST_ENTRIES = 16_000_000
LABEL_ROWS = 1_000_000
QUANTILE = 0.999
PRIOR_CHARS = 100
PRIOR_WORDS = 20
MIN_HELD_OUT = 50
HELD_OUT_MOD = 5
SEGMENT = 128
WORD_SEGMENT = 32
LEAST_REPEAT = 0.25
RUN_BYTES = 1 << 19  # a character takes some sixty bytes of working arrays

_START = 0xE000  # a private code point; in texts it counts as the mark
_CLASS = np.full(256, 2, np.uint8)
_CLASS[:33] = 0
_CLASS[127] = 0
_CLASS[tb.WORD > 0] = 1
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64) for k in range(2 * ORDER + 2)], np.uint64)  # odd multipliers, and marks of gram sizes and contexts
_SCORES = ("kn_tokens", "kn_repeat", "kn_loglik", "kn_worst")
_RESULTS = ("kn_tokens", "kn_logppl", "kn_threshold", "kn_keep")


# --- characters and words ----------------------------------------------------------------


def _codes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all rows with start marks before each, the places of the characters among them, and their rows."""
    code = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    row = np.repeat(np.arange(len(off) - 1), np.diff(lead[off]))
    at = np.arange(len(code)) + (row + 1) * (ORDER - 1)
    out = np.full(len(code) + (len(off) - 1) * (ORDER - 1), _START, np.uint64)
    out[at] = np.where(code == 0, 0xFFFD, code)
    return out, at, row


def _gram_keys(code: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` characters that end at each place."""
    h = code[at] * _WEIGHTS[0]
    for k in range(1, size):
        h += code[at - k] * _WEIGHTS[k]
    return h + _WEIGHTS[ORDER + size]


def _context_keys(code: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size - 1`` characters before each place, as a context of grams of ``size``."""
    return _gram_keys(code, at - 1, size - 1) ^ _WEIGHTS[-1]


def _repeats(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """By row, the largest share in a segment of words that repeat the last or last but one."""
    n, out = len(off) - 1, np.zeros(len(off) - 1)
    if not len(buf):
        return out
    kind = _CLASS[buf]
    head = np.empty(len(buf), bool)
    head[0] = True
    np.not_equal(kind[1:], kind[:-1], out=head[1:])
    edges = off[:-1]
    head[edges[edges < len(buf)]] = True
    at = np.flatnonzero(head)
    end = np.append(at[1:], len(buf))
    ok = kind[at] > 0
    at, end = at[ok], end[ok]
    if not len(at):
        return out
    w, row = tb.span_hashes(tb.lowered(buf, at), at, end), np.searchsorted(off, at, "right") - 1
    segment, place = _segments(row, n, WORD_SEGMENT)
    again = np.zeros(len(w), np.int64)
    again[1:] = (w[1:] == w[:-1]) & (place[1:] > 0)
    again[2:] |= (w[2:] == w[:-2]) & (place[2:] > 1)
    heads = _heads(row, segment)
    share = np.add.reduceat(again, heads) / (np.diff(np.append(heads, len(w))) + PRIOR_WORDS)
    return _most(share, heads, row, segment, out)


def _segments(row: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and place of each item within its row; the last segment takes the rest."""
    count = np.bincount(row, minlength=n)
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    return np.minimum(place // size, np.maximum(count // size, 1)[row] - 1), place


def _heads(row: np.ndarray, segment: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])]))


def _most(value: np.ndarray, heads: np.ndarray, row: np.ndarray, segment: np.ndarray, out: np.ndarray) -> np.ndarray:
    firsts = np.flatnonzero(segment[heads] == 0)
    out[row[heads[firsts]]] = np.maximum.reduceat(value, firsts)
    return out


# --- training -----------------------------------------------------------------------------


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, c): counts of the grams of ``ORDER`` characters; docs has one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in tb.text_runs(batch.column(0), RUN_BYTES):
                code, at, _ = _codes(buf, off)
                _, first, n = np.unique(_gram_keys(code, at, ORDER), return_index=True, return_counts=True)
                chars = np.stack([code[at[first] - k] for k in range(ORDER - 1, -1, -1)], axis=1).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(chars).view(f"<U{ORDER}").ravel().tolist(), pa.string()), pa.array(n)], names=["gram", "n"])

    return docs.mapInArrow(tb.frugal(run), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("c"))


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; flat ones where those are missing."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * (n4 or 0) / n3)
    return tuple(float(min(max(d, 0.05), k - 0.05)) for d, k in zip(found, (1, 2, 3)))


def fit(docs: DataFrame) -> tuple[DataFrame, float, int]:
    """(weights, log probability of an unseen character, entries); docs has one text column."""
    c, levels = F.col("c"), {ORDER: written(gram_counts(docs), "kn-counts")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = written(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), "kn-counts")
    unseen, raw, below = 0.0, None, None
    for k in range(1, ORDER + 1):
        of = levels[k].agg(F.count("*").alias("v"), *[F.sum((c == n).cast("long")).alias(f"n{n}") for n in (1, 2, 3, 4)]).first()
        if not of.v:
            return levels[1].select(F.lit(0).cast("long").alias("key"), F.lit(0.0).cast("float").alias("value"), F.lit(0.0).cast("float").alias("gain")).limit(0), 0.0, 0
        d = discounts(of.n1, of.n2, of.n3, of.n4)
        off = F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        back = levels[k].groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("c").alias("total"), F.sum(off).alias("off"))
        back = back.select("context", "total", (F.col("off") / F.col("total")).alias("gamma"))
        counted = levels[k].select("gram", "c", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("rest"))
        if k == 1:
            all_ = back.first()
            unseen = all_.gamma / (of.v + 1)
            below = counted.select("gram", ((c - off) / all_.total + unseen).alias("p"))
            raw = below.select(F.lit(0).alias("size"), "gram", F.log("p").alias("value"), F.log(F.col("p") / unseen).alias("gain"))
            below = written(below, "kn-p")
            continue
        low = F.col("gamma") * F.col("low")
        both = counted.join(back, "context").join(below.select(F.col("gram").alias("rest"), F.col("p").alias("low")), "rest")
        below = written(both.select("gram", ((c - off) / F.col("total") + low).alias("p"), low.alias("low")), "kn-p")
        raw = raw.union(below.select(F.lit(0), "gram", F.log("p"), F.log(F.col("p") / F.col("low"))))
        raw = raw.union(back.select(F.lit(k), "context", F.log("gamma"), F.log("gamma")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            chars, long = np.array(texts, f"<U{ORDER}").view("<u4").reshape(-1, ORDER).astype(np.uint64), np.array([len(t) for t in texts])
            key = np.zeros(len(texts), np.uint64)
            for n in range(1, ORDER + 1):
                own = np.flatnonzero(long == n)
                flat = chars[own].ravel()
                key[own] = _gram_keys(flat, np.arange(len(own)) * ORDER + n - 1, n)
            key[size > 0] ^= _WEIGHTS[-1]
            yield pa.RecordBatch.from_arrays([pa.array(tb.signed(key)), b.column(2), b.column(3)], names=["key", "value", "gain"])

    narrow = raw.select("size", "gram", F.col("value").cast("float"), F.col("gain").cast("float"))
    weights = written(narrow.mapInArrow(keyed, "key long, value float, gain float"), "kn-weights")
    return weights, float(np.log(unseen)), weights.count()


# --- scoring ------------------------------------------------------------------------------


class Held:
    """The table's keys in order, with the first place of each leading part."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        parts = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64)
        self.first = np.append(np.searchsorted(self.keys >> self.shift, parts), len(keys)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        part = (h >> self.shift).astype(np.int64)
        at, stop = self.first[part].astype(np.int64), self.first[part + 1]
        out = np.full(len(h), -1)
        left = np.flatnonzero(at < stop)
        while len(left):
            here = at[left]
            same = self.keys[here] == h[left]
            out[left[same]] = here[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out


def held_model(model: tuple[DataFrame, float, int], broadcast_entries: int = BROADCAST_ENTRIES) -> object | None:
    """The model's table as one broadcast, to be shared by all scoring; None where it is too large or empty."""
    weights, _, entries = model
    if not 0 < entries <= broadcast_entries:
        return None
    got = weights.select("key", "value").toArrow()
    return weights.sparkSession.sparkContext.broadcast(Held(got["key"].to_numpy().view(np.uint64), got["value"].to_numpy()))


def _log_p(held: Held, code: np.ndarray, at: np.ndarray, unseen: float) -> np.ndarray:
    """Log probability of the character at each place: the longest known gram, and the weights of the contexts above it."""
    out, left = np.zeros(len(at)), np.arange(len(at))
    for size in range(ORDER, 0, -1):
        found = held.find(_gram_keys(code, at[left], size))
        known = found >= 0
        out[left[known]] += held.values[found[known]]
        left = left[~known]
        if not len(left):
            break
        if size == 1:
            out[left] += unseen
        else:
            found = held.find(_context_keys(code, at[left], size))
            out[left] += np.where(found >= 0, held.values[found], 0.0)
    return out


def _measured(docs: DataFrame, text_col: str, held: object | None, unseen: float) -> DataFrame:
    """Docs with kn_tokens (characters) and kn_repeat, and, given a broadcast table, kn_loglik and kn_worst."""
    col, names = docs.columns.index(text_col), _SCORES[: 2 if held is None else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tb.text_runs(batch.column(col), RUN_BYTES):
                code, at, row = _codes(buf, off)
                new = [np.bincount(row, minlength=j - i).astype(np.int64), _repeats(buf, off)]
                if held is not None:
                    lp = _log_p(held.value, code, at, unseen)
                    new += [np.bincount(row, lp, j - i), np.zeros(j - i)]
                    if len(row):
                        segment, _ = _segments(row, j - i, SEGMENT)
                        heads = _heads(row, segment)
                        _most(-np.add.reduceat(lp, heads) / np.diff(np.append(heads, len(row))), heads, row, segment, new[3])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, new)], names=[*part.schema.names, *names])

    fields = [T.StructField(c, T.LongType() if c == "kn_tokens" else T.DoubleType()) for c in names]
    return docs.mapInArrow(tb.frugal(run), T.StructType([*docs.schema.fields, *fields]))


def _joined(docs: DataFrame, text_col: str, weights: DataFrame, unseen: float) -> DataFrame:
    """kn_loglik and kn_worst by a join of the texts' keys with the sharded table; equal texts share them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tagged = _measured(docs, text_col, None, unseen).withColumn("kn_text", F.unhex(F.sha2(text, 256)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tb.text_runs(batch.column(1), RUN_BYTES // 4):
                code, at, row = _codes(buf, off)
                segment, _ = _segments(row, j - i, SEGMENT)
                for size in range(1, ORDER + 1):
                    for keys, one in ((_gram_keys(code, at, size), size == 1), *([(_context_keys(code, at, size), False)] if size > 1 else [])):
                        key = tb.signed(keys)
                        order = np.lexsort((key, segment, row))
                        r, s, k = row[order], segment[order], key[order]
                        heads = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (k[1:] != k[:-1])])) if len(k) else np.zeros(0, np.int64)
                        n = np.diff(np.append(heads, len(k)))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(r[heads] + i)), pa.array(s[heads]), pa.array(k[heads]), pa.array(n), pa.array(n * one)],
                            names=["kn_text", "segment", "key", "n", "one"],
                        )

    texts = tagged.select("kn_text", text.alias("t")).dropDuplicates(["kn_text"])
    asked = texts.mapInArrow(tb.frugal(run), "kn_text binary, segment long, key long, n long, one long")
    found = asked.join(weights.select("key", "gain"), "key", "left").groupBy("kn_text", "segment").agg(F.sum("one").alias("one"), F.sum(F.col("n") * F.coalesce("gain", F.lit(0.0)) + F.col("one") * unseen).alias("loglik"))
    summed = found.groupBy("kn_text").agg(F.sum("loglik").alias("kn_loglik"), F.max(-F.col("loglik") / F.col("one")).alias("kn_worst"))
    return tagged.join(summed, "kn_text", "left").na.fill(0.0, ["kn_loglik", "kn_worst"]).select(*docs.columns, *_SCORES)


def score(docs: DataFrame, model: tuple[DataFrame, float, int], text_col: str = "text", broadcast_entries: int = BROADCAST_ENTRIES, held: object | None = None) -> DataFrame:
    """The rows of docs with kn_tokens, kn_repeat, kn_loglik and kn_worst; ``held`` is the table's broadcast if there is one already."""
    weights, unseen, entries = model
    docs = docs.select(*[c for c in docs.columns if c.lower() not in (*_SCORES, "kn_text")])
    if not entries:
        return docs.withColumns({"kn_tokens": F.lit(0).cast("long")} | {c: F.lit(0.0) for c in _SCORES[1:]})
    held = held or held_model(model, broadcast_entries)
    return _measured(docs, text_col, held, unseen) if held is not None else _joined(docs, text_col, weights, unseen)


# --- decision -----------------------------------------------------------------------------


def _scored_rows(docs: DataFrame, labels: DataFrame, broadcast_entries: int) -> DataFrame:
    """Rows (row, text, lang, and the four results); row holds the other columns, so a text goes through Python once."""
    others = [quoted(c) for c in docs.columns if c not in ("text", "lang")]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), "text", "lang", F.col("doc_id").alias("id"))
    sure = (F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)
    good = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("good_id")).agg(sure.alias("sure")).filter("sure").select("good_id")
    good, _ = bounded_broadcast(good, LABEL_ROWS)
    trusted = rows.join(good, F.col("id") == F.col("good_id"), "left_semi").filter("text IS NOT NULL")
    held_out = crc32_of_id("id") % HELD_OUT_MOD == 0
    model = fit(trusted.filter(~held_out).select("text"))
    shared = held_model(model, broadcast_entries)
    lang = F.coalesce(F.col("lang"), F.lit(""))
    sample = score(trusted.filter(held_out).select(lang.alias("lang"), "text"), model, "text", broadcast_entries, shared).filter("kn_tokens > 0").select("lang", *_SCORES)
    limits = _limits(written(sample, "kn-held-out"))
    if limits is None:
        new = {"kn_tokens": F.lit(0).cast("long"), "kn_logppl": F.lit(None).cast("double"), "kn_threshold": F.lit(None).cast("double"), "kn_keep": F.lit(True)}
        return rows.select("row", "text", "lang", *[v.alias(k) for k, v in new.items()])
    by_lang, everywhere = limits
    pick = lambda k: F.coalesce(*([F.create_map(*[F.lit(x) for s, v in by_lang.items() for x in (s, v[k])])[lang]] if by_lang else []), F.lit(everywhere[k]))
    scored = score(rows.select("row", "text", "lang"), model, "text", broadcast_entries, shared)
    over = [m > pick(1 + k) for k, m in enumerate(_measures(pick(0)))]
    return scored.select(
        "row",
        "text",
        "lang",
        "kn_tokens",
        F.when(F.col("kn_tokens") > 0, -F.col("kn_loglik") / F.col("kn_tokens")).alias("kn_logppl"),
        pick(1).alias("kn_threshold"),
        (~(over[0] | over[1] | over[2])).alias("kn_keep"),
    )


def _own_columns(docs: DataFrame, leave_out: tuple[str, ...] = ()) -> list[Column]:
    return [F.col(c) if c in ("text", "lang") else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in leave_out]


def judged(docs: DataFrame, labels: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """The rows of docs with kn_tokens, kn_logppl (mean, null without tokens), kn_threshold and kn_keep."""
    return _scored_rows(docs, labels, broadcast_entries).select(*_own_columns(docs, _RESULTS), *_RESULTS)


def _measures(mid: Column) -> tuple[Column, Column, Column]:
    """Smoothed log perplexity, that of the worst segment, and the share of repeats, of scored rows."""
    n, inner = F.col("kn_tokens"), F.least(F.col("kn_tokens"), F.lit(SEGMENT))
    return (PRIOR_CHARS * mid - F.col("kn_loglik")) / (PRIOR_CHARS + n), (PRIOR_CHARS * mid + F.col("kn_worst") * inner) / (PRIOR_CHARS + inner), F.col("kn_repeat")


def _limits(sample: DataFrame) -> tuple[dict[str, tuple[float, ...]], tuple[float, ...]] | None:
    """(median, thresholds of the measures) by language, one row a language on the driver, and over all."""

    median = F.percentile_approx(-F.col("kn_loglik") / F.col("kn_tokens"), 0.5, 10000)

    def grouped(keys: list[str]) -> list:
        if keys:
            placed = sample.join(F.broadcast(sample.groupBy(*keys).agg(median.alias("mid"))), keys)  # a row a language
        else:
            placed = sample.withColumn("mid", F.lit(sample.agg(median).first()[0]).cast("double"))
        top = [F.percentile_approx(m, QUANTILE, 10000).alias(f"q{k}") for k, m in enumerate(_measures(F.col("mid")))]
        q = placed.groupBy(*keys).agg(F.first("mid").alias("mid"), F.count("*").alias("n"), *top)
        return [(r, (r.mid, r.q0, r.q1, max(r.q2, LEAST_REPEAT))) for r in q.collect() if r.n]

    whole = grouped([])
    if not whole:
        return None
    by_lang = {r.lang: limits for r, limits in grouped(["lang"]) if r.n >= MIN_HELD_OUT and r.lang}
    return by_lang, whole[0][1]


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns as they are."""
    return _scored_rows(docs, labels, BROADCAST_ENTRIES).filter("kn_keep").select(*_own_columns(docs))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", F.col("kn_tokens").alias("n_tokens"), F.col("kn_logppl").alias("log_perplexity"), F.col("kn_threshold").alias("threshold"), F.col("kn_keep").alias("keep"))
