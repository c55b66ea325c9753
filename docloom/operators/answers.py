"""From ranked results to what an answer shows: similar ones removed, citations once a source, texts bounded."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SIMILAR = 0.95
TOP_K = 50
QUOTE = 280


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def similarity(a: Column, b: Column) -> Column:
    """Share of lengths where one text holds the other, else shared words by all words; 0 for empty texts."""
    short, long_ = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = F.contains(a, b) | F.contains(b, a)
    shared = F.try_divide(F.size(F.array_intersect(_words(a), _words(b))), F.size(F.array_union(_words(a), _words(b))))
    return F.when((a == "") | (b == ""), 0.0).when(inside, short / long_).otherwise(F.coalesce(shared, F.lit(0.0)))


def top(results: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each query, with ``place`` from 1; partial ranks are cut before rows move."""
    w = Window.partitionBy(query).orderBy(*order)
    return results.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def without_similar(results: DataFrame, query: str, order: list[Column], content: str, k: int = TOP_K, above: float = SIMILAR) -> DataFrame:
    """Of the first k results of each query, in rank order, those not similar to one kept before; all columns and ``place``.

    A query's at most k results meet in one row and are folded there: no pairs beyond them.
    """
    near = top(results, query, order, k)
    text = F.coalesce(F.col(f"`{content}`"), F.lit(""))
    rows = near.select(F.col(f"`{query}`").alias("q"), F.struct("place", text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in near.columns]).alias("row")).alias("x"))
    lists = rows.groupBy("q").agg(F.collect_list("x").alias("xs"))
    ranked = F.array_sort("xs", lambda a, b: a["place"] - b["place"])
    kind = lists.schema["xs"].dataType

    def keep(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda o: similarity(x["text"], o["text"]) > above), kept).otherwise(F.concat(kept, F.array(x)))

    return lists.select(F.explode(F.aggregate(ranked, F.array().cast(kind), keep)).alias("x")).select("x.row.*")


# --- citations ----------------------------------------------------------------------------


def first_text(*columns: Column) -> Column:
    """The first of these that is not blank, without white space around it; else empty."""
    out = F.lit("")
    for c in reversed(columns):
        bare = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
        out = F.when(bare != "", bare).otherwise(out)
    return out


def score_of(c: Column) -> Column:
    """A number that is not negative, else null."""
    number = c.cast("string").try_cast("double")
    return F.when(number >= 0, number)


def quote(c: Column) -> Column:
    return F.regexp_replace(F.substring(F.coalesce(c, F.lit("")), 1, QUOTE), r"(?U)^\s+|\s+$", "")


def cut(c: Column, most: int) -> Column:
    """At most so many characters; a longer text loses blanks at the cut and ends with an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most), r"(?U)\s+$", ""), F.lit("…"))).otherwise(c)


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([" ".join(unicodedata.normalize("NFKC", x.as_py() or "").split()) for x in texts], pa.string())


def bounded_text(c: Column, most: int) -> Column:
    """Compatibility forms composed, white space as single blanks, and at most so many characters."""
    return F.regexp_replace(F.substring(_nfkc(c), 1, most), r"(?U)\s+$", "")


def citations(results: DataFrame, query: str, order: list[Column], k: int = TOP_K) -> DataFrame:
    """The first result of each source among the first k of a query, with its quote.

    ``results`` has filename, kb_id, kb_name, chunk_id, similarity_score, file_url and
    content.  A source is a url, else a file name, else a chunk; results without any of
    these stand for themselves.
    """
    ranked = top(results, query, order, k)
    key = first_text(F.col("file_url"), F.col("filename"), F.col("chunk_id"))
    keyed = ranked.withColumn("source_key", F.when(key != "", key).otherwise(F.concat(F.lit("#"), F.col("place").cast("string"))))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    block = F.struct("place", blank("filename"), blank("kb_id"), blank("kb_name"), blank("chunk_id"), "similarity_score", blank("file_url"), quote(F.col("content")).alias("quote"))
    one = keyed.groupBy(query, "source_key").agg(F.min_by(block, "place").alias("b"))
    return one.select(query, "b.*")


def evidence_blocks(evidence: DataFrame, kb_id: str, kb_name: str = "") -> DataFrame:
    """What is shown of each piece of evidence: filename, content, score, chunk_id, source_url, quote.

    Any of the fields may be lacking; a piece without text shows its relation.
    """
    has = set(evidence.columns)
    pick = lambda *names: first_text(*[F.col(n) for n in names if n in has], F.lit(""))
    relation = F.array_join(F.filter(F.array(*[first_text(F.col(n)) for n in ("relation_type", "target_type", "target_id") if n in has]).cast("array<string>"), lambda x: x != ""), " ")
    said = pick("summary", "text_snippet", "text", "content", "quote", "heading", "section_heading")
    content = F.when(said != "", said).otherwise(relation)
    title = pick("title", "filename", "heading", "section_heading", "doc_id", "source")
    return evidence.select(
        "*", F.when(title != "", title).otherwise("Agentic evidence").alias("shown_as"), F.lit(kb_id).alias("kb_id"), F.lit(kb_name or kb_id).alias("kb_name"), pick("section_id", "chunk_id", "doc_id", "target_id").alias("shown_chunk"),
        (score_of(F.col("score")) if "score" in has else F.lit(None).cast("double")).alias("shown_score"), content.alias("shown_text"), pick("file_url", "source_url", "doc_id").alias("shown_url"), quote(content).alias("shown_quote"),
    )
