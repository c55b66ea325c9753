"""Rule-based query analysis and the choice of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTENTS = (("comparative", ("compare", "difference", "versus", " vs ")), ("procedural", ("how to", "steps", "procedure")), ("explanatory", ("explain", "why", "what is")), ("factual", ("what is the", "when", "who", "how many")))
THRESHOLD = 0.3
NEAR = 0.2


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def intent(q: Column) -> Column:
    """The first intent with a phrase in the query; 'what is' comes before 'what is the'."""
    low, out = F.lower(q), F.lit("general")
    for name, words in reversed(INTENTS):
        out = F.when(has_any(low, words), name).otherwise(out)
    return out


def complexity(q: Column) -> Column:
    n = F.size(F.filter(F.split(F.trim(q), r"\s+"), lambda w: w != ""))
    return F.when((n > 20) | has_any(F.lower(q), (" and ", "compare")), "complex").when(n > 8, "medium").otherwise("simple")


def overlap(a: Column, b: Column) -> Column:
    """Share of a's elements that b has; 0 for an empty a."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a))), F.lit(0.0))


def select_collections(queries: DataFrame, kbs: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, kb_id, relevance): 0.4 categories + 0.4 keywords + 0.2 entities.

    The best always; then, of the next ones up to ``most``, those at the threshold and
    within ``NEAR`` of the best.  ``kbs`` is a small fixed list and is broadcast.
    """
    r = 0.4 * overlap(F.col("q_categories"), F.col("categories")) + 0.4 * overlap(F.col("q_keywords"), F.col("keywords")) + 0.2 * overlap(F.col("q_entities"), F.col("keywords"))
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "kb_id")
    pairs = queries.crossJoin(F.broadcast(kbs)).withColumn("relevance", r)
    ranked = pairs.withColumn("rn", F.row_number().over(w)).withColumn("top", F.first("relevance").over(w))
    return ranked.filter((F.col("rn") == 1) | ((F.col("rn") <= most) & (F.col("relevance") >= THRESHOLD) & (F.col("top") - F.col("relevance") <= NEAR))).select("query_id", "kb_id", "relevance")


def similar_chunks(chunks: DataFrame) -> DataFrame:
    """(a, b, ratio) of the chunks of each query: contained text by length, else shared words by all words.

    Pairs are formed among the few results of one query only.
    """
    left = chunks.select("query_id", F.col("chunk_id").alias("a"), F.col("content").alias("ca"))
    right = chunks.select("query_id", F.col("chunk_id").alias("b"), F.col("content").alias("cb"))
    wa, wb = (F.split(F.lower(c), r"\s+") for c in ("ca", "cb"))
    inside = F.col("ca").contains(F.col("cb")) | F.col("cb").contains(F.col("ca"))
    short, long_ = F.least(F.length("ca"), F.length("cb")), F.greatest(F.length("ca"), F.length("cb"))
    ratio = F.when(inside, F.try_divide(short, long_)).otherwise(F.try_divide(F.size(F.array_intersect(wa, wb)), F.size(F.array_union(wa, wb))))
    return left.join(right, "query_id").filter("a < b").select("query_id", "a", "b", ratio.alias("ratio"))
