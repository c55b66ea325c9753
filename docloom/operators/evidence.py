"""Evidence search over ready-data artifacts by weighted term presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import field_score, query_tokens

# Weights of fields by artifact, and what a phrase that a field holds adds.
WEIGHTS = {
    "summaries": {"summary": 4.0, "title": 2.0, "category": 1.0, "headings": 1.0, "sections_text": 0.75},
    "titles": {"title": 5.0, "file_url": 1.0, "category": 0.5, "summary": 0.5, "headings": 0.75},
    "sections": {"heading": 4.0, "heading_path": 3.0, "text": 1.0, "title": 1.0, "aliases": 4.0},
    "formulas": {"formula_text": 6.0, "terms": 5.0, "heading": 3.0, "context": 1.5, "title": 1.0},
    "tables": {"headers": 4.0, "rows": 4.0, "caption": 2.0, "heading": 2.0, "text": 1.0},
    "terms": {"term": 8.0, "context": 2.0, "heading_path": 1.0, "title": 0.5},
}
PHRASE = {"summaries": ("summary", 3.0), "titles": ("title", 4.0), "sections": ("text", 3.0), "formulas": ("formula_text", 4.0), "tables": ("text", 4.0), "terms": ("term", 6.0)}


def search(artifact: DataFrame, kind: str, query: str, limit: int = 10, id_col: str = "doc_id") -> DataFrame:
    """Rows with a positive score: score, then title and id decide.  Missing columns score nothing; lists count as text."""
    tokens = query_tokens(query)
    score = F.lit(0.0)
    for c, w in WEIGHTS[kind].items():
        if c in artifact.columns:
            score = score + field_score(tokens, _text(artifact, c), w)
    col, bonus = PHRASE[kind]
    phrase = query.strip().lower()
    if phrase and col in artifact.columns:
        score = score + F.when(F.lower(_text(artifact, col)).contains(phrase), F.lit(bonus)).otherwise(0.0)
    k = max(1, min(100, limit))
    found = artifact.withColumn("score", F.round(score, 4)).filter("score > 0")
    by = [F.desc("score"), *([F.lower("title")] if "title" in artifact.columns else []), id_col]
    return found.orderBy(*by).limit(k)


def _text(df: DataFrame, c: str) -> Column:
    return F.array_join(F.col(c), " ") if dict(df.dtypes)[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))


def trace_relations(edges: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Edges that name the query (2 a token, 5 the phrase), then edges of the same documents at 0.5, once per (type, target)."""
    hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in edges.columns]))
    score = field_score(query_tokens(query), hay, 2.0) + F.when(hay.contains(query.lower()), 5.0).otherwise(0.0)
    first = edges.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "doc_id", "relation_type", "target_id").limit(limit)
    near = edges.join(first.select("doc_id").distinct(), "doc_id", "left_semi").join(first.select("relation_type", "target_id"), ["relation_type", "target_id"], "left_anti")
    near = near.groupBy("relation_type", "target_id").agg(F.min("doc_id").alias("doc_id")).withColumn("score", F.lit(0.5))
    return first.select("relation_type", "target_id", "doc_id", "score").unionByName(near)


def keyword_retrieve(docs: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Number of query words that occur in title, summary or keywords."""
    score = field_score(query_tokens(query), F.concat_ws(" ", "title", "summary", "keywords"), 1.0)
    return docs.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


def evaluate(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Rollup of retrieval cases: passed cases, hit rate; results has case_id and hit."""
    hits = results.groupBy("case_id").agg(F.sum(F.col("hit").cast("int")).alias("hits"))
    j = cases.join(hits, "case_id", "left").withColumn("ok", F.coalesce("hits", F.lit(0)) >= F.col("min_hits"))
    return j.agg(F.count("*").alias("n_cases"), F.count(F.when(F.col("ok"), 1)).alias("n_passed"), F.round(F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(0.0)), 6).alias("pass_rate"))


def case_rollup(results: DataFrame) -> DataFrame:
    """Rollup of cases with what they hit and what was wanted; a case that wants nothing passes, and is refused well if it hit nothing."""
    both, none = F.size(F.array_intersect("hits", "wanted")), F.size("wanted") == 0
    rate = lambda c: F.round(F.coalesce(F.avg(c), F.lit(1.0)), 6)
    return results.agg(
        F.count("*").alias("n_cases"),
        F.count(F.when(none | (both >= 1), 1)).alias("n_passed"),
        rate(F.when(~none, both / F.size("wanted"))).alias("evidence_hit_rate"),
        rate(F.when(none, (F.size("hits") == 0).cast("double"))).alias("refusal_rate"),
    )


def evidence_key(df: DataFrame) -> Column:
    """The most specific identity of a piece of evidence: formula, table, term, relation, section, document."""
    names = ("formula_id", "table_id", "term_id", "target_id", "section_id", "doc_id")
    return F.coalesce(*[F.concat(F.lit(f"{n}:"), F.nullif(F.col(n).cast("string"), F.lit(""))) for n in names if n in df.columns])


def merge_evidence(steps: DataFrame) -> DataFrame:
    """One row a key: the first step's score and position, all tools in step order."""
    keyed = steps.withColumn("key", evidence_key(steps))
    one = keyed.groupBy("key", "tool").agg(F.min("step_no").alias("step_no"), F.max("score").alias("score"))
    return one.groupBy("key").agg(F.min("step_no").alias("first_step"), F.max("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("step_no", "tool"))), lambda x: x["tool"]).alias("tools"))


def plan_steps(category: str, artifacts: set[str]) -> list[str]:
    """Tools to run, in order, for a question class and the artifacts at hand."""
    first = {"summary": ["summaries"], "locate": ["titles", "sections"], "catalog": ["titles", "summaries"], "document_qa": ["sections", "formulas", "tables", "terms", "relations"]}[category]
    rest = [t for t in ("sections", "titles", "summaries") if t not in first]
    return [t for t in [*first, *rest] if t in artifacts]
