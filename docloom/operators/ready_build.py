"""All ready-data artifacts of a profile as frames, with the fields that readers of them expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import slug
from docloom.operators import ready
from docloom.sources.artifacts import PROFILES
from docloom.sources.readers import stored

RELATION = ("relation_type", "doc_id", "file_url", "title", "alias", "section_id", "section_heading", "target_type", "target_id")


def _or(c: str, df: DataFrame, other: Column) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), other).alias(c) if c in df.columns else other.alias(c)


def build(docs: DataFrame, profile: str = "general") -> dict[str, DataFrame]:
    """Artifact name to frame.  ``docs`` has doc_id, file_url and md, and any of title, category, source_site, publish_date, summary, keywords (a list) and rag_chunk_count."""
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile}")
    doc = F.col("doc_id").cast("string").alias("doc_id")
    none = F.array().cast("array<string>")
    keywords = F.coalesce(F.col("keywords"), none) if "keywords" in docs.columns else none
    chunks = F.coalesce(F.col("rag_chunk_count"), F.lit(0)) if "rag_chunk_count" in docs.columns else F.lit(0)
    base = docs.select(
        doc, "file_url", _or("title", docs, F.col("file_url")), _or("category", docs, F.lit("general")), _or("source_site", docs, F.lit("")), _or("publish_date", docs, F.lit("")), _or("summary", docs, F.lit("")),
        keywords.alias("keywords"), ready.heading_path(F.coalesce("md", F.lit(""))).alias("headings"), chunks.cast("long").alias("rag_chunk_count"), F.coalesce("md", F.lit("")).alias("md"),
    )
    names = ready.aliases(base)
    # cut, counted and named within the row of their document; read by several artifacts, so stored
    whole = ready.aliases(base, "md").withColumnRenamed("aliases", "document_aliases")
    secs = stored(ready.sections(whole, "document_aliases"), "sections").withColumn("heading_path", F.array("heading"))
    out = {"doc_catalog.jsonl": base.drop("md"), "sections.jsonl": secs.select("section_id", "doc_id", "heading_path", "text", "token_count")}
    if profile != "general":
        out |= {
            "title_aliases.jsonl": names,
            "doc_summaries.jsonl": base.select("doc_id", "file_url", "title", "category", "summary"),
            "sections_structured.jsonl": secs.select("section_id", "doc_id", "file_url", "title", "heading_path", "heading", "text", "token_count", F.coalesce("document_aliases", none).alias("document_aliases")),
        }
        edges = [_edges(secs, "document_has_section", "section", "section_id"), _alias_edges(names)]
        if profile == "formula":
            path = F.array("heading").alias("heading_path")
            # and these are rows of their artifacts and edges of the graph
            cards, tables, terms = stored(ready.formula_cards(secs), "cards"), stored(ready.structured_tables(secs), "tables"), stored(_terms(secs), "terms")
            out |= {
                "formula_cards.jsonl": cards.select("formula_id", "doc_id", "file_url", "title", "section_id", path, "heading", "formula_text", "context", "terms"),
                "tables_structured.jsonl": tables.select("table_id", "doc_id", "file_url", "title", "section_id", path, "heading", F.col("heading").alias("caption"), "headers", "rows", "text"),
                "calculation_terms.jsonl": terms.drop("heading"),
            }
            edges += [_edges(cards, "document_has_formula", "formula", "formula_id"), _edges(tables, "document_has_table", "table", "table_id"), _edges(terms, "document_has_calculation_term", "calculation_term", "term_id")]
        graph = edges[0]
        for e in edges[1:]:
            graph = graph.unionByName(e)
        out["relations_graph.json"] = graph
    return {name: out[name] for name in PROFILES[profile]}


def _edges(rows: DataFrame, kind: str, target: str, key: str) -> DataFrame:
    """An edge from its document to each row."""
    return rows.select(F.lit(kind).alias("relation_type"), "doc_id", "file_url", "title", F.lit(None).cast("string").alias("alias"), "section_id", F.col("heading").alias("section_heading"), F.lit(target).alias("target_type"), F.col(key).alias("target_id"))


def _alias_edges(names: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    return names.select("doc_id", "file_url", "title", F.explode("aliases").alias("alias")).select(F.lit("alias_of").alias("relation_type"), "doc_id", "file_url", "title", "alias", null.alias("section_id"), null.alias("section_heading"), F.lit("document").alias("target_type"), F.col("doc_id").alias("target_id"))


def _terms(secs: DataFrame) -> DataFrame:
    """Terms of each section's text and tables, once a section, named by their slug."""
    cells = F.regexp_replace(F.regexp_replace(F.array_join(ready.table_blocks(F.col("text")), "\n"), r"(?m)^[cr]", ""), r"\s*[|\n]\s*", " ")
    cells = F.when(F.col("text").contains("|"), cells).otherwise("")
    rows = secs.withColumn("heard", F.concat_ws(" ", "text", cells))
    found = rows.select("doc_id", "file_url", "title", "section_id", "heading", "heading_path", F.explode(ready.spotted_terms(F.col("heard"))).alias("term"), ready.snippet("text", 480).alias("context"))
    low = F.lower("term")
    return found.select(F.concat("section_id", F.lit("#term-"), slug(low, "term")).alias("term_id"), "term", low.alias("normalized_term"), "doc_id", "file_url", "title", "section_id", "heading_path", "heading", "context")
