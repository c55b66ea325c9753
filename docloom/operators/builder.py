"""Ready-data artifacts from files, catalog and chunks, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import keyword_list, slug, snippet, word_count


def doc_catalog(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row a cataloged document."""
    j = files.join(catalog.filter("status = 'ok'"), files["url"] == catalog["file_url"])
    return j.select(slug("url").alias("doc_id"), "file_url", "title", "category", "source_site", "summary", F.coalesce(keyword_list("keywords"), F.array().cast("array<string>")).alias("keywords"))


def identifiers(c: Column) -> Column:
    """Numbered names in a title: 第…号, rule, article, regulation, guideline, standard."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)(第[0-9一二三四五六七八九十百]+号|(?:rule|article|regulation|guideline|standard)\s+(?:no\.?\s*)?[0-9][0-9A-Za-z.-]*)"), 1))


def title_aliases(docs: DataFrame) -> DataFrame:
    stem = F.regexp_replace(F.regexp_extract("file_url", r"([^/]+)$", 1), r"\.[A-Za-z0-9]{1,5}$", "")
    return docs.select("doc_id", "file_url", "title", F.array_distinct(F.filter(F.concat(F.array("title", stem), identifiers(F.col("title"))), lambda a: a != "")).alias("aliases"))


def headings(c: Column) -> Column:
    """ATX headings of a Markdown text, without their marks."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$"), 1), lambda h: F.trim(h))


def sections(docs: DataFrame) -> DataFrame:
    """One row a heading block of each text: section_id, heading, text, token_count; text before a heading is its own."""
    parts = F.filter(F.split("text", r"(?m)^(?=#{1,6}[ \t])"), lambda p: F.trim(p) != "")
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "text"))
    heading = F.coalesce(F.get(headings(F.col("text")), F.lit(0)), F.lit("Markdown"))
    return rows.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.concat(F.lit("section-"), (F.col("pos") + 1).cast("string"))).alias("section_id"), "doc_id", "pos", heading.alias("heading"), "text", word_count("text").alias("token_count"))


def formulas(secs: DataFrame) -> DataFrame:
    """Lines with an equals sign that read as formulas: at most 320 characters, letters, no table row."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.contains("=") & (F.length(x) <= 320) & x.rlike(r"\p{L}") & ~x.startswith("|"))
    rows = secs.select("doc_id", "section_id", "heading", F.posexplode(lines).alias("pos", "formula_text"), snippet("text", 480).alias("context"))
    left = F.trim(F.split_part("formula_text", F.lit("="), F.lit(1)))
    return rows.select(F.concat_ws("#", "section_id", F.concat(F.lit("formula-"), (F.col("pos") + 1).cast("string"))).alias("formula_id"), "doc_id", "section_id", "heading", "formula_text", F.array(left).alias("terms"), "context")


def relations(docs: DataFrame, secs: DataFrame, aliases: DataFrame) -> DataFrame:
    has = secs.select(F.lit("has_section").alias("relation_type"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("section").alias("target_type"), F.col("section_id").alias("target_id"))
    named = aliases.select(F.explode("aliases").alias("alias"), "doc_id").select(F.lit("alias_of").alias("relation_type"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("document").alias("target_type"), F.col("doc_id").cast("string").alias("target_id"))
    return has.union(named)


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str, what: str) -> DataFrame:
    """References without a target, as (problem, id)."""
    return rows.join(known.select(F.col(known_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti").select(F.lit(what).alias("problem"), F.col(key).cast("string").alias("id"))


def fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """One digest of all rows, whatever their order or partitioning: hashes by key prefix, then a hash of those."""
    one = rows.select(F.sha2(F.to_json(F.struct(*rows.columns)), 256).alias("h"))
    small = one.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 4, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.conv(F.substring("h", 16, 15), 16, 10).cast("long")).alias("x"))
    line = F.concat_ws(":", "p", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string"))
    return small.agg(F.concat(F.lit("rdsnap_"), F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(line))), 256)).alias("fingerprint"))
