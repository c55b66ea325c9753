"""Counts and summaries of the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import blank, visible_categories


def dashboard(files: DataFrame, catalog: DataFrame) -> DataFrame:
    f = files.agg(F.count(F.when(~blank("local_path") & F.col("deleted_at").isNull(), 1)).alias("n_files"), F.countDistinct("source_site").alias("n_sources"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("n_bytes"))
    c = catalog.agg(F.count(F.when(F.col("status") == "ok", 1)).alias("n_cataloged"), F.count(F.when(F.col("status") == "error", 1)).alias("n_errors"), F.count(F.when(~blank("markdown_content"), 1)).alias("n_markdown"))
    return f.crossJoin(c)


def unique_categories(catalog: DataFrame) -> DataFrame:
    names = catalog.select("category").distinct().select(F.explode(visible_categories("category")).alias("category")).distinct()
    return names.orderBy(F.lower("category"), "category")


def category_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("category").agg(F.count("*").alias("total"), F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("ok"), F.sum(F.when(blank("summary"), 1).otherwise(0)).alias("no_summary"))


def markdown_by_source(files: DataFrame, catalog: DataFrame, limit: int = 20) -> DataFrame:
    j = files.join(catalog, files["url"] == catalog["file_url"], "left")
    return j.groupBy("source_site").agg(F.count("*").alias("total"), F.count(F.when(~blank("markdown_content"), 1)).alias("with_markdown")).orderBy(F.desc("total"), "source_site").limit(limit)


def category_chunk_stats(catalog: DataFrame, sets: DataFrame) -> DataFrame:
    """Files by visible category, with Markdown, with any chunk set, with a ready one."""
    flags = sets.groupBy("file_url").agg(F.max(F.when(F.col("status") == "ready", 1).otherwise(0)).alias("ready"))
    rows = catalog.select("file_url", (~blank("markdown_content")).alias("md"), F.explode(visible_categories("category")).alias("category")).join(flags, "file_url", "left")
    one = rows.groupBy("category", "file_url").agg(F.max(F.col("md").cast("int")).alias("md"), F.max("ready").alias("ready"))
    return one.groupBy("category").agg(F.count("*").alias("files"), F.sum("md").alias("with_markdown"), F.count("ready").alias("with_chunks"), F.coalesce(F.sum("ready"), F.lit(0)).cast("long").alias("with_ready"))


def kb_stats(kb_files: DataFrame) -> DataFrame:
    return kb_files.groupBy("kb_id").agg(F.count("*").alias("file_count"), F.count("indexed_at").alias("indexed"), F.count(F.when(F.col("indexed_at").isNull(), 1)).alias("pending"), F.sum("chunk_count").alias("chunk_count"), F.max("indexed_at").alias("last_indexed"))


def composition(bindings: DataFrame, sets: DataFrame, kb_files: DataFrame) -> DataFrame:
    """By collection: bound files, chunks in bound sets, outdated follow_latest bindings, unindexed files, needs_reindex."""
    newest = sets.filter("status = 'ready'").groupBy("file_url").agg(F.max_by("chunk_set_id", F.struct("updated_at", "chunk_set_id")).alias("newest"))
    bound = bindings.join(sets.select("chunk_set_id", "chunk_count"), "chunk_set_id", "left").join(newest, "file_url", "left")
    b = bound.groupBy("kb_id").agg(F.countDistinct("file_url").alias("bound_files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("bound_chunks"), F.count(F.when((F.col("binding_mode") == "follow_latest") & (F.col("newest") != F.col("chunk_set_id")), 1)).alias("outdated"))
    k = kb_files.groupBy("kb_id").agg(F.count(F.when(F.col("indexed_at").isNull(), 1)).alias("unindexed"))
    return k.join(b, "kb_id", "left").na.fill(0).withColumn("needs_reindex", (F.col("outdated") > 0) | (F.col("unindexed") > 0))


def conversation_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("role") == "user", 1)).alias("n_user"), F.count(F.when(F.col("role") == "assistant", 1)).alias("n_assistant"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))


def sections_by_doc(sections: DataFrame) -> DataFrame:
    """The texts of each document's sections in their order, as one string."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])
    return sections.groupBy("doc_id").agg(F.array_join(parts, " ").alias("sections_text"))
