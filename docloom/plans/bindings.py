"""The engine's tables over the driver's Parquet tables, for Spark and as DuckDB text.

Both sides compute the same rows, so queries and their checks share one data model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raw(spark, sf_dir, "documents")
    i = F.col("doc_id")
    first = F.timestamp_micros((F.lit(1704067200) + i * 2220) * 1000000)
    last = F.timestamp_micros((F.lit(1704067200) + i * 2220 + (i % 7) * 86400) * 1000000)
    kind = F.when(i % 3 == 0, "application/pdf").when(i % 3 == 1, "text/html").otherwise("text/plain")
    ext = F.when(i % 3 == 0, ".pdf").when(i % 3 == 1, ".html").otherwise(".txt")
    return d.select(
        i.alias("id"),
        F.concat(F.lit("doc://"), i.cast("string")).alias("url"),
        F.sha2("text", 256).alias("sha256"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("source").alias("source_site"),
        F.concat(F.lit("f"), i.cast("string"), ext).alias("original_filename"),
        F.when(i % 17 == 0, "").otherwise(F.concat(F.lit("/data/"), i.cast("string"))).alias("local_path"),
        F.col("n_chars").alias("bytes"),
        kind.alias("content_type"),
        first.alias("first_seen"),
        last.alias("last_seen"),
        F.when(i % 29 == 0, last).alias("deleted_at"),
        "lang",
        "text",
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).filter(F.col("id") % 11 != 0)
    labels = raw(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    i = F.col("id")
    category = F.when(F.col("lang") == "en", "AI; Pricing").when(F.col("lang") == "fr", "Pricing").when(F.col("lang") == "de", "Risk & Capital; AI").otherwise("(internal)")
    return f.join(labels, "id", "left").select(
        i.alias("cid"),
        F.col("url").alias("file_url"),
        F.when(F.coalesce("toxic", F.lit(0)) == 1, "error").otherwise("ok").alias("status"),
        F.when(i % 19 == 0, "old").otherwise(F.col("sha256")).alias("file_sha256"),
        F.when(i % 5 == 0, "v1").otherwise("v2").alias("catalog_version"),
        F.when(i % 13 == 0, "").otherwise(F.substring("text", 1, 120)).alias("summary"),
        category.alias("category"),
        F.when(i % 7 == 0, "a, b").otherwise(F.concat(F.lit('["'), "lang", F.lit('", "'), "source_site", F.lit('"]'))).alias("keywords"),
        F.when(i % 5 != 0, F.col("text")).alias("markdown_content"),
        F.timestamp_micros((F.lit(1704067200) + i * 2220 + 172800) * 1000000).alias("markdown_updated_at"),
    )


def kb_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    indexed = F.timestamp_micros((F.lit(1704067200) + i * 2220 + 86400 + (i % 4) * 43200) * 1000000)
    return files(spark, sf_dir).select(F.col("lang").alias("kb_id"), F.col("url").alias("file_url"), i.alias("fid"), F.when(i % 3 != 0, indexed).alias("indexed_at"), (i % 4).alias("chunk_count"))


def chunk_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return (
        files(spark, sf_dir)
        .select("id", F.col("url").alias("file_url"), F.explode(F.when(i % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("v"))
        .select(
            F.concat_ws("-", F.lit("cs"), i.cast("string"), F.col("v").cast("string")).alias("chunk_set_id"),
            "file_url",
            F.lit("p1").alias("profile_id"),
            F.when(i % 23 == 0, "pending").otherwise("ready").alias("status"),
            (i % 6 + F.col("v")).alias("chunk_count"),
            F.timestamp_micros((F.lit(1704067200) + i * 2220 + F.col("v") * 86400) * 1000000).alias("updated_at"),
        )
    )


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return files(spark, sf_dir).filter(i % 3 != 1).select(F.col("lang").alias("kb_id"), F.col("url").alias("file_url"), F.concat(F.lit("cs-"), i.cast("string"), F.lit("-1")).alias("chunk_set_id"), F.when(i % 2 == 0, "follow_latest").otherwise("pin").alias("binding_mode"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown documents: a heading, a formula, a table and a second heading before the text; every fifth has its text only."""
    d, i = raw(spark, sf_dir, "documents"), F.col("doc_id")
    num = i.cast("string")
    plain = F.translate(F.coalesce("text", F.lit("")), "=|#", "   ")
    title = F.when(i % 3 == 0, F.concat(F.lit("Guideline "), num, F.lit(" "), "source")).when(i % 3 == 1, F.concat(F.lit("Article "), (i % 20).cast("string"), F.lit(" in "), "lang")).otherwise(F.concat(F.lit("第"), num, F.lit("号 "), "source"))
    head = F.concat(F.lit("# "), "source", F.lit("\nNet Premium = PV Benefits / "), "lang", F.lit("\n| Term | Value | term |\n|---|:---:|---|\n| reserve | "), F.col("n_chars").cast("string"), F.lit(" |\n| v | x | "), "lang", F.lit(" |\n"))
    return d.select(
        "doc_id",
        F.concat(F.lit("doc://"), num).alias("file_url"),
        title.alias("title"),
        F.when(i % 2 == 0, "Pricing").otherwise("Risk").alias("category"),
        F.col("source").alias("source_site"),
        F.concat(F.lit("About "), "lang").alias("summary"),
        "lang",
        "n_chars",
        F.when(i % 5 == 0, plain).otherwise(F.concat(head, F.lit("## "), "lang", F.lit("\n"), plain)).alias("md"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("token_count"))


_T = "make_timestamp((1704067200 + {}) * 1000000)"
DUCK = f"""
files AS (SELECT doc_id AS id, 'doc://' || doc_id AS url, sha256(text) AS sha256, split_part(text, chr(10), 1) AS title, source AS source_site,
  'f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' ELSE '.txt' END AS original_filename,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE '/data/' || doc_id END AS local_path, n_chars AS bytes,
  CASE doc_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' ELSE 'text/plain' END AS content_type,
  {_T.format('doc_id * 2220')} AS first_seen, {_T.format('doc_id * 2220 + (doc_id % 7) * 86400')} AS last_seen,
  CASE WHEN doc_id % 29 = 0 THEN {_T.format('doc_id * 2220 + (doc_id % 7) * 86400')} END AS deleted_at, lang, text FROM documents),
catalog AS (SELECT f.id AS cid, url AS file_url, CASE WHEN coalesce(toxic, 0) = 1 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN f.id % 19 = 0 THEN 'old' ELSE sha256 END AS file_sha256, CASE WHEN f.id % 5 = 0 THEN 'v1' ELSE 'v2' END AS catalog_version,
  CASE WHEN f.id % 13 = 0 THEN '' ELSE substring(text, 1, 120) END AS summary,
  CASE lang WHEN 'en' THEN 'AI; Pricing' WHEN 'fr' THEN 'Pricing' WHEN 'de' THEN 'Risk & Capital; AI' ELSE '(internal)' END AS category,
  CASE WHEN f.id % 7 = 0 THEN 'a, b' ELSE '["' || lang || '", "' || source_site || '"]' END AS keywords,
  CASE WHEN f.id % 5 <> 0 THEN text END AS markdown_content, {_T.format('f.id * 2220 + 172800')} AS markdown_updated_at
  FROM files f LEFT JOIN labels l ON f.id = l.doc_id WHERE f.id % 11 <> 0),
kb_files AS (SELECT lang AS kb_id, url AS file_url, id AS fid, CASE WHEN id % 3 <> 0 THEN {_T.format('id * 2220 + 86400 + (id % 4) * 43200')} END AS indexed_at, id % 4 AS chunk_count FROM files),
chunk_sets AS (SELECT 'cs-' || id || '-' || v AS chunk_set_id, url AS file_url, 'p1' AS profile_id, CASE WHEN id % 23 = 0 THEN 'pending' ELSE 'ready' END AS status,
  id % 6 + v AS chunk_count, {_T.format('id * 2220 + v * 86400')} AS updated_at FROM files, (VALUES (1), (2)) AS x(v) WHERE v = 1 OR id % 4 = 0),
bindings AS (SELECT lang AS kb_id, url AS file_url, 'cs-' || id || '-1' AS chunk_set_id, CASE WHEN id % 2 = 0 THEN 'follow_latest' ELSE 'pin' END AS binding_mode FROM files WHERE id % 3 <> 1),
markdown AS (SELECT doc_id, 'doc://' || doc_id AS file_url, CASE doc_id % 3 WHEN 0 THEN 'Guideline ' || doc_id || ' ' || source WHEN 1 THEN 'Article ' || (doc_id % 20) || ' in ' || lang ELSE '第' || doc_id || '号 ' || source END AS title,
  CASE WHEN doc_id % 2 = 0 THEN 'Pricing' ELSE 'Risk' END AS category, source AS source_site, 'About ' || lang AS summary, lang, n_chars, translate(coalesce(text, ''), '=|#', '   ') AS plain,
  '# ' || source || chr(10) || 'Net Premium = PV Benefits / ' || lang || chr(10) || '| Term | Value | term |' || chr(10) || '|---|:---:|---|' || chr(10) || '| reserve | ' || n_chars || ' |' || chr(10) || '| v | x | ' || lang || ' |' || chr(10) AS head FROM documents),
md_sections AS (SELECT doc_id, file_url, title, doc_id || '#section-1' AS section_id, CASE WHEN doc_id % 5 = 0 THEN 'Markdown' ELSE source_site END AS heading, CASE WHEN doc_id % 5 = 0 THEN plain ELSE head END AS text FROM markdown WHERE doc_id % 5 <> 0 OR trim(plain) <> ''
  UNION ALL SELECT doc_id, file_url, title, doc_id || '#section-2', lang, '## ' || lang || chr(10) || plain FROM markdown WHERE doc_id % 5 <> 0),
md_formulas AS (SELECT doc_id, file_url, title, section_id, section_id || '#formula-1' AS formula_id, heading, 'Net Premium = PV Benefits / ' || lang AS formula_text, trim(regexp_replace(head, '\\s+', ' ', 'g')) AS context,
  ['Net Premium', 'PV Benefits', 'reserve', 'premium', 'v'] AS terms FROM md_sections JOIN (SELECT doc_id, lang, head FROM markdown) USING (doc_id) WHERE doc_id % 5 <> 0 AND ends_with(section_id, '#section-1')),
md_tables AS (SELECT doc_id, file_url, title, section_id, section_id || '#table-1' AS table_id, heading, ['Term', 'Value', 'term_2'] AS headers, [['reserve', CAST(n_chars AS VARCHAR), ''], ['v', 'x', lang]] AS rows FROM md_sections JOIN (SELECT doc_id, lang, n_chars FROM markdown) USING (doc_id) WHERE doc_id % 5 <> 0 AND ends_with(section_id, '#section-1')),
messages AS (SELECT conv_id, turn, role, text, CAST(greatest(1, length(text) // 4) AS BIGINT) AS token_count FROM conversations)
"""


def duck(sql: str) -> str:
    """A check over the bound tables: ``sql`` may start with WITH of its own."""
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {DUCK}, {body[15:]}"
    return f"WITH {DUCK}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {DUCK} {body}"
