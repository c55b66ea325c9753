"""All queries of the engine by name, with the DuckDB text that checks them.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import builder, chunking, evidence, listing, merge, router, stats, textpipe, vectors
from docloom.plans import bindings as b
from docloom.sources import readers
from docloom.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

NOT_BLANK = "trim(coalesce({0}, '')) <> ''"
PARTS = "list_filter(list_transform(string_split(coalesce(category, ''), ';'), lambda x: trim(x)), lambda p: p <> '' AND NOT (p LIKE '(%' AND p LIKE '%)'))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = b.duck(sql)
        return f

    return add


def _load() -> None:
    """The modules that register queries of their own."""
    from docloom.plans import answer_queries, catalog_queries, derived_queries, folder_queries, more_queries, ready_queries, rule_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["joi01_srt01_file_page"](spark, sf_dir)


# --- scans, filters, projections --------------------------------------------------------


@query("joi01_srt01_file_page", """SELECT id, title, category, status, last_seen FROM files f LEFT JOIN catalog c ON f.url = c.file_url
 WHERE trim(coalesce(local_path, '')) <> '' AND deleted_at IS NULL AND (contains(lower(coalesce(title, '')), 'the') OR contains(lower(coalesce(original_filename, '')), 'the') OR contains(lower(url), 'the')
 OR contains(lower(coalesce(summary, '')), 'the') OR contains(lower(coalesce(keywords, '')), 'the') OR contains(lower(coalesce(category, '')), 'the') OR contains(lower(coalesce(markdown_content, '')), 'the'))
 AND (category = 'AI' OR category ILIKE 'AI;%' OR category ILIKE '%; AI' OR category ILIKE '%; AI;%') ORDER BY last_seen DESC, id LIMIT 20 OFFSET 5""")  # fmt: skip
def _file_page(spark, d):
    return listing.query_files(b.files(spark, d), b.catalog(spark, d), "the", "AI", limit=20, offset=5).select("id", "title", "category", "status", "last_seen")


@query("src02_export_files", "SELECT url, sha256, title, source_site, bytes, last_seen FROM files")
def _export(spark, d):
    return b.files(spark, d).select("url", "sha256", "title", "source_site", "bytes", "last_seen")


@query("src07_builder_snapshot", "SELECT x.kb_id, x.file_url, k.category, f.title, c.chunk_set_id, c.chunk_count FROM bindings x JOIN catalog k ON x.file_url = k.file_url AND k.status = 'ok' LEFT JOIN files f ON f.url = x.file_url JOIN chunk_sets c ON c.chunk_set_id = x.chunk_set_id")
def _snapshot(spark, d):
    ok = b.catalog(spark, d).filter("status = 'ok'").select("file_url", "category")
    titles = b.files(spark, d).select(F.col("url").alias("file_url"), "title")
    bound = b.bindings(spark, d).join(ok, "file_url").join(titles, "file_url", "left").join(b.chunk_sets(spark, d).select("chunk_set_id", "chunk_count"), "chunk_set_id")
    return bound.select("kb_id", "file_url", "category", "title", "chunk_set_id", "chunk_count")


@query("src12_html_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def _html(spark, d):
    return b.raw(spark, d, "pages").select("page_id", tx.html_text("html").alias("text"))


_MARKS = "\\`*_{}[]()#+-.!|"
_ESCAPED = "text"
for _c in _MARKS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{chr(92)}{_c}')"


@query("src14_escape_markdown", f"SELECT doc_id, {_ESCAPED} AS escaped FROM documents")
def _escape(spark, d):
    return b.raw(spark, d, "documents").select("doc_id", tx.escape_markdown("text").alias("escaped"))


@query("src18_str15_page_links", r"""SELECT page_id, pos - 1 AS pos, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*["'']([^"''>]+)["'']', 1)) AS link, generate_subscripts(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*["'']([^"''>]+)["'']', 1), 1) AS pos FROM pages)
 WHERE NOT starts_with(lower(trim(link)), 'mailto:') AND NOT starts_with(lower(trim(link)), 'javascript:') AND NOT starts_with(lower(trim(link)), '#') AND trim(link) <> ''""")  # fmt: skip
def _links(spark, d):
    return readers.page_links(b.raw(spark, d, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


@query("str14_page_titles", r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def _titles(spark, d):
    return b.raw(spark, d, "pages").select("page_id", readers.page_title("html").alias("title"))


@query("src20_stm11_unseen", "SELECT id FROM files f WHERE NOT EXISTS (SELECT 1 FROM files k WHERE k.id % 2 = 0 AND k.url = f.url) AND NOT EXISTS (SELECT 1 FROM files k WHERE k.id % 2 = 0 AND k.sha256 = f.sha256)")
def _unseen(spark, d):
    f = b.files(spark, d)
    return readers.unseen(f, f.filter("id % 2 = 0")).select("id")


@query("fil03_uncategorized", "SELECT id FROM files f LEFT JOIN catalog c ON f.url = c.file_url WHERE c.file_url IS NULL OR trim(coalesce(category, '')) = '' OR trim(coalesce(summary, '')) = '' OR regexp_matches(trim(category), '^\\(.*\\)$')")
def _uncategorized(spark, d):
    return listing.with_catalog(b.files(spark, d), b.catalog(spark, d)).filter(listing.uncategorized()).select("id")


@query("fil05_stm09_changed_files", "SELECT id FROM files f LEFT JOIN catalog c ON f.url = c.file_url WHERE c.file_url IS NULL OR file_sha256 IS NULL OR file_sha256 <> sha256 OR coalesce(catalog_version, '') <> 'v2' OR trim(coalesce(summary, '')) = '' OR status = 'error'")
def _changed(spark, d):
    return listing.with_catalog(b.files(spark, d), b.catalog(spark, d)).filter(listing.needs_catalog("v2", True)).select("id")


@query("fil07_count_candidates", "SELECT count(*) AS n FROM files f LEFT JOIN catalog c ON f.url = c.file_url WHERE c.file_url IS NULL OR file_sha256 IS NULL OR file_sha256 <> sha256 OR coalesce(catalog_version, '') <> 'v2' OR trim(coalesce(summary, '')) = ''")
def _count_candidates(spark, d):
    return listing.with_catalog(b.files(spark, d), b.catalog(spark, d)).filter(listing.needs_catalog("v2")).agg(F.count("*").alias("n"))


@query("fil09_convertible", "SELECT id FROM files WHERE content_type ILIKE '%pdf%' OR content_type ILIKE '%html%'")
def _convertible(spark, d):
    return b.files(spark, d).filter(F.col("content_type").rlike(listing.CONVERTIBLE)).select("id")


@query("fil10_joi06_without_chunks", "SELECT cid FROM catalog c WHERE trim(coalesce(markdown_content, '')) <> '' AND NOT EXISTS (SELECT 1 FROM chunk_sets s WHERE s.file_url = c.file_url AND s.profile_id = 'p1' AND s.status = 'ready')")
def _without(spark, d):
    return listing.without_chunks(b.catalog(spark, d), b.chunk_sets(spark, d).filter("status = 'ready'"), "p1").select("cid")


@query("fil13_url_filters", "SELECT page_id FROM pages WHERE regexp_matches(lower(url), '\\.html?([?#]|$)') AND NOT contains(lower(url), 'spam')")
def _url_filters(spark, d):
    u = F.lower("url")
    return b.raw(spark, d, "pages").filter(u.rlike(r"\.html?([?#]|$)") & ~u.contains("spam")).select("page_id")


@query("fil14_ai_related", "SELECT doc_id, regexp_matches(lower(text), '\\b(ea|ti|model)\\b') AS ai FROM documents")
def _ai(spark, d):
    return b.raw(spark, d, "documents").select("doc_id", F.lower("text").rlike(r"\b(ea|ti|model)\b").alias("ai"))


@query("fil16_looks_bad", r"SELECT doc_id, length(text) < 800 OR len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) > length(text) * 0.02 OR len(regexp_extract_all(text, '\n{3}')) > 5 AS bad FROM documents")
def _bad(spark, d):
    return b.raw(spark, d, "documents").select("doc_id", tx.looks_bad("text").alias("bad"))


@query("fil19_kb_file_status", """WITH newest AS (SELECT file_url, arg_max(chunk_set_id, updated_at) AS newest FROM chunk_sets WHERE status = 'ready' GROUP BY file_url)
 SELECT x.kb_id, x.file_url, CASE WHEN k.indexed_at IS NULL THEN 'pending' WHEN newest IS NOT NULL AND newest <> chunk_set_id THEN 'stale' ELSE 'indexed' END AS status
 FROM bindings x JOIN kb_files k ON k.kb_id = x.kb_id AND k.file_url = x.file_url LEFT JOIN newest n ON n.file_url = x.file_url""")  # fmt: skip
def _kb_status(spark, d):
    newest = merge.latest_ready_sets(b.chunk_sets(spark, d)).select("file_url", F.col("chunk_set_id").alias("newest"))
    j = b.bindings(spark, d).join(b.kb_files(spark, d).select("kb_id", "file_url", "indexed_at"), ["kb_id", "file_url"]).join(newest, "file_url", "left")
    status = F.when(F.col("indexed_at").isNull(), "pending").when(F.col("newest") != F.col("chunk_set_id"), "stale").otherwise("indexed")
    return j.select("kb_id", "file_url", status.alias("status"))


@query("prj02_point_lookups", "SELECT id, url, sha256, title FROM files WHERE url IN ('doc://7', 'doc://3', 'doc://99999999')")
def _points(spark, d):
    wanted = spark.createDataFrame([("doc://7", 0), ("doc://3", 1), ("doc://99999999", 2)], "url string, pos int")
    return listing.by_urls(b.files(spark, d), F.broadcast(wanted)).filter("id IS NOT NULL").select("id", "url", "sha256", "title")


# --- joins ------------------------------------------------------------------------------


@query("joi03_joi13_pending_index", "SELECT kb_id, k.file_url FROM kb_files k JOIN catalog c ON c.file_url = k.file_url WHERE trim(coalesce(markdown_content, '')) <> '' AND (indexed_at IS NULL OR markdown_updated_at > indexed_at)")
def _pending(spark, d):
    return listing.pending_index(b.kb_files(spark, d), b.catalog(spark, d)).select("kb_id", "file_url")


@query("joi05_semi_ready", "SELECT id FROM files f WHERE EXISTS (SELECT 1 FROM chunk_sets s WHERE s.file_url = f.url AND s.status = 'ready')")
def _semi(spark, d):
    return b.files(spark, d).join(b.chunk_sets(spark, d).filter("status = 'ready'").select(F.col("file_url").alias("url")), "url", "left_semi").select("id")


@query("joi07_affected_kbs", "SELECT kb_id, bool_or(binding_mode = 'pin') AS pinned, count(*) AS n FROM bindings x WHERE EXISTS (SELECT 1 FROM chunk_sets s WHERE s.chunk_set_id = x.chunk_set_id) OR NOT EXISTS (SELECT 1 FROM kb_files k WHERE k.file_url = x.file_url) GROUP BY kb_id")
def _affected(spark, d):
    sets = b.chunk_sets(spark, d).select("chunk_set_id", F.lit(True).alias("has_set")).distinct()
    members = b.kb_files(spark, d).select("file_url", F.lit(True).alias("member")).distinct()
    j = b.bindings(spark, d).join(sets, "chunk_set_id", "left").join(members, "file_url", "left").filter("has_set IS NOT NULL OR member IS NULL")
    return j.groupBy("kb_id").agg(F.bool_or(F.col("binding_mode") == "pin").alias("pinned"), F.count("*").alias("n"))


@query("joi09_win05_latest_set", "SELECT x.kb_id, x.file_url, x.chunk_set_id, (SELECT arg_max(s.chunk_set_id, s.updated_at) FROM chunk_sets s WHERE s.file_url = x.file_url AND s.status = 'ready') AS newest FROM bindings x")
def _latest_set(spark, d):
    newest = merge.latest_ready_sets(b.chunk_sets(spark, d)).select("file_url", F.col("chunk_set_id").alias("newest"))
    return b.bindings(spark, d).join(newest, "file_url", "left").select("kb_id", "file_url", "chunk_set_id", "newest")


@query("joi11_bound_counts", "SELECT s.chunk_set_id, (SELECT count(*) FROM bindings x WHERE x.chunk_set_id = s.chunk_set_id) AS bound_kb_count FROM chunk_sets s")
def _bound(spark, d):
    n = b.bindings(spark, d).groupBy("chunk_set_id").agg(F.count("*").alias("n"))
    return b.chunk_sets(spark, d).join(n, "chunk_set_id", "left").select("chunk_set_id", F.coalesce("n", F.lit(0)).alias("bound_kb_count"))


@query("joi12_win04_selectable", "SELECT f.id, s.chunk_set_id FROM files f JOIN (SELECT *, row_number() OVER (PARTITION BY file_url, profile_id ORDER BY updated_at DESC, chunk_set_id DESC) AS rn FROM chunk_sets WHERE status = 'ready') s ON s.file_url = f.url AND rn = 1 WHERE NOT EXISTS (SELECT 1 FROM bindings x WHERE x.file_url = f.url)")
def _selectable(spark, d):
    free = b.files(spark, d).join(b.bindings(spark, d).select(F.col("file_url").alias("url")), "url", "left_anti")
    sets = merge.latest_ready_sets(b.chunk_sets(spark, d))
    return free.join(sets, free["url"] == sets["file_url"]).select("id", "chunk_set_id")


@query("joi14_merge_summaries", "SELECT coalesce(a.file_url, z.file_url) AS file_url, coalesce(nullif(z.s, ''), a.s) AS summary FROM (SELECT file_url, summary AS s FROM catalog WHERE cid % 2 = 0) a FULL OUTER JOIN (SELECT file_url, CASE WHEN cid % 10 = 0 THEN '' ELSE 'n' || summary END AS s FROM catalog WHERE cid % 5 = 0 OR cid % 2 = 1) z ON a.file_url = z.file_url")
def _merge_summaries(spark, d):
    c = b.catalog(spark, d)
    a = c.filter("cid % 2 = 0").select("file_url", F.col("summary").alias("a"))
    z = c.filter("cid % 5 = 0 OR cid % 2 = 1").select("file_url", F.when(F.col("cid") % 10 == 0, "").otherwise(F.concat(F.lit("n"), "summary")).alias("z"))
    return a.join(z, "file_url", "full_outer").select("file_url", F.coalesce(F.nullif("z", F.lit("")), "a").alias("summary"))


@query("joi19_category_files", "SELECT c.file_url, s.chunk_set_id FROM catalog c JOIN chunk_sets s ON s.file_url = c.file_url WHERE category = 'Pricing' OR category ILIKE 'Pricing;%' OR category ILIKE '%; Pricing' OR category ILIKE '%; Pricing;%'")
def _category_files(spark, d):
    return b.catalog(spark, d).filter(tx.in_category("category", "Pricing")).join(b.chunk_sets(spark, d), "file_url").select("file_url", "chunk_set_id")


@query("joi21_changes", "SELECT coalesce(a.url, z.url) AS url, CASE WHEN a.url IS NULL THEN 'added' WHEN z.url IS NULL THEN 'removed' ELSE 'bytes' END AS reason FROM (SELECT * FROM files WHERE id % 7 <> 0) a FULL OUTER JOIN (SELECT url, CASE WHEN id % 5 = 0 THEN bytes + 1 ELSE bytes END AS bytes, title FROM files WHERE id % 11 <> 0) z ON a.url = z.url WHERE a.url IS NULL OR z.url IS NULL OR a.bytes <> z.bytes")
def _changes(spark, d):
    f = b.files(spark, d).select("id", "url", "bytes", "title")
    after = f.filter("id % 11 <> 0").withColumn("bytes", F.when(F.col("id") % 5 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return merge.changes(f.filter("id % 7 <> 0"), after, "url", ["bytes", "title"])


# --- aggregates -------------------------------------------------------------------------


@query("agg13_dashboard", f"""SELECT * FROM (SELECT count(*) FILTER ({NOT_BLANK.format('local_path')} AND deleted_at IS NULL) AS n_files, count(DISTINCT source_site) AS n_sources, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM files),
 (SELECT count(*) FILTER (status = 'ok') AS n_cataloged, count(*) FILTER (status = 'error') AS n_errors, count(*) FILTER ({NOT_BLANK.format('markdown_content')}) AS n_markdown FROM catalog)""")  # fmt: skip
def _dashboard(spark, d):
    return stats.dashboard(b.files(spark, d), b.catalog(spark, d))


@query("agg03_fil12_categories", f"SELECT DISTINCT category FROM (SELECT unnest({PARTS}) AS category FROM catalog)")
def _categories(spark, d):
    return stats.unique_categories(b.catalog(spark, d))


@query("agg04_category_counts", "SELECT category, count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (trim(coalesce(summary, '')) = '') AS no_summary FROM catalog GROUP BY category")
def _category_counts(spark, d):
    return stats.category_counts(b.catalog(spark, d))


@query("agg05_markdown_by_source", "SELECT source_site, count(*) AS total, count(*) FILTER (trim(coalesce(markdown_content, '')) <> '') AS with_markdown FROM files f LEFT JOIN catalog c ON f.url = c.file_url GROUP BY source_site ORDER BY total DESC, source_site LIMIT 20")
def _by_source(spark, d):
    return stats.markdown_by_source(b.files(spark, d), b.catalog(spark, d))


@query("agg07_joi08_category_chunks", f"""WITH x AS (SELECT file_url, trim(coalesce(markdown_content, '')) <> '' AS md, unnest({PARTS}) AS category FROM catalog)
 SELECT category, count(DISTINCT file_url) AS files, count(DISTINCT CASE WHEN md THEN file_url END) AS with_markdown,
 count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM chunk_sets s WHERE s.file_url = x.file_url) THEN file_url END) AS with_chunks,
 count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM chunk_sets s WHERE s.file_url = x.file_url AND s.status = 'ready') THEN file_url END) AS with_ready FROM x GROUP BY category""")  # fmt: skip
def _category_chunks(spark, d):
    return stats.category_chunk_stats(b.catalog(spark, d), b.chunk_sets(spark, d))


@query("agg09_kb_stats", "SELECT kb_id, count(*) AS file_count, count(indexed_at) AS indexed, count(*) FILTER (indexed_at IS NULL) AS pending, CAST(sum(chunk_count) AS BIGINT) AS chunk_count, max(indexed_at) AS last_indexed FROM kb_files GROUP BY kb_id")
def _kb_stats(spark, d):
    return stats.kb_stats(b.kb_files(spark, d))


@query("agg10_composition", """WITH newest AS (SELECT file_url, arg_max(chunk_set_id, updated_at) AS newest FROM chunk_sets WHERE status = 'ready' GROUP BY file_url),
 bb AS (SELECT kb_id, count(DISTINCT x.file_url) AS bound_files, CAST(sum(chunk_count) AS BIGINT) AS bound_chunks, count(*) FILTER (binding_mode = 'follow_latest' AND newest <> x.chunk_set_id) AS outdated
 FROM bindings x LEFT JOIN chunk_sets s ON s.chunk_set_id = x.chunk_set_id LEFT JOIN newest n ON n.file_url = x.file_url GROUP BY kb_id),
 k AS (SELECT kb_id, count(*) FILTER (indexed_at IS NULL) AS unindexed FROM kb_files GROUP BY kb_id)
 SELECT kb_id, unindexed, coalesce(bound_files, 0) AS bound_files, coalesce(bound_chunks, 0) AS bound_chunks, coalesce(outdated, 0) AS outdated, coalesce(outdated, 0) > 0 OR unindexed > 0 AS needs_reindex FROM k LEFT JOIN bb USING (kb_id)""")  # fmt: skip
def _composition(spark, d):
    return stats.composition(b.bindings(spark, d), b.chunk_sets(spark, d), b.kb_files(spark, d))


@query("agg11_conversation_stats", "SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, CAST(sum(token_count) AS BIGINT) AS tokens FROM messages GROUP BY conv_id")
def _conv_stats(spark, d):
    return stats.conversation_stats(b.messages(spark, d))


@query("agg12_unmapped_categories", f"SELECT category, count(DISTINCT file_url) AS n FROM (SELECT file_url, unnest({PARTS}) AS category FROM catalog) WHERE category NOT IN ('AI') GROUP BY category")
def _unmapped(spark, d):
    mapped = spark.createDataFrame([("AI",)], "category string")
    rows = b.catalog(spark, d).select("file_url", F.explode(tx.visible_categories("category")).alias("category")).join(F.broadcast(mapped), "category", "left_anti")
    return rows.groupBy("category").agg(F.countDistinct("file_url").alias("n"))


@query("agg14_sections_by_doc", "SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn, text) AS sections_text FROM conversations GROUP BY conv_id")
def _sections(spark, d):
    return stats.sections_by_doc(b.messages(spark, d).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text"))


@query("agg20_stm10_daily_quota", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def _quota(spark, d):
    return streams.daily_quota(b.raw(spark, d, "events"), 3).select("event_id", "user_id", "allowed")


# --- windows, order, sets ---------------------------------------------------------------


@query("win01_first_candidate", "SELECT coalesce(min(rn), 0) AS first_position FROM (SELECT *, row_number() OVER (ORDER BY id DESC) AS rn FROM files f LEFT JOIN catalog c ON f.url = c.file_url) WHERE file_url IS NULL OR file_sha256 IS NULL OR file_sha256 <> sha256 OR coalesce(catalog_version, '') <> 'v2' OR trim(coalesce(summary, '')) = ''")
def _first(spark, d):
    return listing.first_position(listing.with_catalog(b.files(spark, d), b.catalog(spark, d)), listing.needs_catalog("v2"))


@query("win02_first_without_markdown", "SELECT coalesce(min(rn), 0) AS first_position FROM (SELECT *, row_number() OVER (ORDER BY id DESC) AS rn FROM files f LEFT JOIN catalog c ON f.url = c.file_url) WHERE trim(coalesce(markdown_content, '')) = ''")
def _first_md(spark, d):
    return listing.first_position(listing.with_catalog(b.files(spark, d), b.catalog(spark, d)), tx.blank("markdown_content"))


@query("win03_first_without_chunks", "SELECT coalesce(min(rn), 0) AS first_position FROM (SELECT f.id, r.file_url AS ready, row_number() OVER (ORDER BY id DESC) AS rn FROM files f LEFT JOIN (SELECT DISTINCT file_url FROM chunk_sets WHERE status = 'ready') r ON r.file_url = f.url) WHERE ready IS NULL")
def _first_chunks(spark, d):
    ready = b.chunk_sets(spark, d).filter("status = 'ready'").select(F.col("file_url").alias("ready")).distinct()
    f = b.files(spark, d)
    return listing.first_position(f.join(ready, f["url"] == F.col("ready"), "left"), F.col("ready").isNull())


@query("win06_context_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(token_count) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM messages) WHERE used <= 400")
def _context(spark, d):
    return streams.context_window(b.messages(spark, d), 400).select("conv_id", "turn")


@query("win10_stm08_gc_plan", "SELECT chunk_set_id, CASE WHEN rn <= 1 THEN 'retained' WHEN updated_at > TIMESTAMP '2024-01-10' THEN 'skipped' ELSE 'candidate' END AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY file_url ORDER BY updated_at DESC, chunk_set_id) AS rn FROM chunk_sets)")
def _gc(spark, d):
    rn = F.row_number().over(Window.partitionBy("file_url").orderBy(F.desc("updated_at"), "chunk_set_id"))
    bucket = F.when(F.col("rn") <= 1, "retained").when(F.col("updated_at") > F.lit("2024-01-10").cast("timestamp"), "skipped").otherwise("candidate")
    return b.chunk_sets(spark, d).withColumn("rn", rn).select("chunk_set_id", bucket.alias("bucket"))


@query("srt02_srh16_week_files", "SELECT id, url, first_seen FROM files WHERE first_seen >= TIMESTAMP '2024-01-08' AND first_seen < TIMESTAMP '2024-01-15' ORDER BY first_seen DESC, url LIMIT 5000")
def _week_files(spark, d):
    at = lambda x: F.lit(x).cast("timestamp")
    return listing.recent_files(b.files(spark, d), at("2024-01-08"), at("2024-01-15")).select("id", "url", "first_seen")


@query("set01_tagged_union", "SELECT 'file' AS tag, count(*) AS n FROM files UNION ALL SELECT 'catalog', count(*) FROM catalog UNION ALL SELECT 'chunks', count(*) FROM chunk_sets")
def _tagged(spark, d):
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("tag"), "n") for t, df in (("file", b.files(spark, d)), ("catalog", b.catalog(spark, d)), ("chunks", b.chunk_sets(spark, d)))]
    return parts[0].union(parts[1]).union(parts[2])


@query("set07_category_union", f"SELECT category FROM (SELECT unnest({PARTS}) AS category FROM catalog) UNION SELECT DISTINCT lang FROM files")
def _category_union(spark, d):
    return stats.unique_categories(b.catalog(spark, d)).union(b.files(spark, d).select("lang")).distinct()


# --- functions --------------------------------------------------------------------------


@query("str04_snippets", r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(substring(t, 1, 237)) || '...' END AS snippet FROM f")
def _snippets(spark, d):
    return b.raw(spark, d, "documents").select("doc_id", tx.snippet("text").alias("snippet"))


@query("str06_slugs", r"SELECT id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (SELECT id, regexp_replace(regexp_replace(lower(trim(coalesce(title, ''))), '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM files)")
def _slugs(spark, d):
    return b.files(spark, d).select("id", tx.slug("title").alias("slug"))


@query("str20_sentences", r"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 20)) AS n FROM documents")
def _sentences(spark, d):
    return b.raw(spark, d, "documents").select("doc_id", F.size(tx.sentences("text")).cast("long").alias("n"))


@query("str21_squash", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def _squash(spark, d):
    return b.raw(spark, d, "documents").select("doc_id", tx.squash("text").alias("text"))


@query("jsn01_keywords", "SELECT cid, CASE WHEN starts_with(keywords, '[') THEN CAST(keywords::JSON AS VARCHAR[]) ELSE list_transform(string_split(keywords, ','), lambda x: trim(x)) END AS kw FROM catalog")
def _keywords_json(spark, d):
    return b.catalog(spark, d).select("cid", tx.keyword_list("keywords").alias("kw"))


@query("jsn02_event_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _props(spark, d):
    return b.raw(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("dat01_weeks", "SELECT id, date_trunc('week', first_seen) AS week FROM files")
def _weeks(spark, d):
    return b.files(spark, d).select("id", tx.week_start("first_seen").alias("week"))


# --- text -------------------------------------------------------------------------------


_SPECIAL = r"\b(ifrs\s*17|covid[-\s]*19|solvency\s*ii)\b"
_GOOD = "length({0}) >= 3 AND {0} NOT IN (" + ", ".join(f"'{w}'" for w in textpipe.STOP) + ")"


def keywords_sql(rows: str) -> str:
    """(doc_id, keywords) of rows (doc_id, text, title)."""
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9-]*') AS w, regexp_extract_all(lower(title), '[a-z][a-z0-9-]*') AS h, regexp_extract_all(lower(title || chr(10) || text), '{_SPECIAL}') AS x FROM {rows}),
 p AS (SELECT doc_id, 0 AS kind, unnest(w) AS term, unnest(range(len(w))) AS pos, 1 AS n, 0 AS t FROM t UNION ALL SELECT doc_id, 0, unnest(h), 0, 0, 1 FROM t
  UNION ALL SELECT doc_id, 1, CASE WHEN {_GOOD.format('w[i]')} AND {_GOOD.format('w[i + 1]')} THEN w[i] || ' ' || w[i + 1] END, i, 1, 0 FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t)
  UNION ALL SELECT doc_id, 1, CASE WHEN {_GOOD.format('h[i]')} AND {_GOOD.format('h[i + 1]')} THEN h[i] || ' ' || h[i + 1] END, 0, 0, 1 FROM (SELECT doc_id, h, unnest(range(1, len(h))) AS i FROM t)
  UNION ALL SELECT doc_id, 2, regexp_replace(unnest(x), '\\s+', ' ', 'g'), unnest(range(len(x))), 1, 0 FROM t),
 s AS (SELECT doc_id, kind, term, sum(n) AS n, max(t) AS t, min(pos) FILTER (n > 0) AS pos FROM p WHERE term IS NOT NULL AND (kind > 0 OR {_GOOD.format('term')}) GROUP BY doc_id, kind, term HAVING sum(n) > 0),
 m AS (SELECT doc_id, term, sum(CASE kind WHEN 2 THEN 10 * n ELSE n + t * (3 + kind) END) AS score, min(kind * 10000000 + pos) AS first FROM s GROUP BY doc_id, term),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first, term) AS rn FROM m)
 SELECT d.doc_id, coalesce(k, CAST([] AS VARCHAR[])) AS keywords FROM {rows} d LEFT JOIN (SELECT doc_id, list(term ORDER BY rn) AS k FROM r WHERE rn <= 8 GROUP BY doc_id) USING (doc_id)"""


@query("txt01_keywords", keywords_sql("(SELECT doc_id, text, split_part(text, chr(10), 1) AS title FROM documents)"))
def _kw(spark, d):
    return textpipe.keywords(b.raw(spark, d, "documents"))


@query("txt03_summaries", r"""WITH s AS (SELECT doc_id, unnest(p) AS sentence, unnest(range(len(p))) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 20) AS p FROM documents)),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(contains(lower(sentence), 'the') AS INT) + CAST(contains(lower(sentence), 'ing') AS INT) + CAST(contains(lower(sentence), 'des') AS INT) DESC, pos) AS rn FROM s)
 SELECT d.doc_id, coalesce(x, '') AS summary FROM documents d LEFT JOIN (SELECT doc_id, string_agg(sentence, ' ' ORDER BY rn) AS x FROM r WHERE rn <= 4 GROUP BY doc_id) USING (doc_id)""")  # fmt: skip
def _sum(spark, d):
    docs = b.raw(spark, d, "documents")
    return textpipe.summarize(docs, F.array(F.lit("the"), F.lit("ing"), F.lit("des")))


_RULE = "list_filter([" + ", ".join("{'s': " + " + ".join(f"CAST(regexp_matches(lower(text), '(^|[^a-z0-9_]){t}([^a-z0-9_]|$)') AS INT)" for t in terms) + f", 'i': {i}, 'name': '{name}'}}" for i, (name, terms) in enumerate({"Alpha": ("the", "of"), "Beta": ("de", "la", "le"), "Gamma": ("der", "und")}.items())) + "], lambda x: x.s > 0)"


@query("txt04_categorize", f"WITH r AS (SELECT doc_id, unnest({_RULE}) AS x FROM documents) SELECT d.doc_id, coalesce((SELECT string_agg(x.name, '; ' ORDER BY x.s DESC, x.i) FROM r WHERE r.doc_id = d.doc_id), 'Other') AS category FROM documents d")
def _cat(spark, d):
    rules = {"Alpha": ("the", "of"), "Beta": ("de", "la", "le"), "Gamma": ("der", "und")}
    return b.raw(spark, d, "documents").select("doc_id", textpipe.categorize(F.col("text"), rules).alias("category"))


@query("txt10_chunks")
def _chunks(spark, d):
    return chunking.chunk_documents(b.raw(spark, d, "documents"))


@query("txt17_question_class", "SELECT item_id, CASE WHEN contains(lower(text), 'summar') OR contains(lower(text), 'overview') THEN 'summary' WHEN contains(lower(text), 'where') OR contains(lower(text), 'locate') OR contains(lower(text), 'find') THEN 'locate' WHEN contains(lower(text), 'list') OR contains(lower(text), 'catalog') OR contains(lower(text), 'which documents') THEN 'catalog' ELSE 'document_qa' END AS kind FROM benchmark")
def _question(spark, d):
    return b.raw(spark, d, "benchmark").select("item_id", textpipe.classify_question(F.col("text")).alias("kind"))


# --- vectors ----------------------------------------------------------------------------

_D2 = "list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))"


def _query_vector(spark, d):
    return b.raw(spark, d, "embeddings").filter("vec_id = 0").first().embedding


@query("vec02_top_k", f"SELECT vec_id, round(1 - {_D2} * {_D2} / 2, 5) AS score FROM embeddings ORDER BY {_D2}, vec_id LIMIT 10")
def _top(spark, d):
    return vectors.search(b.raw(spark, d, "embeddings"), _query_vector(spark, d)).select("vec_id", F.round("score", 5).alias("score"))


@query("vec07_collections", f"""WITH s AS (SELECT vec_id, label AS kb_id, 1 - {_D2} * {_D2} / 2 AS score, row_number() OVER (PARTITION BY label ORDER BY {_D2}, vec_id) AS rn FROM embeddings),
 n AS (SELECT *, least(1.0, score + 0.3 / (1 + count(*) OVER (PARTITION BY kb_id))) AS adjusted FROM s WHERE rn <= (SELECT greatest(10, 2 * count(DISTINCT label)) FROM embeddings)),
 r AS (SELECT *, row_number() OVER (ORDER BY adjusted DESC, vec_id) AS a, row_number() OVER (PARTITION BY kb_id ORDER BY adjusted DESC, vec_id) AS k FROM n)
 SELECT vec_id, kb_id, round(adjusted, 5) AS adjusted FROM r WHERE a <= 10 OR k <= 1""")  # fmt: skip
def _collections(spark, d):
    v = b.raw(spark, d, "embeddings").withColumnRenamed("label", "kb_id")
    return vectors.search_collections(v, _query_vector(spark, d)).select("vec_id", "kb_id", F.round("adjusted", 5).alias("adjusted"))


# --- evidence ---------------------------------------------------------------------------


def _score_sql(fields: dict[str, float], tokens: list[str]) -> str:
    return " + ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), '{t}') THEN {w} ELSE 0 END" for c, w in fields.items() for t in tokens)


@query("srh01_search_summaries", f"SELECT id, CAST(score AS DOUBLE) AS score FROM (SELECT id, title, {_score_sql({'summary': 4.0, 'title': 2.0, 'category': 1.0}, ['thing', 'pricing'])} + CASE WHEN contains(lower(summary), 'thing pricing') THEN 3 ELSE 0 END AS score FROM files f JOIN catalog c ON f.url = c.file_url) WHERE score > 0 ORDER BY score DESC, lower(title), id LIMIT 10")
def _summaries(spark, d):
    docs = listing.with_catalog(b.files(spark, d), b.catalog(spark, d), "inner")
    return evidence.search(docs.select("id", "title", "summary", "category"), "summaries", "thing pricing", 10, "id").select("id", "score")


@query("srh14_keyword_retriever", f"SELECT id, CAST(score AS DOUBLE) AS score FROM (SELECT id, {_score_sql({'t': 1.0}, ['the', 'ing', 'ea'])} AS score FROM (SELECT id, concat_ws(' ', title, summary, keywords) AS t FROM files f JOIN catalog c ON f.url = c.file_url)) WHERE score > 0 ORDER BY score DESC, id LIMIT 5")
def _retrieve(spark, d):
    docs = listing.with_catalog(b.files(spark, d), b.catalog(spark, d), "inner")
    return evidence.keyword_retrieve(docs, "the ing ea").select("id", "score")


@query("agg16_eval_rollup", "SELECT count(*) AS n_cases, count(*) FILTER (hits >= 1) AS n_passed, round(avg(CASE WHEN hits >= 1 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM (SELECT item_id, (SELECT count(*) FROM labels l WHERE l.doc_id = item_id AND quality = 1) AS hits FROM benchmark)")
def _rollup(spark, d):
    cases = b.raw(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.lit(1).alias("min_hits"))
    results = b.raw(spark, d, "labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("hit"))
    return evidence.evaluate(results, cases)


# --- merges and state -------------------------------------------------------------------


@query("dml01_upsert_files", "SELECT coalesce(o.id, n.id) AS id, coalesce(o.first_seen, n.first_seen) AS first_seen, CASE WHEN n.id IS NOT NULL THEN n.bytes ELSE o.bytes END AS bytes FROM (SELECT id, first_seen, bytes FROM files WHERE id % 3 <> 0) o FULL OUTER JOIN (SELECT id, last_seen AS first_seen, bytes * 2 AS bytes FROM files WHERE id % 2 = 0 OR id % 3 = 0) n ON o.id = n.id")
def _upsert(spark, d):
    f = b.files(spark, d)
    new = f.filter("id % 2 = 0 OR id % 3 = 0").select("id", F.col("last_seen").alias("first_seen"), (F.col("bytes") * 2).alias("bytes"))
    return merge.upsert(f.filter("id % 3 <> 0").select("id", "first_seen", "bytes"), new, ["id"], keep=("first_seen",))


@query("dml02_insert_new", "SELECT id, bytes FROM files WHERE id % 3 <> 0 UNION ALL SELECT id, bytes + 1 FROM files WHERE id % 3 = 0")
def _insert(spark, d):
    f = b.files(spark, d).select("id", "bytes")
    return merge.insert_new(f.filter("id % 3 <> 0"), f.filter("id % 2 = 0 OR id % 3 = 0").withColumn("bytes", F.col("bytes") + 1), ["id"])


@query("dml06_soft_delete", "SELECT id, CASE WHEN source_site = 'src1' THEN TIMESTAMP '2024-02-01' ELSE deleted_at END AS deleted_at FROM files")
def _soft(spark, d):
    return merge.set_where(b.files(spark, d), F.col("source_site") == "src1", deleted_at=F.lit("2024-02-01").cast("timestamp")).select("id", "deleted_at")


@query("dml12_follow_latest", "SELECT x.kb_id, x.file_url, CASE WHEN binding_mode = 'follow_latest' THEN coalesce((SELECT arg_max(s.chunk_set_id, s.updated_at) FROM chunk_sets s WHERE s.file_url = x.file_url AND s.status = 'ready'), chunk_set_id) ELSE chunk_set_id END AS chunk_set_id, binding_mode FROM bindings x")
def _follow(spark, d):
    return merge.follow_latest(b.bindings(spark, d), b.chunk_sets(spark, d))


@query("dml14_orphans", "SELECT chunk_set_id FROM (SELECT * FROM chunk_sets s WHERE NOT EXISTS (SELECT 1 FROM bindings x WHERE x.chunk_set_id = s.chunk_set_id) ORDER BY updated_at, chunk_set_id LIMIT 100) WHERE updated_at < TIMESTAMP '2024-01-05'")
def _orphans(spark, d):
    return merge.orphan_sets(b.chunk_sets(spark, d), b.bindings(spark, d), 100, F.lit("2024-01-05").cast("timestamp")).select("chunk_set_id")


@query("stm01_weekly_counts", "SELECT date_trunc('week', first_seen) AS week, count(*) AS n FROM files GROUP BY 1")
def _weekly(spark, d):
    return streams.weekly(b.files(spark, d))


def _source_events(spark, d):
    rank = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return b.raw(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 50).alias("kb"), F.col("event_type").alias("reason"), rank.alias("rank"))


@query("stm04_coalesced_events", """WITH e AS (SELECT event_id, ts, user_id % 50 AS kb, event_type AS reason, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS rank FROM events),
 r AS (SELECT kb, reason, count(*) AS n, max(rank) AS rank, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e FROM e GROUP BY kb, reason)
 SELECT kb, CAST(sum(n) AS BIGINT) AS generation, max(rank) AS rank, list(reason ORDER BY t, e) AS reasons FROM r GROUP BY kb""")  # fmt: skip
def _coalesced(spark, d):
    return streams.coalesce_events(_source_events(spark, d), ["kb"])


@query("stm02_rate_limit", """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS DOUBLE[]) AS passed, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS allowed FROM e
  UNION ALL SELECT user_id, rn, CASE WHEN ok THEN list_append(passed, t) ELSE passed END, event_id, ok FROM (SELECT e.user_id, e.rn, e.event_id, e.t, r.passed,
   len(list_filter(r.passed, lambda p: e.t - p < 3600)) < 3 AND len(list_filter(r.passed, lambda p: e.t - p < 86400)) < 5 AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
 SELECT e.event_id, e.user_id, e.ts, allowed FROM r JOIN e USING (event_id)""")  # fmt: skip
def _rate(spark, d):
    return streams.rate_limit(b.raw(spark, d, "events"), [(3, 3600.0), (5, 86400.0)])


# --- ready-data artifacts ---------------------------------------------------------------


@query("srh11_doc_catalog", r"SELECT regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS doc_id, file_url, title, category, summary FROM files f JOIN catalog c ON f.url = c.file_url AND status = 'ok'")
def _doc_catalog(spark, d):
    return builder.doc_catalog(b.files(spark, d), b.catalog(spark, d)).select("doc_id", "file_url", "title", "category", "summary")


@query("srh11_sections", r"SELECT doc_id, count(*) AS n FROM documents WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' GROUP BY doc_id")
def _section_counts(spark, d):
    return builder.sections(b.raw(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("srh11_formulas", """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
 SELECT doc_id, count(*) AS n FROM l WHERE contains(line, '=') AND length(line) <= 320 AND regexp_matches(line, '\\p{L}') AND NOT starts_with(line, '|') GROUP BY doc_id""")  # fmt: skip
def _formula_counts(spark, d):
    return builder.formulas(builder.sections(b.raw(spark, d, "documents"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("agg21_fingerprint")
def _fingerprint(spark, d):
    return builder.fingerprint(b.files(spark, d).drop("text"), "id")


@query("str08_word_counts", r"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS n FROM conversations")
def _word_counts(spark, d):
    return b.raw(spark, d, "conversations").select("conv_id", "turn", tx.word_count("text").cast("long").alias("n"))


# --- routing and retrieval --------------------------------------------------------------


@query("txt15_intents", """SELECT conv_id, turn, CASE WHEN contains(lower(text), 'compare') OR contains(lower(text), 'difference') OR contains(lower(text), 'versus') OR contains(lower(text), ' vs ') THEN 'comparative'
 WHEN contains(lower(text), 'how to') OR contains(lower(text), 'steps') OR contains(lower(text), 'procedure') THEN 'procedural' WHEN contains(lower(text), 'explain') OR contains(lower(text), 'why') OR contains(lower(text), 'what is') THEN 'explanatory'
 WHEN contains(lower(text), 'what is the') OR contains(lower(text), 'when') OR contains(lower(text), 'who') OR contains(lower(text), 'how many') THEN 'factual' ELSE 'general' END AS intent FROM conversations""")  # fmt: skip
def _intents(spark, d):
    return b.raw(spark, d, "conversations").select("conv_id", "turn", router.intent(F.col("text")).alias("intent"))


@query("txt16_select_collections", """WITH q AS (SELECT item_id, list_distinct(list_filter(['en', 'fr', 'de', 'es'], lambda x: contains(text, x))) AS k FROM benchmark),
 kb AS (SELECT * FROM (VALUES ('a', ['en']), ('b', ['en', 'de']), ('c', ['es', 'fr']), ('z', ['xx'])) t(kb_id, k)),
 r AS (SELECT item_id, kb_id, CASE WHEN len(q.k) = 0 THEN 0 ELSE len(list_intersect(q.k, kb.k)) / len(q.k) END * 0.4 AS relevance FROM q, kb),
 w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, kb_id) AS rn, max(relevance) OVER (PARTITION BY item_id) AS top FROM r)
 SELECT item_id AS query_id, kb_id, round(relevance, 6) AS relevance FROM w WHERE rn = 1 OR (rn <= 4 AND relevance >= 0.3 AND top - relevance <= 0.2)""")  # fmt: skip
def _select_kbs(spark, d):
    kbs = spark.createDataFrame([("a", ["en"], []), ("b", ["en", "de"], []), ("c", ["es", "fr"], []), ("z", ["xx"], [])], "kb_id string, categories array<string>, keywords array<string>")
    found = F.filter(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), lambda x: F.contains(F.col("text"), x))
    none = F.array().cast("array<string>")
    q = b.raw(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), found.alias("q_categories"), none.alias("q_keywords"), none.alias("q_entities"))
    return router.select_collections(q, kbs).withColumn("relevance", F.round("relevance", 6))


@query("joi18_similar_results", """WITH c AS (SELECT conv_id, turn, text FROM conversations)
 SELECT x.conv_id AS query_id, x.turn AS a, y.turn AS b, round(CASE WHEN contains(x.text, y.text) OR contains(y.text, x.text) THEN least(length(x.text), length(y.text)) / greatest(length(x.text), length(y.text))
 ELSE len(list_distinct(list_intersect(string_split_regex(lower(x.text), '\\s+'), string_split_regex(lower(y.text), '\\s+')))) / len(list_distinct(list_concat(string_split_regex(lower(x.text), '\\s+'), string_split_regex(lower(y.text), '\\s+')))) END, 6) AS ratio
 FROM c x JOIN c y ON x.conv_id = y.conv_id AND x.turn < y.turn""")  # fmt: skip
def _similar(spark, d):
    chunks = b.raw(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_id"), F.col("text").alias("content"))
    return router.similar_chunks(chunks).withColumn("ratio", F.round("ratio", 6))


@query("vec06_threshold_search", f"SELECT vec_id, round(1 - {_D2} / 2, 5) AS score FROM embeddings WHERE 1 - {_D2} / 2 >= 0.05 ORDER BY {_D2}, vec_id LIMIT 20")
def _threshold(spark, d):
    v = b.raw(spark, d, "embeddings")
    return vectors.search(v, _query_vector(spark, d), 20, 0.05, "cosine").select("vec_id", F.round("score", 5).alias("score"))


@query("vec04_remove_compact", "SELECT vec_id, label, len(embedding) AS dim FROM embeddings WHERE vec_id % 3 <> 0")
def _compact(spark, d):
    v = b.raw(spark, d, "embeddings")
    gone = v.filter("vec_id % 3 = 0").select("vec_id")
    return merge.delete_rows(v, gone, ["vec_id"]).select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@query("vec10_citations", "SELECT source_site, min(id) AS id, arg_min(title, id) AS title FROM files GROUP BY source_site")
def _citations(spark, d):
    return merge.earliest(b.files(spark, d).select("source_site", "id", "title"), ["source_site"], "id")


# --- more reads, writes and state -------------------------------------------------------


@query("src01_iter_files", "SELECT id, url FROM files f LEFT JOIN catalog c ON f.url = c.file_url WHERE trim(local_path) <> '' AND (contains(lower(source_site), 'src1') OR contains(lower(url), 'src1')) AND (c.file_url IS NULL OR file_sha256 <> sha256) ORDER BY id LIMIT 50")
def _iter_files(spark, d):
    j = listing.with_catalog(b.files(spark, d), b.catalog(spark, d))
    return j.filter(~tx.blank("local_path") & tx.contains_any("src1", "source_site", "url") & (F.col("file_url").isNull() | (F.col("file_sha256") != F.col("sha256")))).orderBy("id").limit(50).select("id", "url")


@query("snk03_export_catalog", "SELECT file_url, category, CASE WHEN starts_with(keywords, '[') THEN array_to_string(CAST(keywords::JSON AS VARCHAR[]), ', ') ELSE keywords END AS keywords FROM catalog")
def _export_catalog(spark, d):
    return b.catalog(spark, d).select("file_url", "category", F.array_join(tx.keyword_list("keywords"), ", ").alias("keywords"))


@query("agg01_file_count", "SELECT count(*) AS total FROM files WHERE trim(coalesce(local_path, '')) <> '' AND deleted_at IS NULL")
def _file_count(spark, d):
    return listing.count_files(b.files(spark, d), b.catalog(spark, d))


@query("agg06_chunk_stats", "SELECT profile_id, count(DISTINCT file_url) AS files, count(*) AS sets, CAST(sum(chunk_count) AS BIGINT) AS chunks, count(DISTINCT CASE WHEN status = 'ready' THEN file_url END) AS ready_files FROM chunk_sets GROUP BY profile_id")
def _chunk_stats(spark, d):
    return b.chunk_sets(spark, d).groupBy("profile_id").agg(F.countDistinct("file_url").alias("files"), F.count("*").alias("sets"), F.sum("chunk_count").alias("chunks"), F.countDistinct(F.when(F.col("status") == "ready", F.col("file_url"))).alias("ready_files"))


@query("agg08_source_status", "SELECT k.kb_id, greatest(max(indexed_at), max(markdown_updated_at)) AS newest FROM kb_files k LEFT JOIN catalog c ON c.file_url = k.file_url GROUP BY k.kb_id")
def _source_status(spark, d):
    j = b.kb_files(spark, d).join(b.catalog(spark, d).select("file_url", "markdown_updated_at"), "file_url", "left")
    return j.groupBy("kb_id").agg(F.greatest(F.max("indexed_at"), F.max("markdown_updated_at")).alias("newest"))


@query("agg19_word_pairs", "WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM conversations), p AS (SELECT ws[i] || ' ' || ws[i + 1] AS pair FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM w)) SELECT pair, count(*) AS n FROM p GROUP BY pair")
def _word_pairs(spark, d):
    ws = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    rows = b.raw(spark, d, "conversations").select(ws.alias("ws")).filter(F.size("ws") > 1)
    pairs = F.zip_with(F.slice("ws", 1, F.size("ws") - 1), F.slice("ws", 2, F.size("ws") - 1), lambda x, y: F.concat_ws(" ", x, y))
    return rows.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


@query("dml03_upsert_catalog", "SELECT coalesce(o.file_url, n.file_url) AS file_url, CASE WHEN n.file_url IS NOT NULL THEN 'ok' ELSE o.status END AS status, o.summary FROM (SELECT * FROM catalog WHERE cid % 4 <> 0) o FULL OUTER JOIN (SELECT * FROM catalog WHERE cid % 6 = 0 OR cid % 4 = 0) n ON o.file_url = n.file_url")
def _upsert_catalog(spark, d):
    c = b.catalog(spark, d).select("cid", "file_url", "status", "summary")
    new = c.filter("cid % 6 = 0 OR cid % 4 = 0").select("file_url", F.lit("ok").alias("status"))
    return merge.upsert(c.filter("cid % 4 <> 0").drop("cid"), new, ["file_url"])


@query("dml07_partial_update", "SELECT id, CASE WHEN content_type = 'text/plain' THEN 'plain: ' || title ELSE title END AS title FROM files")
def _partial(spark, d):
    return merge.set_where(b.files(spark, d), F.col("content_type") == "text/plain", title=F.concat(F.lit("plain: "), "title")).select("id", "title")


@query("dml10_replace_chunks", "SELECT chunk_set_id, chunk_count FROM chunk_sets WHERE NOT chunk_set_id LIKE '%-2' UNION ALL SELECT chunk_set_id, chunk_count * 10 FROM chunk_sets WHERE chunk_set_id LIKE '%-2'")
def _replace_chunks(spark, d):
    sets = b.chunk_sets(spark, d).select("chunk_set_id", "chunk_count")
    new = sets.filter(F.col("chunk_set_id").endswith("-2")).withColumn("chunk_count", F.col("chunk_count") * 10)
    return merge.delete_rows(sets, new.select("chunk_set_id"), ["chunk_set_id"]).unionByName(new)


@query("dml15_set06_membership", "SELECT kb_id, count(*) AS n FROM (SELECT kb_id, file_url FROM kb_files WHERE fid % 2 = 0 UNION SELECT lang, url FROM files WHERE id % 3 = 0 OR id % 2 = 1) GROUP BY kb_id")
def _membership(spark, d):
    old = b.kb_files(spark, d).filter("fid % 2 = 0").select("kb_id", "file_url")
    new = b.files(spark, d).filter("id % 3 = 0 OR id % 2 = 1").select(F.col("lang").alias("kb_id"), F.col("url").alias("file_url"))
    return merge.insert_new(old, new, ["kb_id", "file_url"]).groupBy("kb_id").agg(F.count("*").alias("n"))


@query("prj10_conversations", "SELECT conv_id, count(*) AS n, arg_min(text, turn) FILTER (role = 'user') AS title FROM conversations GROUP BY conv_id")
def _conversations(spark, d):
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return b.messages(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"), first.alias("title"))


@query("srt08_oldest_messages", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 2")
def _oldest(spark, d):
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return b.messages(spark, d).withColumn("rn", rn).filter("rn <= 2").select("conv_id", "turn")


@query("set05_ordered_dedupe", "SELECT host, min(page_id) AS page_id FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages) GROUP BY host")
def _ordered(spark, d):
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    rows = b.raw(spark, d, "pages").select("page_id", host.alias("host"))
    return merge.earliest(rows, ["host"], "page_id").select("host", "page_id")


@query("stm05_freshness", "SELECT k.kb_id, k.file_url, CASE WHEN k.indexed_at IS NULL THEN 'pending_evaluation' WHEN c.markdown_updated_at > k.indexed_at AND c.status = 'error' THEN 'legacy_hard_gate' WHEN c.markdown_updated_at > k.indexed_at THEN 'stale' ELSE 'fresh' END AS freshness FROM kb_files k LEFT JOIN catalog c ON c.file_url = k.file_url")
def _freshness(spark, d):
    j = b.kb_files(spark, d).join(b.catalog(spark, d).select("file_url", "markdown_updated_at", "status"), "file_url", "left")
    newer = F.col("markdown_updated_at") > F.col("indexed_at")
    state = F.when(F.col("indexed_at").isNull(), "pending_evaluation").when(newer & (F.col("status") == "error"), "legacy_hard_gate").when(newer, "stale").otherwise("fresh")
    return j.select("kb_id", "file_url", state.alias("freshness"))


@query("stm11_first_arrivals", "SELECT sha256, arg_min(id, id) AS id FROM files GROUP BY sha256")
def _arrivals(spark, d):
    return streams.first_arrivals(b.files(spark, d).select("sha256", "id"), "sha256", "id")


# --- joins and groups over the sales tables ---------------------------------------------


@query("sales_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")  # fmt: skip
def _pricing(spark, d):
    rows = b.raw(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("sales_region_orders", "SELECT r_name, count(*) AS n, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _region(spark, d):
    geo = b.raw(spark, d, "nation").join(b.raw(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = b.raw(spark, d, "orders").join(b.raw(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("r_name").agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("customers"))


# --- status, scoring and projection helpers ---------------------------------------------


@query("fil11_recent_scope", "SELECT url FROM files WHERE last_seen >= TIMESTAMP '2024-01-10' AND (source_site = 'src2' OR source_site = 'src3')")
def _recent_scope(spark, d):
    return b.files(spark, d).filter((F.col("last_seen") >= F.lit("2024-01-10").cast("timestamp")) & F.col("source_site").isin("src2", "src3")).select("url").distinct()


@query("fil18_member_chunks", "SELECT count(*) FILTER (member) AS kept, count(*) FILTER (NOT member) AS removed FROM (SELECT EXISTS (SELECT 1 FROM bindings x WHERE x.file_url = s.file_url AND x.kb_id = 'en') AS member FROM chunk_sets s)")
def _member_chunks(spark, d):
    en = b.bindings(spark, d).filter("kb_id = 'en'").select("file_url", F.lit(1).alias("member")).distinct()
    return b.chunk_sets(spark, d).join(en, "file_url", "left").agg(F.count("member").alias("kept"), F.count(F.when(F.col("member").isNull(), 1)).alias("removed"))


@query("fil20_index_candidates", "SELECT kb_id, count(*) FILTER (md) AS selected, count(*) FILTER (NOT md) AS skipped FROM (SELECT k.kb_id, trim(coalesce(markdown_content, '')) <> '' AS md FROM kb_files k LEFT JOIN catalog c ON c.file_url = k.file_url WHERE indexed_at IS NULL) GROUP BY kb_id")
def _index_candidates(spark, d):
    j = b.kb_files(spark, d).filter("indexed_at IS NULL").join(b.catalog(spark, d).select("file_url", (~tx.blank("markdown_content")).alias("md")), "file_url", "left")
    md = F.coalesce("md", F.lit(False))
    return j.groupBy("kb_id").agg(F.count(F.when(md, 1)).alias("selected"), F.count(F.when(~md, 1)).alias("skipped"))


@query("fil21_kb_availability", "SELECT kb_id, CASE WHEN count(indexed_at) = 0 THEN 'building' WHEN count(*) > count(indexed_at) THEN 'needs_reindex' ELSE 'ready' END AS availability FROM kb_files GROUP BY kb_id")
def _availability(spark, d):
    state = F.when(F.col("indexed") == 0, "building").when(F.col("pending") > 0, "needs_reindex").otherwise("ready")
    return stats.kb_stats(b.kb_files(spark, d)).select("kb_id", state.alias("availability"))


@query("fil23_error_classes", "SELECT page_id, CASE WHEN regexp_matches(lower(url), 'spam|pills') THEN 'blocked' WHEN regexp_matches(lower(url), 'utm_|ref=') THEN 'tracked' ELSE 'plain' END AS class FROM pages")
def _error_classes(spark, d):
    u = F.lower("url")
    return b.raw(spark, d, "pages").select("page_id", F.when(u.rlike("spam|pills"), "blocked").when(u.rlike("utm_|ref="), "tracked").otherwise("plain").alias("class"))


@query("prj03_kb_search", "SELECT kb_id, score FROM (SELECT DISTINCT kb_id, CASE WHEN contains(kb_id, 'e') THEN 10 ELSE 0 END + CASE WHEN contains('files in ' || kb_id, 's') THEN 5 ELSE 0 END AS score FROM kb_files) WHERE score > 5")
def _kb_search(spark, d):
    kb = b.kb_files(spark, d).select("kb_id").distinct()
    score = F.when(F.col("kb_id").contains("e"), 10).otherwise(0) + F.when(F.concat(F.lit("files in "), "kb_id").contains("s"), 5).otherwise(0)
    return kb.select("kb_id", score.alias("score")).filter("score > 5")


@query("prj04_user_activity", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, max(ts) AS last_at FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def _activity(spark, d):
    e = b.raw(spark, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.max("ts").alias("last_at")).orderBy(F.desc("n"), "user_id").limit(20)


@query("prj12_file_preview", "SELECT s.chunk_set_id, s.chunk_count, (SELECT count(*) FROM bindings x WHERE x.chunk_set_id = s.chunk_set_id) AS bound FROM chunk_sets s WHERE s.file_url = 'doc://8'")
def _preview(spark, d):
    sets = b.chunk_sets(spark, d).filter("file_url = 'doc://8'")
    n = b.bindings(spark, d).groupBy("chunk_set_id").agg(F.count("*").alias("n"))
    return sets.join(n, "chunk_set_id", "left").select("chunk_set_id", "chunk_count", F.coalesce("n", F.lit(0)).alias("bound"))


@query("joi10_latest_index_status", "SELECT DISTINCT file_url, first_value(chunk_set_id) OVER w AS chunk_set_id, first_value(status) OVER w AS status, first_value(chunk_count) OVER w AS chunk_count FROM chunk_sets WINDOW w AS (PARTITION BY file_url ORDER BY updated_at DESC, chunk_set_id DESC)")
def _index_status(spark, d):
    return merge.latest(b.chunk_sets(spark, d), ["file_url"], "updated_at", "chunk_set_id").select("file_url", "chunk_set_id", "status", "chunk_count")


@query("joi16_trace_relations", """WITH e AS (SELECT 'in_source' AS relation_type, CAST(doc_id AS VARCHAR) AS doc_id, source AS target_id FROM documents UNION ALL SELECT 'in_lang', CAST(doc_id AS VARCHAR), lang FROM documents),
 f AS (SELECT *, 7.0 AS score FROM e WHERE contains(lower(relation_type || ' ' || doc_id || ' ' || target_id), 'src19') ORDER BY doc_id, relation_type, target_id LIMIT 20)
 SELECT relation_type, target_id, doc_id, CAST(score AS DOUBLE) AS score FROM f UNION ALL
 SELECT relation_type, target_id, min(doc_id), 0.5 FROM e WHERE doc_id IN (SELECT doc_id FROM f) AND NOT EXISTS (SELECT 1 FROM f WHERE f.relation_type = e.relation_type AND f.target_id = e.target_id) GROUP BY relation_type, target_id""")  # fmt: skip
def _relations(spark, d):
    docs = b.raw(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "lang")
    edges = docs.select(F.lit("in_source").alias("relation_type"), "doc_id", F.col("source").alias("target_id")).union(docs.select(F.lit("in_lang"), "doc_id", "lang"))
    return evidence.trace_relations(edges, "src19")


@query("joi20_file_kbs", "SELECT f.id, k.kb_id, k.indexed_at FROM files f LEFT JOIN kb_files k ON k.file_url = f.url")
def _file_kbs(spark, d):
    f = b.files(spark, d)
    return f.join(b.kb_files(spark, d), f["url"] == F.col("file_url"), "left").select("id", "kb_id", "indexed_at")


@query("joi22_bind_latest", "SELECT c.file_url, arg_max(chunk_set_id, updated_at) AS chunk_set_id FROM catalog c JOIN chunk_sets s ON s.file_url = c.file_url AND s.status = 'ready' WHERE category = 'Pricing' GROUP BY c.file_url")
def _bind_latest(spark, d):
    wanted = b.catalog(spark, d).filter("category = 'Pricing'").select("file_url")
    return merge.latest_ready_sets(b.chunk_sets(spark, d)).join(wanted, "file_url", "left_semi").select("file_url", "chunk_set_id")


@query("agg17_agentic_rollup", "SELECT round(coalesce(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 1), 6) AS evidence_hit_rate, round(coalesce(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 0), 6) AS unsupported_rate FROM labels")
def _agentic_rollup(spark, d):
    rate = lambda c, none: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(none)), 6)
    return b.raw(spark, d, "labels").agg(rate(F.col("quality") == 1, 1.0).alias("evidence_hit_rate"), rate(F.col("toxic") == 1, 0.0).alias("unsupported_rate"))


@query("agg18_vector_stats", "SELECT label, count(*) AS n, min(len(embedding)) AS dim FROM embeddings GROUP BY label")
def _vector_stats(spark, d):
    return b.raw(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("dim"))


@query("agg22_task_estimate", "SELECT kb_id, count(*) * 15 AS seconds, min(indexed_at) AS oldest FROM kb_files WHERE indexed_at IS NOT NULL GROUP BY kb_id")
def _estimate(spark, d):
    return b.kb_files(spark, d).filter("indexed_at IS NOT NULL").groupBy("kb_id").agg((F.count("*") * 15).alias("seconds"), F.min("indexed_at").alias("oldest"))


@query("srt05_nulls_last", "SELECT fid FROM kb_files ORDER BY indexed_at IS NULL, indexed_at DESC, fid LIMIT 700")
def _nulls_last(spark, d):
    return b.kb_files(spark, d).orderBy(F.desc_nulls_last("indexed_at"), "fid").limit(700).select("fid")


@query("srt07_distinct_by_hidden_key", "SELECT url FROM (SELECT DISTINCT url, last_seen FROM files) ORDER BY last_seen DESC, url LIMIT 30")
def _hidden_key(spark, d):
    return b.files(spark, d).select("url", "last_seen").dropDuplicates(["url"]).orderBy(F.desc("last_seen"), "url").limit(30).select("url")


@query("set04_hit_overlap", "SELECT item_id, len(list_intersect(string_split(lower(text), ' '), ['the', 'of', 'de', 'la'])) AS hits FROM benchmark")
def _overlap(spark, d):
    words = F.split(F.lower("text"), " ")
    return b.raw(spark, d, "benchmark").select("item_id", F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ("the", "of", "de", "la")]))).cast("long").alias("hits"))


@query("set08_profiles_union", "SELECT kb_id, binding_mode AS profile FROM bindings UNION SELECT kb_id, 'general' FROM kb_files")
def _profiles(spark, d):
    return b.bindings(spark, d).select("kb_id", F.col("binding_mode").alias("profile")).union(b.kb_files(spark, d).select("kb_id", F.lit("general"))).distinct()


@query("str17_content_hash", "SELECT page_id, sha256(html) AS sha FROM pages")
def _hash(spark, d):
    return b.raw(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha"))


@query("str23_generated_titles", "SELECT conv_id, turn, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS title FROM conversations WHERE role = 'user'")
def _generated(spark, d):
    t = F.when(F.length("text") > 50, F.concat(F.substring("text", 1, 50), F.lit("..."))).otherwise(F.col("text"))
    return b.raw(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", t.alias("title"))


@query("dat05_retention", "SELECT id FROM files WHERE last_seen < TIMESTAMP '2024-02-01' - INTERVAL 20 DAY")
def _retention(spark, d):
    return b.files(spark, d).filter(F.col("last_seen") < F.lit("2024-02-01").cast("timestamp") - F.expr("INTERVAL 20 DAYS")).select("id")


@query("arr02_category_labels", "SELECT cid, list_sort(list_distinct(list_transform(string_split(category, ';'), lambda x: lower(trim(x))))) AS labels FROM catalog")
def _labels(spark, d):
    labels = F.array_sort(F.array_distinct(F.transform(F.split("category", ";"), lambda x: F.lower(F.trim(x)))))
    return b.catalog(spark, d).select("cid", labels.alias("labels"))


@query("txt13_fixed_windows", "SELECT doc_id, i AS start, substring(text, CAST(i + 1 AS BIGINT), 2000) AS part FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1800)) AS i FROM documents)")
def _fixed(spark, d):
    docs = b.raw(spark, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(1800))).alias("start"))
    return docs.select("doc_id", F.col("start").cast("long").alias("start"), F.substr("text", F.col("start") + 1, F.lit(2000)).alias("part"))


@query("vec08_diversity", f"WITH s AS (SELECT vec_id, label, 1 - {_D2} / 2 AS score FROM embeddings ORDER BY {_D2}, vec_id LIMIT 50) SELECT vec_id, round(least(1.0, score + 0.3 / (1 + count(*) OVER (PARTITION BY label))), 5) AS adjusted FROM s")
def _diversity(spark, d):
    near = vectors.search(b.raw(spark, d, "embeddings"), _query_vector(spark, d), 50, metric="cosine")
    return near.select("vec_id", F.round(F.least(F.lit(1.0), F.col("score") + 0.3 / (1 + F.count("*").over(Window.partitionBy("label")))), 5).alias("adjusted"))


@query("srh03_search_sections", f"SELECT section_id, CAST(score AS DOUBLE) AS score FROM (SELECT conv_id || '#' || turn AS section_id, {_score_sql({'text': 1.0}, ['que', 'ing'])} AS score FROM conversations) WHERE score > 0 ORDER BY score DESC, section_id LIMIT 10")
def _section_search(spark, d):
    secs = b.raw(spark, d, "conversations").select(F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("section_id"), "text")
    found = evidence.search(secs, "sections", "que, ing", 10, "section_id")
    return found.select("section_id", "score")


@query("srh10_merged_evidence", "SELECT 'doc_id:' || user_id AS key, min(event_id) AS first_step, CAST(max(value) AS DOUBLE) AS score, list(event_type ORDER BY e) AS tools FROM (SELECT user_id, event_type, min(event_id) AS event_id, min(event_id) AS e, max(value) AS value FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def _merged(spark, d):
    steps = b.raw(spark, d, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("tool"), F.col("event_id").alias("step_no"), F.col("value").alias("score"))
    return evidence.merge_evidence(steps)


@query("dml04_last_seen", "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, max(page_id) AS last_page FROM pages GROUP BY 1")
def _last_seen(spark, d):
    return b.raw(spark, d, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(F.max("page_id").alias("last_page"))


@query("dml11_validated_bindings", "SELECT x.chunk_set_id FROM bindings x WHERE EXISTS (SELECT 1 FROM chunk_sets s WHERE s.chunk_set_id = x.chunk_set_id AND s.file_url = x.file_url AND s.status = 'ready')")
def _validated(spark, d):
    ready = b.chunk_sets(spark, d).filter("status = 'ready'").select("chunk_set_id", "file_url")
    return b.bindings(spark, d).join(ready, ["chunk_set_id", "file_url"], "left_semi").select("chunk_set_id")
