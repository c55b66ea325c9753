"""Queries over the rules of listing, searching, collecting and limiting."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import cleaning, serving, textpipe
from docloom.plans import bindings as b
from docloom.plans.registry import _score_sql, query
from docloom.sources import crawl, readers
from docloom.streaming import streams

# --- lists --------------------------------------------------------------------------------


@query("prj01_file_rows", "SELECT url, title, original_filename, source_site, content_type, last_seen, CAST(NULL AS VARCHAR) AS etag FROM files")
def _file_rows(spark, d):
    return serving.projected(b.files(spark, d), serving.RECENT_FIELDS, ("etag",))


@query("joi02_available_documents", """SELECT f.url AS file_url, original_filename AS filename, CASE WHEN title <> '' THEN title ELSE original_filename END AS title, category, CASE WHEN f.id % 7 = 0 THEN ['a', 'b'] ELSE [lang, source_site] END AS keywords FROM files f JOIN catalog c ON c.file_url = f.url
 WHERE deleted_at IS NULL AND coalesce(markdown_content, '') <> '' AND (category = 'Pricing' OR category ILIKE '%; Pricing' OR category ILIKE 'Pricing;%' OR trim(coalesce(category, '')) = '') AND (contains(lower(title), 'en') OR contains(lower(original_filename), 'en') OR contains(lower(keywords), 'en') OR contains(lower(title), '7') OR contains(lower(original_filename), '7') OR contains(lower(keywords), '7'))
 ORDER BY f.title NULLS FIRST, original_filename, f.url LIMIT 300""")  # fmt: skip
def _available(spark, d):
    return serving.available_documents(b.files(spark, d), b.catalog(spark, d), ("Pricing", "__uncategorized__"), " EN , 7", 300)


# --- collections --------------------------------------------------------------------------

_KBS = "SELECT source_site AS kb_id, 'Files of ' || source_site AS name, 'In ' || min(lang) || ' and ' || max(lang) AS description, CASE CAST(min(id) % 3 AS INT) WHEN 0 THEN 'category' WHEN 1 THEN 'hybrid' ELSE 'manual' END AS kb_mode, min(first_seen) AS created_at FROM files GROUP BY source_site"


def _kbs(spark, d):
    i = F.min("id") % 3
    mode = F.when(i == 0, "category").when(i == 1, "hybrid").otherwise("manual")
    own = b.files(spark, d).groupBy("source_site").agg(F.concat(F.lit("In "), F.min("lang"), F.lit(" and "), F.max("lang")).alias("description"), mode.alias("kb_mode"), F.min("first_seen").alias("created_at"))
    return own.select(F.col("source_site").alias("kb_id"), F.concat(F.lit("Files of "), "source_site").alias("name"), "description", "kb_mode", "created_at")


@query("prj03_search_collections", f"SELECT * FROM (SELECT kb_id, name, description, created_at, CASE WHEN contains(lower(name), 'fr') THEN 10 ELSE 0 END + CASE WHEN contains(lower(description), 'fr') THEN 5 ELSE 0 END AS score FROM ({_KBS}) WHERE kb_mode IN ('category', 'hybrid')) WHERE score > 0 ORDER BY score DESC, kb_id LIMIT 100")
def _search_kbs(spark, d):
    return serving.search_collections(_kbs(spark, d), "FR", limit=500)


@query("fil22_manifest_states", """WITH m AS (SELECT kb_id, count(DISTINCT file_url) AS n, max(indexed_at) AS latest FROM kb_files GROUP BY kb_id),
 s AS (SELECT source_site AS kb_id, count(*) AS n, max(last_seen) AS latest, CAST(min(id) % 6 AS INT) AS k FROM files GROUP BY source_site)
 SELECT kb_id, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'ready' WHEN 2 THEN 'stale' WHEN 3 THEN 'stale' WHEN 4 THEN 'failed' ELSE 'missing' END AS status, k = 1 AS usable, n AS current_doc_count,
 CASE k WHEN 0 THEN 'ready_data manifest has not been built' WHEN 2 THEN 'KB source files changed after the ready_data manifest was built' WHEN 3 THEN 'KB document count differs from the ready_data manifest' WHEN 4 THEN 'disk full' WHEN 5 THEN 'ready_data is unavailable' END AS stale_reason FROM s""")  # fmt: skip
def _states(spark, d):
    f = b.files(spark, d)
    own = f.groupBy(F.col("source_site").alias("kb_id")).agg(F.count("*").alias("n"), F.max("last_seen").alias("latest"), (F.min("id") % 6).alias("k"))
    k = F.col("k")
    status = F.when(k == 4, " FAILED ").when(k == 5, "").otherwise("Ready")
    built = F.when(k == 2, F.col("latest") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("latest"))
    manifests = own.filter("k <> 0").select("kb_id", status.alias("status"), built.alias("built_at"), F.when(k == 3, F.col("n") + 1).otherwise(F.col("n")).alias("doc_count"), F.when(k == 4, " disk full ").alias("error_message"))
    members = f.select(F.col("source_site").alias("kb_id"), F.col("url").alias("file_url"), F.col("last_seen").alias("changed_at"))
    return serving.manifest_status(own, manifests, members)


@query("txt16_query_collections", """WITH kb(kb_id, shown, cats) AS (VALUES ('a', 'alpha' || chr(10) || 'the first of all', ['x']), ('b', 'beta de la' || chr(10) || 'und', ['x', 'y']), ('c', 'gamma' || chr(10) || 'ing and ed', CAST([] AS VARCHAR[])), ('d', 'delta' || chr(10) || 'the ing de', ['z']), ('e', 'epsilon', ['q'])),
 q AS (SELECT conv_id * 100 + turn AS query_id, CASE turn % 3 WHEN 0 THEN ['x', 'z'] WHEN 1 THEN ['y'] ELSE CAST([] AS VARCHAR[]) END AS c, string_split(lower(regexp_extract(text, '^(\\S+ \\S+ \\S+)', 1)), ' ') AS w, CASE WHEN turn % 2 = 0 THEN ['Delta'] ELSE CAST([] AS VARCHAR[]) END AS e FROM conversations),
 r AS (SELECT query_id, kb_id, round(least(1.0, CASE WHEN len(c) > 0 THEN 0.4 * len(list_intersect(c, cats)) / len(c) ELSE 0 END + 0.4 * len(list_filter(w, lambda x: contains(shown, x))) / len(w) + CASE WHEN len(e) > 0 THEN 0.2 * len(list_filter(e, lambda x: contains(shown, lower(x)))) / len(e) ELSE 0 END), 9) AS relevance FROM q, kb),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, kb_id) AS rank, max(relevance) OVER (PARTITION BY query_id) AS best FROM r)
 SELECT query_id, kb_id, round(relevance, 6) AS relevance, CAST(rank AS INT) AS rank FROM o WHERE rank = 1 OR relevance >= 0.3 OR (rank <= 4 AND round(best - relevance, 9) <= 0.2)""")  # fmt: skip
def _query_kbs(spark, d):
    kbs = spark.createDataFrame([("a", "Alpha", "the first of all", ["x"]), ("b", "Beta de la", "und", ["x", "y"]), ("c", "Gamma", "ing and ed", None), ("d", "Delta", "the ing de", ["z"]), ("e", "Epsilon", None, ["q"])], "kb_id string, name string, description string, categories array<string>")
    c, none, t = b.raw(spark, d, "conversations"), F.array().cast("array<string>"), F.col("turn")
    words = F.split(F.lower(F.regexp_extract("text", r"^(\S+ \S+ \S+)", 1)), " ")
    q = c.select((F.col("conv_id") * 100 + t).alias("query_id"), F.when(t % 3 == 0, F.array(F.lit("x"), F.lit("z"))).when(t % 3 == 1, F.array(F.lit("y"))).otherwise(none).alias("q_categories"), words.alias("q_keywords"), F.when(t % 2 == 0, F.array(F.lit("Delta"))).otherwise(none).alias("q_entities"))
    return serving.select_for_queries(q, kbs).withColumn("relevance", F.round("relevance", 6))


_HITS = _score_sql({"summary": 4.0}, ["que", "src1", "ing"])


@query("srh01_summaries_with_sections", f"""WITH c AS (SELECT cid, file_url, category, ['Part ' || cid, status] AS headings FROM catalog), s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE title END AS title, CASE WHEN doc_id % 4 = 0 THEN 'About ' || lang ELSE 'Ing of ' || source_site || ' que src1' END AS summary, file_url FROM markdown WHERE doc_id % 5 <> 1),
 j AS (SELECT coalesce(c.cid, s.doc_id) AS doc_id, coalesce(nullif(s.title, ''), f.title, '') AS title, coalesce(nullif(s.file_url, ''), c.file_url, '') AS file_url, coalesce(nullif(s.summary, ''), '') AS summary, coalesce(c.category, '') AS category, coalesce(array_to_string(c.headings, ' '), '') AS headings, c.cid IS NOT NULL AS in_c, s.doc_id IS NOT NULL AS in_s
  FROM c JOIN files f ON f.id = c.cid FULL OUTER JOIN s ON s.doc_id = c.cid),
 t AS (SELECT doc_id, max(contains(lower(text), 'que')) AS a, max(contains(lower(text), 'src1')) AS b, max(contains(lower(text), 'ing')) AS c FROM md_sections GROUP BY doc_id),
 p AS (SELECT j.*, {_HITS} AS ps, {_score_sql({'title': 2.0}, ['que', 'src1', 'ing'])} AS pt, {_score_sql({'category': 1.0}, ['que', 'src1', 'ing'])} AS pc, {_score_sql({'headings': 1.0}, ['que', 'src1', 'ing'])} AS ph, 0.75 * (CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 1 ELSE 0 END + CASE WHEN t.c THEN 1 ELSE 0 END) AS px FROM j LEFT JOIN t ON t.doc_id = j.doc_id)
 SELECT doc_id, title, file_url, CAST(ps + pt + pc + ph + px + CASE WHEN contains(lower(summary), 'que src1 ing') THEN 3 ELSE 0 END AS DOUBLE) AS score, CASE WHEN in_s AND (ps > 0 OR NOT in_c) THEN 'doc_summaries' WHEN ps + pt + pc + ph > 0 THEN 'doc_catalog' ELSE 'sections' END AS source FROM p WHERE ps + pt + pc + ph + px > 0 ORDER BY score DESC, lower(title), file_url LIMIT 100""")  # fmt: skip
def _summaries(spark, d):
    from docloom.operators import ready

    md = b.markdown(spark, d)
    c = b.catalog(spark, d).join(b.files(spark, d).select(F.col("id").alias("cid"), "title"), "cid")
    cat = c.select(F.col("cid").alias("doc_id"), "file_url", "title", "category", F.lit("").alias("summary"), F.array(F.concat(F.lit("Part "), F.col("cid").cast("string")), "status").alias("headings"))
    i = F.col("doc_id")
    sums = md.filter("doc_id % 5 <> 1").select("doc_id", "file_url", F.when(i % 3 == 0, "").otherwise(F.col("title")).alias("title"), F.lit("").alias("category"), F.when(i % 4 == 0, F.concat(F.lit("About "), "lang")).otherwise(F.concat(F.lit("Ing of "), "source_site", F.lit(" que src1"))).alias("summary"))
    return serving.search_summaries(cat, sums, ready.sections(md).select("doc_id", "text"), "que src1 ing", 500)


# --- collecting ---------------------------------------------------------------------------


@query("fil14_kept_files", """SELECT id, size > 0 AND size <= 524288000 AND ends_with(lower(name), '.pdf') OR size > 0 AND size <= 524288000 AND ends_with(name, '.txt') AS keep, CASE WHEN size IS NULL THEN 'File not found' WHEN size = 0 THEN 'Empty file' WHEN size > 524288000 THEN 'File too large (' || printf('%.1f', size / 1048576) || ' MB > 500 MB)' WHEN ends_with(name, '.html') THEN 'Unsupported file type: .html'
 WHEN contains(lower(coalesce(title, '') || ' ' || name), 'en') OR contains(lower(coalesce(title, '') || ' ' || name), 'f7') THEN 'AI-related (by metadata)' ELSE 'Accepted (full content check not implemented)' END AS reason
 FROM (SELECT id, title, CASE WHEN id % 2 = 0 THEN replace(original_filename, '.pdf', '.PDF') ELSE original_filename END AS name, CASE id % 7 WHEN 0 THEN 0 WHEN 1 THEN 600000000 + id * 1000003 ELSE bytes END AS size FROM files)""")  # fmt: skip
def _kept(spark, d):
    i = F.col("id")
    f = b.files(spark, d).withColumn("size", F.when(i % 7 == 0, 0).when(i % 7 == 1, 600000000 + i * 1000003).otherwise(F.col("bytes")))
    path = F.concat(F.lit("/data.d/"), F.when(i % 2 == 0, F.replace("original_filename", F.lit(".pdf"), F.lit(".PDF"))).otherwise(F.col("original_filename")))
    return f.select("id", serving.keepable(path, F.col("size"), True, ("EN", "f7"), F.col("title")).alias("x")).select("id", "x.*")


_ERRORS = "CASE event_id % 9 WHEN 0 THEN 'read Timed  out after 403s' WHEN 1 THEN 'HTTP 403: cloudflare' WHEN 2 THEN 'Too Many Requests' WHEN 3 THEN 'Access Denied by Sucuri' WHEN 4 THEN '0 pages visited' WHEN 5 THEN 'code 4031' WHEN 6 THEN 'sucuri timeout' ELSE '' END"


@query("fil23_crawl_outcomes", "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_403' WHEN 2 THEN 'http_429' WHEN 3 THEN 'access_denied' WHEN 4 THEN 'zero_pages_visited' WHEN 5 THEN 'error' WHEN 6 THEN 'sucuri' ELSE CASE WHEN event_id % 4 = 0 THEN 'zero_results' ELSE 'success' END END AS reason, event_id % 9 IN (0, 1, 2, 3, 4, 6) AS blocked FROM events")
def _outcomes(spark, d):
    e = b.raw(spark, d, "events").withColumn("error", F.expr(_ERRORS))
    return e.select("event_id", serving.site_outcome(F.col("error"), F.col("event_id") % 4).alias("x")).select("event_id", "x.*")


@query("fil23_fallback_reasons", """WITH s AS (SELECT id, CAST(id % 6 AS INT) AS k FROM files) SELECT id AS site_id, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'http_403' WHEN 2 THEN 'blocked' WHEN 3 THEN 'failed' WHEN 4 THEN 'zero_results' END AS reason FROM s""")
def _fallback(spark, d):
    f, k = b.files(spark, d), F.col("id") % 6
    sites = f.select(F.col("id").alias("site_id"), F.concat(F.lit(" Site "), F.col("id").cast("string")).alias("name"), F.upper("url").alias("url"))
    row = f.filter("id % 6 <> 0").select(
        F.when(k % 2 == 1, F.concat(F.lit("site "), F.col("id").cast("string"))).otherwise("").alias("name"), "url", (k <= 2).alias("blocked"), (k == 3).alias("failed"), (k != 3).alias("success"),
        F.when(k == 4, 0).otherwise(3).cast("long").alias("items_found"), F.when(k == 1, "http_403").alias("fallback_reason"), F.lit(2).alias("seq"),
    )
    older = row.withColumns({"blocked": F.lit(True), "seq": F.lit(1), "fallback_reason": F.lit("old")})
    return serving.fallback_reasons(sites, older.unionByName(row))


# --- crawls and sitemaps ------------------------------------------------------------------
# Page n names pages 2n + 1 and 2n + 2, a file, and links that lead nowhere or out of the site.


def _site(spark, d):
    n = F.col("page_id")
    a = lambda *x: F.concat(F.lit('<a href="'), *x, F.lit('">t</a>'))
    text = lambda c: c.cast("string")
    html = F.concat(a(F.lit("/p"), text(2 * n + 1)), a(F.lit("mailto:x")), a(F.lit("p"), text(2 * n + 2), F.lit("#top")), a(F.lit("d"), text(n), F.lit(".PDF?x=1")), a(F.lit("http://other.org/p1")), a(F.lit("/skip/p"), text(n)))
    return b.raw(spark, d, "pages").select(F.concat(F.lit("http://site.org/p"), text(n)).alias("url"), html.alias("html"))


_TREE = """WITH RECURSIVE r AS (SELECT CAST(0 AS BIGINT) AS n, 0 AS depth UNION ALL SELECT CAST(c AS BIGINT), depth + 1 FROM (SELECT r.depth, unnest([2 * r.n + 1, 2 * r.n + 2]) AS c FROM r JOIN pages p ON p.page_id = r.n WHERE r.depth < {0}))"""


@query("src16_crawl", f"""{_TREE.format(5)} SELECT 'http://site.org/p' || n AS url, depth, 'page' AS kind FROM r UNION ALL SELECT 'http://site.org/d' || n || '.PDF?x=1', depth + 1, 'file' FROM r JOIN pages p ON p.page_id = r.n WHERE depth < 5""")
def _crawl(spark, d):
    readers_dir(spark)
    return crawl.crawl(_site(spark, d), spark.createDataFrame([("http://site.org/p0",)], "url string"), 5, ("/SKIP/",))


@query("src16_crawl_budget", f"""{_TREE.format(5)}, b AS (SELECT n, depth FROM r ORDER BY depth, n LIMIT 12) SELECT 'http://site.org/p' || n AS url, depth, 'page' AS kind FROM b""")
def _crawl_budget(spark, d):
    readers_dir(spark)
    return crawl.crawl(_site(spark, d), spark.createDataFrame([("http://site.org/p0",)], "url string"), 5, ("/skip/",), (r"/p[0-9]+$",), 12)


def readers_dir(spark) -> None:
    """A checkpoint folder, where the session has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(readers.scratch(spark, "checkpoints"))


@query("src17_sitemap_locations", "SELECT page_id, [trim(url), 'http://x.org/' || page_id] AS urls FROM pages")
def _sitemap(spark, d):
    safe = F.replace("url", F.lit("&"), F.lit("&amp;"))
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), safe, F.lit(" </loc><lastmod>x</lastmod></url><url><loc>http://x.org/"), F.col("page_id").cast("string"), F.lit("</loc></url><url><loc> </loc></url></urlset>"))
    return b.raw(spark, d, "pages").select("page_id", xml.alias("xml")).select("page_id", readers.locations("xml").alias("urls"))


# --- JSON and text ------------------------------------------------------------------------


@query("src04_whole_objects", "SELECT source_site, unnest(list(url ORDER BY url)) AS url, count(*) AS n FROM files GROUP BY source_site")
def _objects(spark, d):
    path = readers.scratch(spark, "objects")
    one = b.files(spark, d).select("source_site", "url").groupBy("source_site").agg(F.array_sort(F.collect_list("url")).alias("files"))
    text = F.concat(F.lit('{\n "source": '), F.to_json(F.struct("source_site")), F.lit(',\n "files": '), F.to_json("files"), F.lit("\n}"))
    one.select("source_site", text.alias("value")).write.partitionBy("source_site").text(path)
    got = spark.read.schema("source struct<source_site:string>, files array<string>").option("multiLine", True).json(f"{path}/*/")
    return got.select("source.source_site", F.explode("files").alias("url"), F.size("files").cast("long").alias("n"))


@query("jsn03_weekly_summaries", """SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN '[]' ELSE '[{"n":' || n_chars || ',"url":"u' || doc_id || '"}]' END AS files, CASE WHEN doc_id % 3 = 0 THEN '{}' ELSE '{"a":1,"lang":"' || lang || '"}' END AS metadata FROM documents""")
def _weekly(spark, d):
    i, text = F.col("doc_id"), lambda c: F.col(c).cast("string")
    files = F.concat(F.lit('[ {"url": "u'), text("doc_id"), F.lit('", "n":'), text("n_chars"), F.lit("}]"))
    meta = F.concat(F.lit('{"lang":"'), "lang", F.lit('","a":1}'))
    rows = b.raw(spark, d, "documents").select(i.alias("id"), F.when(i % 8 == 0, "").when(i % 8 == 4, "[{broken").otherwise(files).alias("files_json"), F.when(i % 3 != 0, meta).alias("metadata_json"))
    return serving.decoded_summary(rows)


@query("str25_all_references", "SELECT doc_id, 'x© é € <b> &lt; & ' || translate(text, '&', '+') || ' ≠∉ &nosuch; ä' AS text FROM documents")
def _references(spark, d):
    text = F.concat(F.lit("x&copy &eacute; &#x20AC; &lt;b&gt; &amp;lt; & "), F.translate("text", "&", "+"), F.lit(" &ne;&notin; &nosuch; &#228;"))
    return b.raw(spark, d, "documents").select("doc_id", cleaning.unescape_all(text).alias("text"))


@query("srt04_stable_sentences", r"""WITH s AS (SELECT doc_id, unnest(p) AS sentence, unnest(range(len(p))) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 20) AS p FROM documents))
 SELECT doc_id, CAST(pos AS INT) AS pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CAST(contains(lower(sentence), 'the') AS INT) + CAST(contains(lower(sentence), 'ing') AS INT) DESC, pos) AS INT) AS rank FROM s""")  # fmt: skip
def _stable(spark, d):
    docs = b.raw(spark, d, "documents").select("doc_id", textpipe.ranked_sentences(F.col("text"), F.array(F.lit("THE"), F.lit("ing"))).alias("r"))
    return docs.select("doc_id", F.posexplode("r").alias("k", "x")).select("doc_id", F.col("x.pos").alias("pos"), (F.col("k") + 1).alias("rank"))


# --- limits -------------------------------------------------------------------------------


@query("stm03_parsed_limits", """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS DOUBLE[]) AS passed, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS allowed FROM e
  UNION ALL SELECT user_id, rn, CASE WHEN ok THEN list_append(passed, t) ELSE passed END, event_id, ok FROM (SELECT e.user_id, e.rn, e.event_id, e.t, r.passed, len(list_filter(r.passed, lambda p: e.t - p < 86400)) < 2 AND len(list_filter(r.passed, lambda p: e.t - p < 3600)) < 1 AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
 SELECT event_id, allowed FROM r WHERE event_id IS NOT NULL""")  # fmt: skip
def _limits(spark, d):
    rules = streams.parse_rules("2 requests per DAY, 1/hour, many per minute, 0 per second, 3 per week")
    return streams.rate_limit(b.raw(spark, d, "events"), rules).select("event_id", "allowed")
