"""Queries for cleaning, files and artifacts, relational chains, merges and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import cleaning, evidence, listing, merge, serving, stats, textpipe, vectors
from docloom.plans import bindings as b
from docloom.plans.registry import _D2, _query_vector, query
from docloom.sources import readers

# --- sources and sinks --------------------------------------------------------------------


@query("src03_snk01_json_lines", "SELECT file_url, category, status, keywords FROM catalog")
def _json_lines(spark, d):
    path = readers.scratch(spark, "catalog-jsonl")
    readers.write_jsonl(b.catalog(spark, d).select("file_url", "category", "status", "keywords"), path)
    return readers.read_jsonl(spark, path, "file_url string, category string, status string, keywords string", strict=True)


@query("src05_snk05_ready_artifacts", "SELECT doc_id, title, 0 AS n_aliases FROM markdown")
def _artifacts(spark, d):
    root = readers.scratch(spark, "artifacts")
    readers.write_jsonl(b.markdown(spark, d).select("doc_id", "title"), readers.confined(root, "doc_catalog.jsonl"))
    got = readers.read_artifacts(spark, root, {"doc_catalog": "doc_id long, title string", "title_aliases": "doc_id long, alias string"})
    n = got["title_aliases"].groupBy("doc_id").agg(F.count("*").alias("n"))
    return got["doc_catalog"].join(n, "doc_id", "left").select("doc_id", "title", F.coalesce("n", F.lit(0)).cast("int").alias("n_aliases"))


@query("src04_json_object", "SELECT 'doc://' || doc_id AS file_url, n_chars AS bytes FROM documents")
def _json_object(spark, d):
    path = readers.scratch(spark, "json-object")
    rows = b.raw(spark, d, "documents").select(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("file_url"), F.col("n_chars").alias("bytes"))
    rows.write.json(path)
    return spark.read.schema("file_url string, bytes long").json(path)


@query("src08_detect_kind", """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' WHEN 3 THEN 'html' WHEN 4 THEN 'html' WHEN 5 THEN 'txt' WHEN 6 THEN 'unknown' ELSE CASE WHEN text = '' THEN 'unknown' ELSE 'txt' END END AS kind FROM documents""")
def _kinds(spark, d):
    i, sign = F.col("doc_id") % 8, lambda h: F.unhex(F.lit(h))
    text = F.encode("text", "UTF-8")
    content = F.when(i == 0, F.concat(F.encode(F.lit("%PDF-1.7 "), "UTF-8"), text)).when(i == 1, F.concat(sign("FFD8FFE0"), text)).when(i == 2, F.concat(sign("89504E470D0A1A0A"), text))
    content = content.when(i == 3, F.encode(F.concat(F.lit(" \n<!DOCTYPE html>"), "text"), "UTF-8")).when(i == 4, F.encode(F.concat(F.lit("<HTML>"), "text"), "UTF-8"))
    content = content.when(i == 5, F.encode(F.concat(F.lit("see <html> %pdf-1 "), "text"), "UTF-8")).when(i == 6, F.unhex(F.repeat(F.lit("00"), 40))).otherwise(text)
    return b.raw(spark, d, "documents").select("doc_id", readers.detect_kind(content).alias("kind"))


@query("src15_format_chain", "SELECT id, CASE id % 3 WHEN 0 THEN ['fast', 'ocr'] WHEN 1 THEN ['html'] ELSE CAST([] AS VARCHAR[]) END AS tools FROM files")
def _chain(spark, d):
    chains = {".pdf": ("fast", "marker", "ocr"), ".html": ("html",), ".docx": ("word",)}
    return b.files(spark, d).select("id", cleaning.format_chain(F.col("original_filename"), chains, ("fast", "ocr", "html")).alias("tools"))


@query("snk02_markdown_report", "SELECT '## ' || coalesce(title, '') || chr(10) || '- URL: ' || url || chr(10) || '- Category: ' || coalesce(category, '') || chr(10) || '- Summary: ' || coalesce(summary, '') AS entry FROM files f JOIN catalog c ON f.url = c.file_url")
def _report(spark, d):
    j = listing.with_catalog(b.files(spark, d), b.catalog(spark, d), "inner")
    line = lambda name, c: F.concat(F.lit(f"\n- {name}: "), F.coalesce(c, F.lit("")))
    return j.select(F.concat(F.lit("## "), F.coalesce("title", F.lit("")), line("URL", "url"), line("Category", "category"), line("Summary", "summary")).alias("entry"))


@query("snk04_export_rows", "SELECT id, url, local_path, content_type FROM files WHERE trim(coalesce(local_path, '')) <> ''")
def _export(spark, d):
    path = readers.scratch(spark, "export")
    b.files(spark, d).filter(~tx.blank("local_path")).select("id", "url", "local_path", "content_type").write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("id long, url string, local_path string, content_type string").csv(path)


# --- filters and lookups ------------------------------------------------------------------

_SEARCH = " OR ".join(f"contains(lower(coalesce({c}, '')), 'src1')" for c in listing.SEARCHED)


@query("fil01_literal_search", f"SELECT id FROM files f LEFT JOIN catalog c ON f.url = c.file_url WHERE trim(coalesce(local_path, '')) <> '' AND ({_SEARCH})")
def _search(spark, d):
    return listing._filtered(b.files(spark, d), b.catalog(spark, d), "SRC1", "", "", True).select("id")


@query("fil02_category_membership", "SELECT cid FROM catalog WHERE category = 'AI' OR category ILIKE 'AI;%' OR category ILIKE '%; AI' OR category ILIKE '%; AI;%'")
def _member(spark, d):
    return b.catalog(spark, d).filter(tx.in_category("category", "AI")).select("cid")


@query("fil04_visible_files", "SELECT id FROM files WHERE trim(coalesce(local_path, '')) <> '' AND deleted_at IS NULL AND contains(lower(source_site), 'src1')")
def _visible(spark, d):
    return listing._visible(b.files(spark, d), "SRC1", False).select("id")


@query("fil06_changed_tolerant", "SELECT id FROM files f LEFT JOIN catalog c ON f.url = c.file_url WHERE c.file_url IS NULL OR coalesce(file_sha256, summary, '') <> coalesce(sha256, '') OR coalesce(catalog_version, 'v1') <> 'v2'")
def _tolerant(spark, d):
    j = listing.with_catalog(b.files(spark, d), b.catalog(spark, d))
    return j.filter(F.col("file_url").isNull() | (F.coalesce("file_sha256", "summary", F.lit("")) != F.coalesce("sha256", F.lit(""))) | (F.coalesce("catalog_version", F.lit("v1")) != "v2")).select("id")


@query("fil08_lookup_in_order", "SELECT pos, 'doc://' || (pos * 7) AS url, f.id FROM (SELECT CAST(i AS BIGINT) AS pos FROM range(0, 400) t(i)) LEFT JOIN files f ON f.url = 'doc://' || (pos * 7)")
def _lookup(spark, d):
    wanted = spark.range(400).select(F.concat(F.lit("doc://"), (F.col("id") * 7).cast("string")).alias("url"), F.col("id").alias("pos"))
    return listing.by_urls(b.files(spark, d), wanted).select("pos", "url", "id")


@query("fil15_categories_in", "SELECT cid, category FROM catalog WHERE category IN ('Pricing', '(internal)')")
def _categories(spark, d):
    return b.catalog(spark, d).filter(F.col("category").isin("Pricing", "(internal)")).select("cid", "category")


@query("fil14_keepable", "SELECT id, bytes >= 500 AND NOT ends_with(lower(original_filename), '.txt') AS keep, regexp_matches(lower(coalesce(title, '')), '(^|[^a-z0-9_])(the|en|la)([^a-z0-9_]|$)') AS whole_word, contains(lower(coalesce(title, '')), 'the') OR contains(lower(coalesce(title, '')), 'en') OR contains(lower(coalesce(title, '')), 'la') AS anywhere FROM files")
def _keepable(spark, d):
    low = F.lower(F.coalesce("title", F.lit("")))
    terms = ("the", "en", "la")
    return b.files(spark, d).select("id", ((F.col("bytes") >= 500) & ~F.lower("original_filename").endswith(".txt")).alias("keep"), (textpipe.category_score(low, terms) > 0).alias("whole_word"), (low.contains("the") | low.contains("en") | low.contains("la")).alias("anywhere"))


@query("fil22_manifest_status", """SELECT k.kb_id, CASE WHEN m.made_at IS NULL THEN 'missing' WHEN newest > m.made_at THEN 'stale' ELSE 'ready' END AS status FROM (SELECT kb_id, max(indexed_at) AS newest FROM kb_files GROUP BY kb_id) k
 LEFT JOIN (SELECT kb_id, min(indexed_at) AS made_at FROM kb_files WHERE kb_id <> 'fr' GROUP BY kb_id UNION ALL SELECT 'none', TIMESTAMP '2024-01-01') m ON m.kb_id = k.kb_id""")  # fmt: skip
def _manifest(spark, d):
    k = b.kb_files(spark, d)
    made = k.filter("kb_id <> 'fr'").groupBy("kb_id").agg(F.min("indexed_at").alias("made_at"))
    j = k.groupBy("kb_id").agg(F.max("indexed_at").alias("newest")).join(made, "kb_id", "left")
    return j.select("kb_id", F.when(F.col("made_at").isNull(), "missing").when(F.col("newest") > F.col("made_at"), "stale").otherwise("ready").alias("status"))


@query("fil23_site_outcomes", """SELECT event_id, CASE WHEN regexp_matches(m, 'timed? ?out') THEN 'timeout' WHEN regexp_matches(m, '40[13]|forbidden') THEN 'forbidden' WHEN regexp_matches(m, '404|not found') THEN 'not_found' WHEN m = '' THEN 'ok' ELSE 'error' END AS outcome
 FROM (SELECT event_id, lower(CASE event_id % 6 WHEN 0 THEN 'Read timed out after 403 s' WHEN 1 THEN 'HTTP 403 Forbidden' WHEN 2 THEN '404 Not Found' WHEN 3 THEN '' WHEN 4 THEN 'TIMEOUT' ELSE event_type END) AS m FROM events)""")  # fmt: skip
def _outcomes(spark, d):
    i = F.col("event_id") % 6
    m = F.lower(F.when(i == 0, "Read timed out after 403 s").when(i == 1, "HTTP 403 Forbidden").when(i == 2, "404 Not Found").when(i == 3, "").when(i == 4, "TIMEOUT").otherwise(F.col("event_type")))
    kind = F.when(m.rlike("timed? ?out"), "timeout").when(m.rlike("40[13]|forbidden"), "forbidden").when(m.rlike("404|not found"), "not_found").when(m == "", "ok").otherwise("error")
    return b.raw(spark, d, "events").select("event_id", kind.alias("outcome"))


@query("fil24_result_verdicts", "SELECT conv_id, CASE WHEN n = 0 THEN 'no_evidence' WHEN known = 0 THEN 'unknown_reference' ELSE 'ok' END AS verdict FROM (SELECT conv_id, count(*) FILTER (role = 'assistant') AS n, count(*) FILTER (role = 'assistant' AND turn IN (SELECT cid FROM catalog)) AS known FROM conversations GROUP BY conv_id)")
def _verdicts(spark, d):
    known = b.catalog(spark, d).select(F.col("cid").alias("turn"), F.lit(1).alias("known"))
    said = b.raw(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("a")).join(known, "turn", "left")
    n = said.groupBy("conv_id").agg(F.count(F.when(F.col("a"), 1)).alias("n"), F.count(F.when(F.col("a"), F.col("known"))).alias("known"))
    return n.select("conv_id", F.when(F.col("n") == 0, "no_evidence").when(F.col("known") == 0, "unknown_reference").otherwise("ok").alias("verdict"))


# --- texts, lists, JSON, times ------------------------------------------------------------


@query("str01_arr01_list_text", r"SELECT doc_id, list_filter([trim(lang), trim(source), ''], lambda x: x <> '') AS parts, CASE WHEN doc_id % 4 = 0 THEN trim(lang) ELSE trim(source) END AS last FROM documents")
def _list_text(spark, d):
    parts = F.array(F.concat(F.lit(" \t"), "lang"), F.concat("source", F.lit("\n ")), F.lit("  "), F.lit(None).cast("string"))
    short = F.when(F.col("doc_id") % 4 == 0, F.array(F.concat(F.lit(" "), "lang"), F.lit(" "))).otherwise(parts)
    return b.raw(spark, d, "documents").select("doc_id", cleaning.list_text(parts).alias("parts"), cleaning.last_text(short).alias("last"))


@query("arr03_clean_lists", "SELECT cid, ['k' || cid, 'Two'] AS keywords, list_filter(list_transform(string_split(category, ';'), lambda x: CASE lower(trim(x)) WHEN 'ai' THEN 'AI' WHEN 'pricing' THEN 'Pricing' END), lambda x: x IS NOT NULL) AS categories FROM catalog")
def _clean_lists(spark, d):
    k = F.concat(F.lit("k"), F.col("cid").cast("string"))
    given = F.array(k, F.lit(" "), F.concat(F.lit(" K"), F.col("cid").cast("string"), F.lit(" ")), F.lit("Two"), F.lit("two"), F.lit("three"))
    return b.catalog(spark, d).select("cid", cleaning.distinct_ignoring_case(given, 2).alias("keywords"), cleaning.allowed_categories(F.col("category"), ("AI", "Pricing")).alias("categories"))


@query("str18_file_names", r"SELECT page_id, CASE WHEN n = '' THEN 'file' ELSE substring(n, 1, 120) END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[\\/:*?\"<>|\x00-\x1F]+', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS n FROM pages)")
def _names(spark, d):
    return b.raw(spark, d, "pages").select("page_id", cleaning.file_name(F.col("url")).alias("name"))


@query("str19_trimmed_sentences", r"""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN length(whole) * 2 > 300 THEN whole ELSE rtrim(cut) END AS part FROM (SELECT doc_id, text, cut, regexp_extract(cut, '(?s)^(.*[.!?])(\s|$)', 1) AS whole FROM (SELECT doc_id, text, substring(text, 1, 300) AS cut FROM documents))""")
def _trimmed(spark, d):
    return b.raw(spark, d, "documents").select("doc_id", cleaning.trimmed_sentence(F.col("text"), 300).alias("part"))


@query("str22_clean_markdown", r"""SELECT doc_id, regexp_replace(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: rtrim(x)), lambda x: NOT regexp_matches(x, '(?i)^\s*(page\s+)?[0-9]{1,4}(\s*(of|/)\s*[0-9]{1,4})?\s*$')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS md
 FROM (SELECT doc_id, 'Page 3 of 12' || chr(10) || text || '   ' || chr(10) || ' 17 ' || chr(10) || chr(10) || chr(10) || 'end' AS t FROM documents)""")  # fmt: skip
def _clean_md(spark, d):
    t = F.concat(F.lit("Page 3 of 12\n"), "text", F.lit("   \n 17 \n\n\nend"))
    return b.raw(spark, d, "documents").select("doc_id", cleaning.clean_markdown(t).alias("md"))


@query("str25_unescaped", "SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS html FROM pages")
def _unescaped(spark, d):
    return b.raw(spark, d, "pages").select("page_id", cleaning.unescape(F.col("html")).alias("html"))


@query("jsn03_jsn04_objects", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, event_id % 3 <> 2 AS found FROM events""")
def _objects(spark, d):
    i = F.col("event_id") % 3
    said = F.when(i == 0, F.col("props")).when(i == 1, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n``` as asked"))).otherwise("no object")
    found = cleaning.first_object(said)
    return b.raw(spark, d, "events").select("event_id", F.get_json_object(found, "$.k").alias("k"), found.isNotNull().alias("found"))


@query("dat02_dat06_latest_time", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN greatest(ts, ts + INTERVAL 1 HOUR) WHEN 1 THEN ts ELSE NULL END AS latest FROM events")
def _latest(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    later = F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    i = F.col("event_id") % 3
    return b.raw(spark, d, "events").select("event_id", cleaning.latest_time(F.when(i == 2, "soon").otherwise(F.concat(iso, F.lit("Z"))), F.when(i == 0, later).otherwise("")).alias("latest"))


@query("prj01_prj09_projections", "SELECT kb_id, list_sort(list(DISTINCT category)) AS categories, count(DISTINCT k.file_url) AS files FROM kb_files k JOIN catalog c ON c.file_url = k.file_url GROUP BY kb_id")
def _kb_categories(spark, d):
    j = b.kb_files(spark, d).join(b.catalog(spark, d).select("file_url", "category"), "file_url")
    return j.groupBy("kb_id").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.countDistinct("file_url").alias("files"))


# --- chains, merges, windows --------------------------------------------------------------


@query("joi04_bound_chunks", """SELECT DISTINCT x.kb_id, x.file_url, s.chunk_set_id, s.chunk_count, c.category FROM bindings x JOIN kb_files k ON k.kb_id = x.kb_id AND k.file_url = x.file_url JOIN chunk_sets s ON s.chunk_set_id = x.chunk_set_id AND s.file_url = x.file_url
 JOIN files f ON f.url = x.file_url JOIN catalog c ON c.file_url = x.file_url WHERE s.status = 'ready' AND f.deleted_at IS NULL""")  # fmt: skip
def _bound(spark, d):
    j = b.bindings(spark, d).join(b.kb_files(spark, d).select("kb_id", "file_url"), ["kb_id", "file_url"]).join(b.chunk_sets(spark, d).filter("status = 'ready'").select("chunk_set_id", "file_url", "chunk_count"), ["chunk_set_id", "file_url"])
    j = j.join(b.files(spark, d).filter("deleted_at IS NULL").select(F.col("url").alias("file_url")), "file_url", "left_semi").join(b.catalog(spark, d).select("file_url", "category"), "file_url")
    return j.select("kb_id", "file_url", "chunk_set_id", "chunk_count", "category").distinct()


@query("joi17_automation_candidates", """SELECT f.id, x.kb_id, n.newest, json_extract_string(e.props, '$.k') AS k FROM files f JOIN catalog c ON c.file_url = f.url AND c.status = 'ok' JOIN bindings x ON x.file_url = f.url LEFT JOIN kb_files m ON m.file_url = f.url AND m.kb_id = x.kb_id
 LEFT JOIN (SELECT file_url, max(updated_at) AS newest FROM chunk_sets WHERE status = 'ready' GROUP BY file_url) n ON n.file_url = f.url LEFT JOIN events e ON e.event_id = f.id
 WHERE (m.indexed_at IS NULL OR n.newest > m.indexed_at) AND coalesce(TRY_CAST(json_extract_string(e.props, '$.k') AS BIGINT), 0) < 5""")  # fmt: skip
def _candidates(spark, d):
    f = b.files(spark, d).select("id", F.col("url").alias("file_url"))
    newest = b.chunk_sets(spark, d).filter("status = 'ready'").groupBy("file_url").agg(F.max("updated_at").alias("newest"))
    ok = b.catalog(spark, d).filter("status = 'ok'").select("file_url")
    j = f.join(ok, "file_url", "left_semi").join(b.bindings(spark, d).select("kb_id", "file_url"), "file_url").join(b.kb_files(spark, d).select("kb_id", "file_url", "indexed_at"), ["kb_id", "file_url"], "left")
    j = j.join(newest, "file_url", "left").join(b.raw(spark, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("k")), "id", "left")
    return j.filter((F.col("indexed_at").isNull() | (F.col("newest") > F.col("indexed_at"))) & (F.coalesce(F.expr("try_cast(k AS BIGINT)"), F.lit(0)) < 5)).select("id", "kb_id", "newest", "k")


@query("dml05_prj05_weekly_summaries", """SELECT week, CAST(n + CASE WHEN week >= TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END AS BIGINT) AS n, CASE WHEN week >= TIMESTAMP '2024-01-15' THEN 'second' ELSE 'first' END AS made FROM (SELECT date_trunc('week', first_seen) AS week, count(*) AS n FROM files GROUP BY 1)""")
def _weekly(spark, d):
    old = b.files(spark, d).groupBy(tx.week_start("first_seen").alias("week")).agg(F.count("*").alias("n")).withColumn("made", F.lit("first"))
    new = old.filter(F.col("week") >= F.lit("2024-01-15").cast("timestamp")).select("week", (F.col("n") + 1).alias("n"), F.lit("second").alias("made"))
    return merge.upsert(old, new, ["week"])


@query("dml09_chunk_set_keys", """SELECT sha256(file_url || '|p1|' || md) AS set_id, file_url, cid % 2 = 0 AS was_there FROM (SELECT cid, file_url, sha256(markdown_content) AS md FROM catalog WHERE trim(coalesce(markdown_content, '')) <> '')""")
def _set_keys(spark, d):
    c = b.catalog(spark, d).filter(~tx.blank("markdown_content"))
    key = F.sha2(F.concat_ws("|", "file_url", F.lit("p1"), F.sha2("markdown_content", 256)), 256)
    asked = c.select(key.alias("set_id"), "file_url", F.lit(False).alias("was_there"))
    old = c.filter("cid % 2 = 0").select(key.alias("set_id"), "file_url", F.lit(True).alias("was_there"))
    return merge.insert_new(old, asked, ["set_id"])


@query("dml13_agg23_index_versions", """SELECT kb_id, CAST(v AS INT) AS version, CASE WHEN v = 2 THEN n ELSE old END AS chunks, v = 2 AS active FROM (SELECT x.kb_id, CAST(sum(chunk_count) AS BIGINT) AS n, CAST(sum(chunk_count) FILTER (x.binding_mode = 'pin') AS BIGINT) AS old FROM bindings x JOIN chunk_sets s ON s.chunk_set_id = x.chunk_set_id GROUP BY x.kb_id), (VALUES (1), (2)) t(v)""")
def _versions(spark, d):
    bound = b.bindings(spark, d).join(b.chunk_sets(spark, d).select("chunk_set_id", "chunk_count"), "chunk_set_id")
    count = lambda rows, v: rows.groupBy("kb_id").agg(F.lit(v).alias("version"), F.sum("chunk_count").alias("chunks"))
    versions = merge.insert_new(count(bound.filter("binding_mode = 'pin'"), 1), count(bound, 2), ["kb_id", "version"])
    newest = versions.groupBy("kb_id").agg(F.max("version").alias("version")).withColumn("active", F.lit(True))
    return versions.join(newest, ["kb_id", "version"], "left").select("kb_id", "version", "chunks", F.coalesce("active", F.lit(False)).alias("active"))


@query("dml16_category_links", "SELECT DISTINCT 'kb-' || lower(category) AS kb_id, file_url FROM (SELECT file_url, trim(unnest(string_split(category, ';'))) AS category FROM catalog) WHERE category IN ('AI', 'Pricing')")
def _links(spark, d):
    links = spark.createDataFrame([("kb-ai", "AI"), ("kb-pricing", "Pricing")], "kb_id string, category string")
    files = b.catalog(spark, d).select("file_url", F.explode(tx.visible_categories("category")).alias("category"))
    old = files.filter("category = 'AI'").select(F.lit("kb-ai").alias("kb_id"), "file_url").distinct()
    return merge.insert_new(old, files.join(links, "category").select("kb_id", "file_url").distinct(), ["kb_id", "file_url"])


@query("set02_path_conflicts", "SELECT 'title' AS what, id FROM files WHERE starts_with(coalesce(title, ''), 'T') UNION ALL SELECT 'name', id FROM files WHERE original_filename = 'f12.pdf' UNION ALL SELECT 'path', id FROM files WHERE local_path = '/data/12'")
def _conflicts(spark, d):
    f = b.files(spark, d)
    pick = lambda what, cond: f.filter(cond).select(F.lit(what).alias("what"), "id")
    return pick("title", F.col("title").startswith("T")).union(pick("name", F.col("original_filename") == "f12.pdf")).union(pick("path", F.col("local_path") == "/data/12"))


@query("win07_source_budget", """WITH RECURSIVE m AS (SELECT conv_id, CAST(length(text) AS BIGINT) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
 r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS taken FROM m
  UNION ALL SELECT r.conv_id, m.i, used + x, list_append(taken, x) FROM (SELECT r.*, m.n, m.i AS j, CASE WHEN 400 - r.used >= 20 THEN least(m.n, 400 - r.used) ELSE 0 END AS x FROM r JOIN m ON m.conv_id = r.conv_id AND m.i = r.i + 1) r JOIN m ON m.conv_id = r.conv_id AND m.i = r.j)
 SELECT conv_id, arg_max(taken, i) AS taken FROM r GROUP BY conv_id""")  # fmt: skip
def _budget(spark, d):
    sizes = b.raw(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("sizes"))
    return sizes.select("conv_id", cleaning.budgeted(F.col("sizes"), 400, 20).alias("taken"))


@query("win08_adjacent_words", "SELECT item_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS pairs FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)")
def _adjacent(spark, d):
    w = F.col("w")
    rows = b.raw(spark, d, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1).alias("w"))
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return rows.select("item_id", F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda x, y: F.concat_ws(" ", x, y)).alias("pairs"))


# --- counts, scores, vectors --------------------------------------------------------------


@query("agg02_distinct_sites", "SELECT count(DISTINCT source_site) AS n_sources, count(DISTINCT url) AS n_urls FROM files")
def _sites(spark, d):
    return b.files(spark, d).agg(F.countDistinct("source_site").alias("n_sources"), F.countDistinct("url").alias("n_urls"))


@query("agg15_prj13_category_list", "SELECT DISTINCT trim(c) AS category FROM (SELECT unnest(string_split(coalesce(category, ''), ';')) AS c FROM catalog) WHERE trim(c) <> '' AND NOT (trim(c) LIKE '(%' AND trim(c) LIKE '%)')")
def _category_list(spark, d):
    return stats.unique_categories(b.catalog(spark, d))


@query("agg16_agg17_case_rollups", """WITH r AS (SELECT item_id, list_filter(['the', 'of', 'de', 'la', 'und'], lambda w: contains(' ' || lower(text) || ' ', ' ' || w || ' ')) AS hits, CASE item_id % 3 WHEN 0 THEN ['the', 'of'] WHEN 1 THEN ['de'] ELSE CAST([] AS VARCHAR[]) END AS wanted FROM benchmark)
 SELECT count(*) AS n_cases, count(*) FILTER (len(list_intersect(hits, wanted)) >= 1 OR len(wanted) = 0) AS n_passed, round(coalesce(avg(CASE WHEN len(wanted) > 0 THEN len(list_intersect(hits, wanted)) / len(wanted) END), 1.0), 6) AS evidence_hit_rate,
 round(coalesce(avg(CASE WHEN len(wanted) = 0 THEN CAST(len(hits) = 0 AS DOUBLE) END), 1.0), 6) AS refusal_rate FROM r""")  # fmt: skip
def _rollups(spark, d):
    low = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    hits = F.filter(F.array(*[F.lit(w) for w in ("the", "of", "de", "la", "und")]), lambda w: F.contains(low, F.concat(F.lit(" "), w, F.lit(" "))))
    i = F.col("item_id") % 3
    wanted = F.when(i == 0, F.array(F.lit("the"), F.lit("of"))).when(i == 1, F.array(F.lit("de"))).otherwise(F.array().cast("array<string>"))
    return evidence.case_rollup(b.raw(spark, d, "benchmark").select(hits.alias("hits"), wanted.alias("wanted")))


@query("srt03_mat01_scored_titles", "SELECT id, round(CAST(CASE WHEN contains(lower(title), 'the') THEN 5 ELSE 0 END + CASE WHEN contains(lower(url), '1') THEN 0.33333 ELSE 0 END AS DOUBLE), 4) AS score FROM files WHERE contains(lower(coalesce(title, '')), 'the') OR contains(lower(url), '1') ORDER BY score DESC, lower(title), url LIMIT 100")
def _scored(spark, d):
    score = tx.field_score(["the"], "title", 5.0) + tx.field_score(["1"], "url", 0.33333)
    k = max(1, min(100, 500))
    return b.files(spark, d).withColumn("score", F.round(score, 4)).filter("score > 0").orderBy(F.desc("score"), F.lower("title"), "url").limit(k).select("id", "score")


@query("srt06_mat03_distance_rank", f"SELECT vec_id, round({_D2}, 5) AS distance, round(1 - {_D2} * {_D2} / 2, 5) AS score FROM embeddings")
def _distances(spark, d):
    v = vectors.scored(b.raw(spark, d, "embeddings"), _query_vector(spark, d))
    return v.select("vec_id", F.round("distance", 5).alias("distance"), F.round("score", 5).alias("score"))


@query("vec03_dimension_check", "SELECT vec_id, len(embedding) = 64 AS accepted FROM embeddings")
def _dimensions(spark, d):
    return b.raw(spark, d, "embeddings").select("vec_id", (F.size("embedding") == 64).alias("accepted"))


@query("vec09_least_of_each", f"SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {_D2}, vec_id) AS rn FROM embeddings) WHERE rn <= 2")
def _least(spark, d):
    v = vectors.scored(b.raw(spark, d, "embeddings"), _query_vector(spark, d))
    return serving.nearest_of_each(v, "label", 2, "distance", "vec_id").select("label", "vec_id")


@query("mat04_txt18_word_overlap", "SELECT x.doc_id, round(len(list_distinct(list_intersect(a, b))) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, round(len(list_distinct(list_intersect(a, b))) / len(list_distinct(a)), 6) AS contained FROM (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS a, string_split_regex(lower(substring(text, 1, 200)), '\\s+') AS b FROM documents) x")
def _overlap(spark, d):
    a, c = F.split(F.lower("text"), r"\s+"), F.split(F.lower(F.substring("text", 1, 200)), r"\s+")
    both = F.size(F.array_intersect(a, c))
    return b.raw(spark, d, "documents").select("doc_id", F.round(both / F.size(F.array_union(a, c)), 6).alias("jaccard"), F.round(both / F.size(F.array_distinct(a)), 6).alias("contained"))


@query("str02_str03_token_scores", "SELECT id, CAST(" + " + ".join(f"CASE WHEN contains(lower(coalesce(title, '')), '{t}') THEN 2.5 ELSE 0 END" for t in ("net", "the", "src_1")) + " AS DOUBLE) AS score FROM files")
def _tokens(spark, d):
    return b.files(spark, d).select("id", tx.field_score(tx.query_tokens("Net the src_1 NET"), "title", 2.5).alias("score"))


@query("mat02_clamped", "SELECT event_id, greatest(1, least(100, CAST(event_id % 300 - 50 AS BIGINT))) AS k FROM events")
def _clamped(spark, d):
    return b.raw(spark, d, "events").select("event_id", F.greatest(F.lit(1), F.least(F.lit(100), F.col("event_id") % 300 - 50)).alias("k"))
