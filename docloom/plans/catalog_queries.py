"""Queries over catalog runs: full builds, incremental runs over two snapshots, reports, categories by terms."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import cataloging, textpipe
from docloom.plans import bindings as b
from docloom.plans.registry import keywords_sql, query

# --- shared SQL: (doc_id, text, title) to keywords, summary and category ------------------

_RULES = "list_filter([" + ", ".join("{'s': " + " + ".join(f"CAST(regexp_matches(hay, '(^|[^a-z0-9_]){t}([^a-z0-9_]|$)') AS INT)" for t in terms) + f", 'i': {i}, 'name': '{name}'}}" for i, (name, terms) in enumerate(textpipe.RULES.items())) + "], lambda x: x.s > 0)"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 20)"


def described_sql(name: str, rows: str) -> str:
    """Common tables that end in ``name`` (doc_id, keywords, summary, category) of rows (doc_id, text, title)."""
    return f"""{name}_k AS ({keywords_sql(rows)}),
 {name}_s AS (SELECT doc_id, unnest(p) AS sentence, unnest(range(len(p))) AS pos FROM (SELECT doc_id, {_SENTENCES} AS p FROM {rows})),
 {name}_r AS (SELECT s.doc_id, sentence, row_number() OVER (PARTITION BY s.doc_id ORDER BY len(list_filter(keywords, lambda t: contains(lower(sentence), t))) DESC, pos) AS rn FROM {name}_s s JOIN {name}_k k ON k.doc_id = s.doc_id),
 {name}_c AS (SELECT doc_id, unnest({_RULES}) AS x FROM (SELECT r.doc_id, lower(title || ' ' || text || ' ' || array_to_string(keywords, ' ')) AS hay FROM {rows} r JOIN {name}_k k ON k.doc_id = r.doc_id)),
 {name} AS (SELECT k.doc_id, keywords, coalesce(summary, '') AS summary, coalesce(category, 'Other') AS category FROM {name}_k k
  LEFT JOIN (SELECT doc_id, string_agg(sentence, ' ' ORDER BY rn) AS summary FROM {name}_r WHERE rn <= 4 GROUP BY doc_id) s ON s.doc_id = k.doc_id
  LEFT JOIN (SELECT doc_id, string_agg(x.name, '; ' ORDER BY x.s DESC, x.i) FILTER (x.rn <= 3) AS category FROM (SELECT doc_id, struct_insert(x, rn := row_number() OVER (PARTITION BY doc_id ORDER BY x.s DESC, x.i)) AS x FROM {name}_c) GROUP BY doc_id) c ON c.doc_id = k.doc_id)"""


_WHITE = "trim(regexp_replace({0}, '\\s+', ' ', 'g')) = ''"

# --- full build ---------------------------------------------------------------------------

_BUILT = f"WITH src AS (SELECT id AS doc_id, text, coalesce(title, '') AS title FROM files WHERE trim(local_path) <> '' AND contains(lower(source_site), 'src') AND NOT ({_WHITE.format('text')})), {described_sql('x', 'src')}"


@query("txt07_build_catalog", f"{_BUILT} SELECT f.url, f.source_site, f.title, f.original_filename, x.keywords, x.summary, x.category FROM files f JOIN x ON x.doc_id = f.id")
def _build(spark, d):
    files = b.files(spark, d).withColumn("content", F.encode("text", "UTF-8"))
    return cataloging.build(files, "SRC").select("url", "source_site", "title", "original_filename", "keywords", "summary", "category")


_HEAD = "| category | source_site | title | original_filename | keywords | summary | url | local_path |"
_CELL = "regexp_replace(replace(coalesce({0}, ''), '|', ' '), '[\\r\\n]+', ' ', 'g')"
_LINE = " || ' | ' || ".join(_CELL.format(c) for c in ("x.category", "source_site", "f.title", "original_filename", "array_to_string(x.keywords, ', ')", "x.summary", "url", "local_path"))


@query("snk02_catalog_report", f"{_BUILT} SELECT '{_HEAD}' AS line UNION ALL SELECT '| --- | --- | --- | --- | --- | --- | --- | --- |' UNION ALL SELECT '| ' || {_LINE} || ' |' FROM files f JOIN x ON x.doc_id = f.id")
def _report(spark, d):
    from docloom.sources import readers

    items = cataloging.build(b.files(spark, d).withColumn("content", F.encode("text", "UTF-8")), "src")
    path = readers.scratch(spark, "catalog-report")
    old, new = items.filter("source_site < 'src3'"), items.filter("source_site >= 'src3'")
    cataloging.write_report(old, path)
    cataloging.write_report(new, path, append=True)
    return spark.read.text(path).select(F.col("value").alias("line"))


# --- incremental runs ---------------------------------------------------------------------
# The first run sees the files of three sites in four, a third of them with another content, and no
# Markdown for every fifth; the second sees all files as they are now, and no Markdown for every seventh.

_V1, _V2 = "2024-03-01", "2024-03-08"


def _first_files(spark, d) -> DataFrame:
    f = b.files(spark, d).filter("id % 4 <> 0")
    text = F.when(F.col("id") % 3 == 0, F.concat("text", F.lit(" An earlier text that was changed."))).otherwise(F.col("text"))
    return f.withColumn("text", text).withColumn("sha256", F.sha2("text", 256))


def _empty_catalog(files: DataFrame, no_markdown: str) -> DataFrame:
    """A row a file with its Markdown, before any run."""
    blank = {c: F.lit(None).cast("timestamp" if c == "processed_at" else "string").alias(c) for c in cataloging.ITEM if c != "file_url"}
    return files.select(F.col("url").alias("file_url"), *blank.values(), F.when(F.expr(no_markdown), F.lit(None)).otherwise(F.col("text")).alias("markdown_content"))


def _second_run(spark, d) -> cataloging.Run:
    old = _first_files(spark, d)
    first = cataloging.run(old, _empty_catalog(old, "id % 5 = 0"), "v2", F.lit(_V1).cast("timestamp"))
    files = b.files(spark, d)
    now = files.select(F.col("url").alias("file_url"), F.when(F.col("id") % 7 != 0, F.col("text")).alias("now"))
    catalog = now.join(first.catalog, "file_url", "left").withColumn("markdown_content", F.col("now")).drop("now")
    return cataloging.run(files, catalog, "v2", F.lit(_V2).cast("timestamp"), ai_only=True)


_TWO_RUNS = f"""WITH old AS (SELECT id, url, CASE WHEN id % 3 = 0 THEN text || ' An earlier text that was changed.' ELSE text END AS text, coalesce(title, '') AS title, local_path FROM files WHERE id % 4 <> 0),
 old_src AS (SELECT id AS doc_id, text, title FROM old WHERE trim(local_path) <> '' AND id % 5 <> 0 AND NOT ({_WHITE.format('text')})), {described_sql('o', 'old_src')},
 had AS (SELECT old.id, sha256(old.text) AS sha, CASE WHEN o.doc_id IS NULL THEN 'error' ELSE 'ok' END AS status, coalesce(o.summary, '') AS summary, coalesce(o.category, '') AS category, coalesce(o.keywords, CAST([] AS VARCHAR[])) AS keywords FROM old LEFT JOIN o ON o.doc_id = old.id WHERE trim(local_path) <> ''),
 due AS (SELECT f.id, f.text, coalesce(f.title, '') AS title FROM files f LEFT JOIN had ON had.id = f.id WHERE trim(f.local_path) <> '' AND (had.id IS NULL OR had.sha <> f.sha256 OR trim(had.summary) = '')),
 new_src AS (SELECT id AS doc_id, text, title FROM due WHERE id % 7 <> 0 AND NOT ({_WHITE.format('text')})), {described_sql('n', 'new_src')},
 hit AS (SELECT n.doc_id, len(list_filter(n.keywords, lambda k: contains(lower(s.title || ' ' || s.text), k))) > 0 OR {" OR ".join(f"contains(lower(s.title || ' ' || s.text), '{t}')" for t in cataloging.AI_TERMS)} AS related FROM n JOIN new_src s ON s.doc_id = n.doc_id),
 did AS (SELECT due.id, CASE WHEN n.doc_id IS NULL THEN 'error' WHEN NOT related THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN related THEN n.summary ELSE '' END AS summary,
  CASE WHEN n.doc_id IS NULL THEN '' WHEN NOT related THEN '{cataloging.LEFT_OUT}' ELSE n.category END AS category, coalesce(n.keywords, CAST([] AS VARCHAR[])) AS keywords, CASE WHEN n.doc_id IS NULL THEN '{cataloging.NO_MARKDOWN}' END AS error FROM due LEFT JOIN n ON n.doc_id = due.id LEFT JOIN hit ON hit.doc_id = due.id)"""


@query("txt08_incremental_catalog", f"""{_TWO_RUNS} SELECT f.url AS file_url, CASE WHEN did.id IS NOT NULL THEN did.status ELSE had.status END AS status, CASE WHEN did.id IS NOT NULL THEN did.summary ELSE had.summary END AS summary,
 CASE WHEN did.id IS NOT NULL THEN did.category ELSE had.category END AS category, CASE WHEN did.id IS NOT NULL THEN did.keywords ELSE had.keywords END AS keywords, CASE WHEN did.id IS NOT NULL THEN did.error WHEN had.status = 'error' THEN '{cataloging.NO_MARKDOWN}' END AS error,
 CASE WHEN did.id IS NOT NULL THEN f.sha256 ELSE had.sha END AS file_sha256, CASE WHEN did.id IS NOT NULL THEN TIMESTAMP '{_V2}' WHEN had.id IS NOT NULL THEN TIMESTAMP '{_V1}' END AS processed_at FROM files f LEFT JOIN had ON had.id = f.id LEFT JOIN did ON did.id = f.id""")  # fmt: skip
def _incremental(spark, d):
    got = _second_run(spark, d).catalog
    return got.select("file_url", "status", "summary", "category", F.from_json("keywords", "array<string>").alias("keywords"), "error", "file_sha256", "processed_at")


@query("txt08_run_stats", f"{_TWO_RUNS} SELECT count(*) AS scanned, count(*) FILTER (status = 'ok') AS processed, count(*) FILTER (status = 'ok') AS written, count(*) FILTER (status = 'skipped') AS skipped_ai, count(*) FILTER (status = 'error') AS errors, 0 AS missing_files, list(error ORDER BY id DESC) FILTER (status = 'error')[:20] AS error_samples FROM did")
def _stats(spark, d):
    return _second_run(spark, d).stats.withColumn("missing_files", F.col("missing_files").cast("int"))


# --- categories by terms ------------------------------------------------------------------

_TERMS = {"Alpha": ("the", "of"), "Beta": ("de", "LA", "le"), "Gamma": ("der", "und")}


@lru_cache
def _scores_sql() -> str:
    hay = "lower(coalesce(title, '') || ' ' || coalesce(text, '') || ' ' || lang)"
    return "[" + ", ".join("{'s': " + " + ".join(f"CAST(contains({hay}, '{t.lower()}') AS INT)" for t in terms) + f", 'i': {i}, 'name': '{name}'}}" for i, (name, terms) in enumerate(_TERMS.items())) + "]"


@query("txt05_categories_by_terms", f"SELECT id, coalesce((list_filter(list_sort(list_transform(s, lambda x: {{'n': -x.s, 'i': x.i, 'name': x.name}})), lambda x: x.n < 0)[1]).name, '') AS best, list_transform(list_filter(s, lambda x: x.s >= 2), lambda x: x.name) AS all_of FROM (SELECT id, {_scores_sql()} AS s FROM files)")
def _by_terms(spark, d):
    text, title, keys = F.col("text"), F.col("title"), F.array("lang")
    return b.files(spark, d).select("id", cataloging.categorize_by_terms(text, title, keys, _TERMS).alias("best"), cataloging.categories_by_terms(text, title, keys, _TERMS, 2).alias("all_of"))
