"""Rules of reading and collecting: what is listed, kept, available, searched, and how a site did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import blank, field_score, in_category, keyword_list, query_tokens
from docloom.operators.answers import first_text

# Fields of file lists, endings and size of files that are kept, and error texts by the first class that they show.
PUBLIC_FIELDS = (
    "url", "title", "source_site", "source_page_url", "original_filename", "bytes", "content_type", "last_modified", "published_time", "first_seen", "last_seen", "crawl_time",
    "category", "summary", "keywords", "markdown_source", "markdown_updated_at", "rag_chunk_count", "rag_indexed_at",
)
RECENT_FIELDS = ("url", "title", "original_filename", "source_site", "content_type", "last_seen")
KEPT_ENDINGS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt")
MAX_FILE_MB = 500
BLOCKED = (
    ("http_403", r"\b403\b|forbidden"),
    ("http_429", r"\b429\b|too many requests|rate limit"),
    ("access_denied", r"access denied"),
    ("cloudflare", r"cloudflare"),
    ("sucuri", r"sucuri"),
    ("timeout", r"timed?\s*out|timeout"),
    ("zero_pages_visited", r"\b0\s+pages?\s+visited\b"),
)


# --- lists of files -----------------------------------------------------------------------


def projected(files: DataFrame, fields: tuple[str, ...] = PUBLIC_FIELDS, more: tuple[str, ...] = ()) -> DataFrame:
    """The fields of a list, in its order; fields that the table lacks are null."""
    return files.select(*[F.col(f"`{c}`") if c in files.columns else F.lit(None).cast("string").alias(c) for c in (*fields, *more)])


def available_documents(files: DataFrame, catalog: DataFrame, categories: tuple[str, ...] = (), keywords: str = "", limit: int = 1000) -> DataFrame:
    """file_url, filename, title, category and keywords of files with Markdown, by title and name.

    Any of the categories, and any of the keywords (parted by commas, in title, name or the
    catalog's keywords), where some are given.
    """
    c = catalog.filter(F.coalesce("markdown_content", F.lit("")) != "").select("file_url", "category", "keywords")
    rows = files.filter("deleted_at IS NULL").select("url", "original_filename", "title").join(c, F.col("url") == F.col("file_url"))
    if categories:
        fits = F.lit(False)
        for name in categories:
            fits = fits | (blank("category") if name == "__uncategorized__" else F.coalesce(in_category("category", name), F.lit(False)))
        rows = rows.filter(fits)
    words = [w.strip().lower() for w in keywords.split(",") if w.strip()]
    if words:
        has = F.lit(False)
        for w in words:
            for column in ("title", "original_filename", "keywords"):
                has = has | F.coalesce(F.lower(column).contains(w), F.lit(False))
        rows = rows.filter(has)
    name = F.coalesce("original_filename", F.lit(""))
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(name)
    listed = F.filter(F.transform(F.coalesce(keyword_list("keywords"), F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: k != "")
    return rows.orderBy(F.asc_nulls_first("title"), F.asc_nulls_first("original_filename"), "file_url").limit(limit).select("file_url", name.alias("filename"), title.alias("title"), F.coalesce("category", F.lit("")).alias("category"), listed.alias("keywords"))


# --- collections --------------------------------------------------------------------------


def search_collections(kbs: DataFrame, query: str, kb_id: str | None = None, limit: int = 20) -> DataFrame:
    """kb_id, name, description, created_at and score of collections by category: 10 for the name, 5 for the description."""
    low = query.lower()
    score = F.when(F.lower("name").contains(low), 10).otherwise(0) + F.when(F.lower("description").contains(low), 5).otherwise(0)
    rows = kbs.filter(F.col("kb_mode").isin("category", "hybrid"))
    rows = rows.filter(F.col("kb_id") == kb_id) if kb_id else rows
    found = rows.withColumn("score", score).filter((F.col("score") > 0) & F.lit(query != ""))
    return found.orderBy(F.desc("score"), "kb_id").limit(min(max(1, limit), 100)).select("kb_id", "name", "description", "created_at", "score")


def manifest_status(collections: DataFrame, manifests: DataFrame, members: DataFrame) -> DataFrame:
    """kb_id, status (missing, ready, stale or as the manifest says), usable and stale_reason of each collection.

    ``manifests`` has kb_id, status, built_at, doc_count and error_message; ``members`` has
    kb_id, file_url and changed_at.  A ready manifest is stale if a member changed after it was
    built, or if it counts other documents than there are.
    """
    now = members.groupBy("kb_id").agg(F.countDistinct("file_url").alias("n_now"), F.max("changed_at").alias("latest"))
    j = collections.select("kb_id").join(manifests, "kb_id", "left").join(now, "kb_id", "left")
    said = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    said = F.when(said == "", "missing").otherwise(said)
    newer = F.coalesce(F.col("latest") > F.col("built_at"), F.lit(False))
    other = F.coalesce("doc_count", F.lit(0)) != F.coalesce("n_now", F.lit(0))
    status = F.when((said == "ready") & (newer | other), "stale").otherwise(said)
    unbuilt = F.col("built_at").isNull() & F.col("status").isNull()
    reason = F.when(unbuilt, "ready_data manifest has not been built").when((said == "ready") & newer, "KB source files changed after the ready_data manifest was built").when((said == "ready") & other, "KB document count differs from the ready_data manifest")
    reason = reason.when(status.isin("missing", "failed", "stale"), first_text(F.col("error_message"), F.lit("ready_data is unavailable")))
    return j.select("kb_id", status.alias("status"), (status == "ready").alias("usable"), F.coalesce("n_now", F.lit(0)).alias("current_doc_count"), reason.alias("stale_reason"))


def select_for_queries(queries: DataFrame, kbs: DataFrame, threshold: float = 0.3, near: float = 0.2, most_kbs: int = 1000) -> DataFrame:
    """query_id, kb_id, relevance and rank of the collections to ask.

    Relevance is 0.4 of the query's categories that a collection has, 0.4 of its keywords and
    0.2 of its entities in name or description.  Those at the threshold are chosen, the best
    in any case, and of the next three those within ``near`` of the best.  Every query is held
    against every collection, whose list is refused above ``most_kbs``.
    """
    if kbs.limit(most_kbs + 1).count() > most_kbs:
        raise ValueError(f"more than {most_kbs} collections")
    shown = F.lower(F.concat_ws("\n", "name", "description"))
    listed = kbs.select(F.lit(0).alias("one"), F.struct("kb_id", shown.alias("shown"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories")).alias("kb")).groupBy("one").agg(F.collect_list("kb").alias("kbs"))
    part = lambda have, n: F.when(n > 0, have / n).otherwise(0.0)
    words = lambda c, kb: F.size(F.filter(c, lambda w: F.contains(kb["shown"], F.lower(w))))
    q = queries.select("query_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("q_categories", "q_keywords", "q_entities")])

    def relevance(kb: Column) -> Column:
        by_category = part(F.size(F.array_intersect("q_categories", kb["categories"])), F.size(F.array_distinct("q_categories")))
        return F.least(F.lit(1.0), 0.4 * by_category + 0.4 * part(words(F.col("q_keywords"), kb), F.size("q_keywords")) + 0.2 * part(words(F.col("q_entities"), kb), F.size("q_entities")))

    rows = q.withColumn("one", F.lit(0)).join(F.broadcast(listed), "one")
    ranked = F.array_sort(F.transform("kbs", lambda kb: F.struct((-F.round(relevance(kb), 9)).alias("less"), kb["kb_id"].alias("kb_id"))))
    places = rows.select("query_id", ranked.alias("r")).select("query_id", F.col("r")[0]["less"].alias("best"), F.posexplode("r").alias("pos", "x"))
    chosen = (F.col("pos") == 0) | (-F.col("x.less") >= threshold) | ((F.col("pos") <= 3) & (F.round(F.col("x.less") - F.col("best"), 9) <= near))
    return places.filter(chosen).select("query_id", F.col("x.kb_id").alias("kb_id"), (-F.col("x.less")).alias("relevance"), (F.col("pos") + 1).alias("rank"))


def search_summaries(catalog: DataFrame, summaries: DataFrame, sections: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """doc_id, title, file_url, score and source of documents by summary, title, category, headings and section texts.

    Fields of ``summaries`` that are not blank replace those of the catalog; documents that
    only they have count as well.  Sections are scored where they are: what a document needs
    of them is which words they have, not their texts.
    """
    tokens, k = query_tokens(query.strip()), max(1, min(100, limit))
    s = summaries.groupBy("doc_id").agg(*[F.max(c).alias(f"s_{c}") for c in ("file_url", "title", "category", "summary")])
    j = catalog.withColumn("in_catalog", F.lit(True)).join(s.withColumn("in_summaries", F.lit(True)), "doc_id", "full_outer")
    for c in ("file_url", "title", "category", "summary"):
        j = j.withColumn(c, F.coalesce(F.nullif(F.col(f"s_{c}"), F.lit("")), F.col(c), F.lit("")))
    heard = F.lower("text")
    found = sections.groupBy("doc_id").agg(*[F.max(heard.contains(t)).alias(f"t{i}") for i, t in enumerate(tokens)] or [F.lit(False).alias("t0")])
    scored = j.join(found, "doc_id", "left")
    parts = {
        "by_summary": field_score(tokens, "summary", 4.0), "by_title": field_score(tokens, "title", 2.0), "by_category": field_score(tokens, "category", 1.0),
        "by_headings": field_score(tokens, F.array_join(F.coalesce("headings", F.array().cast("array<string>")), " "), 1.0),
        "by_sections": sum((F.when(F.col(f"t{i}"), 0.75).otherwise(0.0) for i in range(len(tokens))), F.lit(0.0)),
    }
    phrase = query.strip().lower()
    total = sum((F.col(p) for p in parts), F.lit(0.0)) + F.when(F.lit(phrase != "") & F.lower("summary").contains(phrase), 3.0).otherwise(0.0)
    known = F.coalesce("in_summaries", F.lit(False)) & ((F.col("by_summary") > 0) | F.col("in_catalog").isNull())
    own = (F.col("by_summary") > 0) | (F.col("by_title") > 0) | (F.col("by_category") > 0) | (F.col("by_headings") > 0)
    source = F.when(known, "doc_summaries").when(own, "doc_catalog").otherwise("sections")
    rows = scored.withColumns(parts).withColumn("score", F.round(total, 4)).filter((F.col("score") > 0) & F.lit(bool(tokens)))
    return rows.select("doc_id", "title", "file_url", "score", source.alias("source")).orderBy(F.desc("score"), F.lower("title"), "file_url").limit(k)


# --- collecting ---------------------------------------------------------------------------


def keepable(path: Column, size: Column, ai_only: bool = False, terms: tuple[str, ...] = (), title: Column | None = None) -> Column:
    """struct(keep, reason) of a file; a null size is a file that isn't there."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)/*$", 1)
    ending = F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))
    mb = F.format_string("%.1f", size / (1024 * 1024))
    refused = (
        F.when(size.isNull(), "File not found").when(size == 0, "Empty file")
        .when(size > MAX_FILE_MB * 1024 * 1024, F.concat(F.lit("File too large ("), mb, F.lit(f" MB > {MAX_FILE_MB} MB)")))
        .when(~ending.isin(*KEPT_ENDINGS), F.concat(F.lit("Unsupported file type: "), ending))
    )
    told = F.lit("Accepted")
    if ai_only:
        by_name = mentions(terms, F.coalesce(title, F.lit("")) if title is not None else F.lit(""), name)
        told = F.when(by_name, "AI-related (by metadata)").otherwise("Accepted (full content check not implemented)")
    return F.struct(refused.isNull().alias("keep"), F.coalesce(refused, told).alias("reason"))


def mentions(terms: tuple[str, ...], *columns: Column) -> Column:
    """Any of the terms in the texts, whatever the case; all rows where there are no terms."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))
    out = F.lit(not terms)
    for t in terms:
        out = out | hay.contains(t.lower())
    return out


def site_outcome(error: Column, items_found: Column) -> Column:
    """struct(reason, blocked) of a crawl: the first class that its errors show, else error, zero_results or success."""
    text = F.coalesce(error, F.lit(""))
    blocked, reason = F.lit(False), F.when(text != "", "error").when(F.coalesce(items_found, F.lit(0)) <= 0, "zero_results").otherwise("success")
    for name, pattern in reversed(BLOCKED):
        shows = text.rlike(f"(?i){pattern}")
        reason, blocked = F.when(shows, name).otherwise(reason), F.when(shows, True).otherwise(blocked)
    return F.struct(reason.alias("reason"), blocked.alias("blocked"))


def fallback_reasons(sites: DataFrame, outcomes: DataFrame) -> DataFrame:
    """site_id and why its search has to fall back, null where it needn't.

    ``sites`` has site_id, name and url; ``outcomes`` has name, url, blocked, failed, success,
    items_found and fallback_reason.  An outcome is known by its name, else by its url; of
    several the last by ``seq`` counts.
    """
    key = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    short = outcomes.select(key("name").alias("n"), key("url").alias("u"), "seq", F.struct("blocked", "failed", "success", "items_found", "fallback_reason").alias("o"))
    by_name = short.filter("n <> ''").groupBy("n").agg(F.max_by("o", "seq").alias("by_name"))
    by_url = short.filter("u <> ''").groupBy("u").agg(F.max_by("o", "seq").alias("by_url"))
    j = sites.withColumn("n", key("name")).withColumn("u", key("url")).join(by_name, "n", "left").join(by_url, "u", "left").withColumn("o", F.coalesce("by_name", "by_url"))
    told = lambda plain: F.coalesce(F.nullif(F.trim(F.coalesce("o.fallback_reason", F.lit(""))), F.lit("")), F.lit(plain))
    failed = F.coalesce("o.failed", F.lit(False)) | ~F.coalesce("o.success", F.lit(True))
    reason = F.when(F.col("o").isNull(), None).when(F.coalesce("o.blocked", F.lit(False)), told("blocked")).when(failed, told("failed")).when(F.coalesce("o.items_found", F.lit(0)) <= 0, told("zero_results"))
    return j.select("site_id", reason.alias("reason"))


# --- weekly summaries ---------------------------------------------------------------------


def decoded_summary(rows: DataFrame) -> DataFrame:
    """Weekly summaries with ``files`` and ``metadata`` as canonical JSON; broken or blank texts give an empty list and object."""

    def parsed(c: str, default: str) -> Column:
        text = F.col(c)
        return F.to_json(F.coalesce(F.try_parse_json(F.when(F.coalesce(text, F.lit("")) != "", text)), F.parse_json(F.lit(default))))

    return rows.withColumn("files", parsed("files_json", "[]")).withColumn("metadata", parsed("metadata_json", "{}")).drop("files_json", "metadata_json")


def latest_summary(rows: DataFrame) -> DataFrame:
    return decoded_summary(rows.orderBy(F.desc("period_start"), F.desc("generated_at")).limit(1))


def nearest_of_each(scored: DataFrame, group: str, k: int, *order: str) -> DataFrame:
    """The first k rows of each group; partial ranks are cut before rows move."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)
