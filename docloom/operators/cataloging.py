"""Catalog runs over files: each row is read, described and filed; a failure stays with its row.

A run takes the files that are new, changed, made by another version or blank in the
catalog, describes them (keywords, summary, category) and merges one row for each, with
status ok, skipped or error, into the old snapshot.  All of it happens within the row: but
for the join with the catalog and the merge, nothing moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import listing, merge, textpipe
from docloom.sources import readers

# The columns of a report, what stands for documents that are left out, and the messages of errors.
REPORT = ("category", "source_site", "title", "original_filename", "keywords", "summary", "url", "local_path")
LEFT_OUT = "(filtered: non-AI)"
NO_MARKDOWN, NO_TEXT = "missing markdown content", "empty extracted text"
AI_TERMS = ("artificial intelligence", "machine learning", "deep learning", "large language model", "llm", "generative ai", "neural network", "nlp")
ITEM = ("file_url", "file_sha256", "title", "source_site", "original_filename", "local_path", "keywords", "summary", "category", "catalog_version", "processed_at", "status", "error")


def of_sites(sites: str, *columns: str) -> Column:
    """Any of the names, parted by commas, stands in one of the columns, whatever the case; no names: all rows."""
    names = [s.strip().lower() for s in sites.split(",") if s.strip()]
    out = F.lit(not names)
    for name in names:
        out = out | tx.contains_any(name, *columns)
    return out


def candidates(files: DataFrame, catalog: DataFrame, version: str, sites: str = "", retry_errors: bool = False, skip_existing: bool = True, limit: int = 0, offset: int = 0) -> DataFrame:
    """Files with a local path that a run has to describe, newest first where some are left out by limit or offset."""
    able = files.filter(~tx.blank("local_path") & of_sites(sites, "source_site"))
    if skip_existing:
        known = catalog.select("file_url", "file_sha256", "catalog_version", "summary", "status")
        due = listing.needs_catalog(version, retry_errors)
        able = listing.with_catalog(able, known).filter(F.coalesce(due, F.lit(False))).drop(*known.columns)
    if limit or offset:
        able = able.orderBy(F.desc("id")).offset(offset)
        able = able.limit(limit) if limit else able
    return able


def _said(text: Column) -> Column:
    """Anything but white space."""
    return text.rlike(r"(?U)\S")


def file_text(content: Column, local_path: Column, kind: Column) -> tuple[Column, Column]:
    """(text, error) of a file's bytes: text and HTML in UTF-8 are read."""
    raw = F.coalesce(content, F.lit("").cast("binary"))
    sound = F.is_valid_utf8(raw.cast("string"))
    text = F.when(sound & (kind == "html"), tx.html_text(raw.cast("string"))).when(sound & (kind == "txt"), raw.cast("string")).otherwise("")
    lost = F.concat(F.lit("File not found: "), local_path, F.lit(" (orig: "), local_path, F.lit(")"))
    unread = F.when(content.isNull(), lost).when(F.octet_length(raw) == 0, F.lit(NO_TEXT)).when(~kind.isin("html", "txt"), F.concat(F.lit("no reader for "), kind))
    return text, F.coalesce(unread, F.when(~sound, F.lit("text is not UTF-8")), F.when(~_said(text), F.lit(NO_TEXT)))


def related(text: Column, title: Column, keywords: Column, terms: tuple[str, ...]) -> Column:
    """A term, or a keyword, stands in title or text."""

    def said(hay: Column) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | hay.contains(t)
        return out | F.exists(keywords, lambda k: F.contains(hay, F.lower(k)))

    return tx.let(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), text)), said)


def described(rows: DataFrame, source: str = "markdown", ai_only: bool = False, terms: tuple[str, ...] = AI_TERMS, rules: dict[str, tuple[str, ...]] = textpipe.RULES) -> DataFrame:
    """Adds keywords, summary, category, status and error.

    The text is ``markdown_content``, or what the bytes in ``content`` hold (null: no such
    file).  Rows without text are errors; with ``ai_only``, rows with no term are skipped.
    """
    if source == "markdown":
        text = F.coalesce(F.col("markdown_content"), F.lit(""))
        error = F.when(~_said(text), F.lit(NO_MARKDOWN))
    elif source == "source":
        text, error = file_text(F.col("content"), F.coalesce("local_path", F.lit("")), readers.detect_kind(F.coalesce("content", F.lit("").cast("binary"))))
    else:
        raise ValueError(f"unsupported catalog input_source: {source}")
    none = F.array().cast("array<string>")
    read = rows.withColumn("_text", F.when(error.isNull(), text).otherwise("")).withColumn("error", error)
    read = read.withColumn("_words", textpipe.keyword_column(F.col("_text"), F.coalesce("title", F.lit(""))))
    left_out = ~related(F.col("_text"), F.col("title"), F.col("_words"), terms) if ai_only else F.lit(False)
    marked = read.withColumn("status", F.when(F.col("error").isNotNull(), "error").when(left_out, "skipped").otherwise("ok"))
    ok = F.col("status") == "ok"
    out = marked.withColumns({
        "keywords": F.when(F.col("status") == "error", none).otherwise(F.col("_words")),
        "summary": F.when(ok, textpipe.summary_column(F.col("_text"), F.col("_words"))).otherwise(""),
        "category": F.when(ok, textpipe.categorize(F.concat_ws(" ", F.coalesce("title", F.lit("")), "_text", F.array_join("_words", " ")), rules)).when(F.col("status") == "skipped", LEFT_OUT).otherwise(""),
    })
    return out.drop("_text", "_words")


def build(files: DataFrame, sites: str = "", limit: int | None = None, offset: int = 0, ai_only: bool = False, source: str = "source", rules: dict[str, tuple[str, ...]] = textpipe.RULES) -> DataFrame:
    """Items of the files in id order, from the offset on, without those that fail or are skipped."""
    rows = files.filter(~tx.blank("local_path") & of_sites(sites, "source_site", "url"))
    if limit is not None or offset:
        rows = rows.orderBy("id").offset(offset)
        rows = rows if limit is None else rows.limit(limit)
    kept = described(rows.filter(of_sites(sites, "source_site")), source, ai_only, rules=rules).filter("status = 'ok'")
    return kept.select("source_site", "title", "original_filename", "url", "local_path", "keywords", "summary", "category")


@dataclass
class Run:
    outcomes: DataFrame  # a row a candidate, with the columns of the catalog
    catalog: DataFrame  # the new snapshot
    stats: DataFrame  # one row


def run(files: DataFrame, catalog: DataFrame, version: str, now: Column, source: str = "markdown", ai_only: bool = False, rules: dict[str, tuple[str, ...]] = textpipe.RULES, **which: object) -> Run:
    """One run; ``which`` goes to ``candidates``.  Markdown is taken from the catalog's rows.

    Rows outside the candidates keep all that they had.  Outcomes are written once, so that
    snapshot and counts are of the same work.
    """
    due = candidates(files, catalog, version, **which)
    if source == "markdown":
        due = due.drop("markdown_content").join(catalog.select(F.col("file_url").alias("url"), "markdown_content"), "url", "left")
    found = described(due, source, ai_only, rules=rules)
    rows = found.withColumns({"file_url": F.col("url"), "file_sha256": F.coalesce("sha256", F.lit("")), "keywords": F.to_json("keywords"), "catalog_version": F.lit(version), "processed_at": now})
    outcomes = readers.stored(rows.select("id", *ITEM), "catalog-outcomes")
    return Run(outcomes.drop("id"), merge.upsert(catalog, outcomes.drop("id"), ["file_url"]), stats(outcomes))


def stats(outcomes: DataFrame) -> DataFrame:
    """scanned, processed, written, skipped_ai, errors, missing_files, and the messages of the 20 newest errors."""
    has = lambda s: F.count(F.when(F.col("status") == s, 1))
    counts = outcomes.agg(F.count("*").alias("scanned"), has("ok").alias("processed"), has("ok").alias("written"), has("skipped").alias("skipped_ai"), has("error").alias("errors"), F.count(F.when(F.col("error").contains("File not found"), 1)).alias("missing_files"))
    newest = outcomes.filter("status = 'error'").orderBy(F.desc("id")).limit(20)
    samples = newest.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "error")), False), lambda x: x["error"]).alias("error_samples"))
    return counts.crossJoin(samples)


def report_lines(items: DataFrame) -> DataFrame:
    """(value): the items as rows of a pipe table."""
    shown = [F.array_join("keywords", ", ") if c == "keywords" else F.coalesce(F.col(c), F.lit("")) for c in REPORT]
    cells = [F.regexp_replace(F.replace(c, F.lit("|"), F.lit(" ")), r"[\r\n]+", " ") for c in shown]
    return items.select(F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |")).alias("value"))


def write_report(items: DataFrame, path: str, append: bool = False) -> None:
    """A report as a folder of text: ``part=0`` holds the head, ``part=1`` the rows; append adds rows only."""
    if not append:
        head = [(f"| {' | '.join(REPORT)} |\n| {' | '.join(['---'] * len(REPORT))} |",)]
        items.sparkSession.createDataFrame(head, "value string").coalesce(1).write.text(f"{path}/part=0")
    report_lines(items).write.mode("append").text(f"{path}/part=1")


def categorize_by_terms(text: Column, title: Column, keywords: Column, categories: dict[str, tuple[str, ...]]) -> Column:
    """The category with most of its terms anywhere in title, text and keywords; the first of equals, empty if none has any."""
    scored = F.filter(_scored(text, title, keywords, categories), lambda x: x["s"] < 0)
    return F.coalesce(F.array_min(scored)["name"], F.lit(""))


def categories_by_terms(text: Column, title: Column, keywords: Column, categories: dict[str, tuple[str, ...]], least: int = 1) -> Column:
    """All categories with at least so many of their terms, in their order."""
    return F.transform(F.filter(_scored(text, title, keywords, categories), lambda x: x["s"] <= -least), lambda x: x["name"])


def _scored(text: Column, title: Column, keywords: Column, categories: dict[str, tuple[str, ...]]) -> Column:
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")), F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " ")))
    score = lambda terms: -sum((F.when(hay.contains(t.lower()), 1).otherwise(0) for t in terms), F.lit(0))
    return F.array(*[F.struct(score(terms).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, terms) in enumerate(categories.items())])
