"""Evaluation of retrieval and of answers: what was expected is matched with what came, case by case.

Results of a case are bounded by its ``top_k``, so a case is a row with short lists and all
matching is within the row; only the rates over all cases, or by category, are aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The answer that refuses, the fields that identify a citation, and those that anchor an answer.
NO_EVIDENCE = "No evidence found in ready_data for this query."
IDENTITY = ("doc_id", "file_url", "title", "section_id", "formula_id", "table_id", "term_id", "target_id")
ANCHORS = ("title", "heading", "section_heading", "formula_id", "table_id", "term", "target_id", "doc_id", "file_url")
LEAST_ANCHOR = 4


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _labels(lists: Column) -> Column:
    """The distinct elements of semicolon lists, in lower case."""
    parts = F.flatten(F.transform(lists, lambda x: F.split(F.coalesce(x, F.lit("")), ";")))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.lower(_strip(p))), lambda p: p != ""))


# --- retrieval ----------------------------------------------------------------------------


def judge_retrieval(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """case_id, hits, category_hits, n_categories, total_retrieved, doc_met, passed.

    ``cases`` has case_id, expected_doc_ids, expected_categories, min_hits and top_k;
    ``retrieved`` has case_id, rank (from 1), doc_id and category.  A case that expects
    categories only passes with any of them.
    """
    wanted = cases.select("case_id", F.array_distinct(_list("expected_doc_ids")).alias("ids"), _labels(_list("expected_categories")).alias("cats"), F.coalesce("min_hits", F.lit(1)).alias("min_hits"), F.coalesce("top_k", F.lit(5)).alias("top_k"))
    near = retrieved.join(wanted.select("case_id", "top_k"), "case_id").filter(F.col("rank") <= F.col("top_k"))
    got = near.groupBy("case_id").agg(F.count("*").alias("n"), F.collect_set("doc_id").alias("got_ids"), F.collect_set("category").alias("got_cats"))
    j = wanted.join(got, "case_id", "left")
    hits = F.size(F.array_intersect("ids", _list("got_ids")))
    category_hits = F.size(F.array_intersect("cats", _labels(_list("got_cats"))))
    by_docs = F.col("hits") >= F.col("min_hits")
    judged = j.select("case_id", hits.alias("hits"), category_hits.alias("category_hits"), F.size("cats").alias("n_categories"), F.coalesce("n", F.lit(0)).alias("total_retrieved"), "min_hits", (F.size("ids") == 0).alias("no_ids"))
    passed = F.when(F.col("no_ids") & (F.col("n_categories") > 0), F.col("category_hits") > 0).otherwise(by_docs)
    return judged.select("case_id", "hits", "category_hits", "n_categories", "total_retrieved", (F.col("no_ids") | by_docs).alias("doc_met"), passed.alias("passed"))


def retrieval_report(judged: DataFrame, *by: str) -> DataFrame:
    """total_cases, passed, failed, doc_hit_rate, category_hit_rate; of all or by columns."""
    true = lambda c: F.count(F.when(F.col(c), 1))
    return judged.groupBy(*by).agg(
        F.count("*").alias("total_cases"),
        true("passed").alias("passed"),
        (F.count("*") - true("passed")).alias("failed"),
        F.coalesce(F.try_divide(true("doc_met"), F.count("*")), F.lit(0.0)).alias("doc_hit_rate"),
        F.coalesce(F.try_divide(F.sum("category_hits"), F.sum("n_categories")), F.lit(0.0)).alias("category_hit_rate"),
    )


# --- answers ------------------------------------------------------------------------------


class _Items:
    """Pieces of evidence: a list of structs with any of the known fields."""

    def __init__(self, df: DataFrame, c: str) -> None:
        kind = df.schema[c].dataType
        self.c, self.names = F.coalesce(F.col(c), F.array().cast(kind)), set(kind.elementType.names)

    def text(self, item: Column, field: str) -> Column:
        return _strip(item[field]) if field in self.names else F.lit("")

    def doc(self, item: Column) -> Column:
        """The document: its id, else its url."""
        own = F.coalesce(item["doc_id"].cast("string"), F.lit("")) if "doc_id" in self.names else F.lit("")
        return F.when(own != "", _strip(own)).otherwise(self.text(item, "file_url"))

    def sources(self, item: Column) -> Column:
        listed = F.coalesce(item["sources"], F.array().cast("array<string>")) if "sources" in self.names else F.array().cast("array<string>")
        return F.array_distinct(F.filter(F.transform(F.concat(listed, F.array(self.text(item, "source"))), _strip), lambda x: x != ""))

    def matching(self, ids: Column, sources: Column, items: Column | None = None) -> Column:
        """Those of an expected document, where any is expected, and from an expected source, where any is."""

        def fits(item: Column) -> Column:
            return ((F.size(ids) == 0) | F.array_contains(ids, self.doc(item))) & ((F.size(sources) == 0) | F.arrays_overlap(self.sources(item), sources))

        return F.filter(self.c if items is None else items, fits)


def judge_answers(cases: DataFrame) -> DataFrame:
    """Adds evidence_hits, evidence_source_hits, total_evidence, citation_coverage, citable_evidence, refused_no_evidence, unsupported_answer, passed.

    ``cases`` has the expectations (expected_evidence_doc_ids, expected_evidence_sources,
    expected_citation_sources, forbidden_answer_terms, expect_no_evidence,
    min_evidence_hits) and the response (answer, evidence, citations).
    """
    ids, sources = F.array_distinct(_list("expected_evidence_doc_ids")), F.array_distinct(_list("expected_evidence_sources"))
    cited = F.array_distinct(_list("expected_citation_sources"))
    cited = F.when(F.size(cited) > 0, cited).otherwise(sources)
    required = F.when(F.size(sources) > 0, sources).otherwise(cited)
    ev, ci = _Items(cases, "evidence"), _Items(cases, "citations")

    found = ev.matching(ids, required)
    hits = F.when(F.size(ids) > 0, F.size(F.array_intersect(F.transform(found, ev.doc), ids))).otherwise(F.size(found))
    source_hits = F.size(F.array_intersect(F.flatten(F.transform(found, ev.sources)), sources))

    def citable(item: Column) -> Column:
        named = F.lit(False)
        for f in IDENTITY:
            named = named | (ci.text(item, f) != "")
        return named & (F.size(ci.sources(item)) > 0)

    citing = F.filter(ci.matching(ids, cited), citable)
    both = F.flatten(F.transform(citing, lambda x: F.transform(F.array_intersect(ci.sources(x), cited), lambda s: F.struct(ci.doc(x).alias("d"), s.alias("s")))))
    of_ids = F.array_intersect(F.transform(citing, ci.doc), ids)
    of_sources = F.array_intersect(F.flatten(F.transform(citing, ci.sources)), cited)
    n_ids, n_cited = F.size(ids), F.size(cited)
    reached = F.when((n_ids > 0) & (n_cited > 0), F.size(F.array_distinct(both))).when(n_ids > 0, F.size(of_ids)).otherwise(F.size(of_sources))
    expected = F.when((n_ids > 0) & (n_cited > 0), n_ids * n_cited).otherwise(n_ids + n_cited)
    coverage = F.coalesce(F.try_divide(reached, expected), F.lit(1.0))

    answer = F.coalesce("answer", F.lit(""))
    low = F.lower(answer)

    def anchored(item: Column) -> Column:
        out = F.lit(False)
        for f in ANCHORS:
            value = ev.text(item, f)
            out = out | ((F.length(value) >= LEAST_ANCHOR) & F.contains(low, F.lower(value)))
        return out

    empty = F.size(ev.c) == 0
    forbidden = F.exists(_list("forbidden_answer_terms"), lambda t: (t != "") & F.contains(low, F.lower(t)))
    unsupported = forbidden | (empty & (answer != NO_EVIDENCE)) | (~empty & ~F.exists(ev.c, anchored))
    rows = cases.select(
        "*", hits.alias("evidence_hits"), source_hits.alias("evidence_source_hits"), F.size(ev.c).alias("total_evidence"), coverage.cast("double").alias("citation_coverage"),
        F.size(citing).alias("citable_evidence"), (empty & (answer == NO_EVIDENCE)).alias("refused_no_evidence"), unsupported.alias("unsupported_answer"), F.size(sources).alias("_n_sources"),
    )
    refuses = F.col("refused_no_evidence") & ~F.col("unsupported_answer")
    answers = (F.col("evidence_hits") >= F.coalesce("min_evidence_hits", F.lit(1))) & (F.col("evidence_source_hits") >= F.col("_n_sources")) & (F.col("citation_coverage") >= 1.0) & ~F.col("unsupported_answer")
    return rows.withColumn("passed", F.when(F.coalesce("expect_no_evidence", F.lit(False)), refuses).otherwise(answers)).drop("_n_sources")


def answer_report(judged: DataFrame, *by: str) -> DataFrame:
    """total_cases, passed, failed, evidence_hit_rate, citation_coverage_rate, no_evidence_refusal_rate, unsupported_answer_rate; of all or by columns."""
    none = F.coalesce("expect_no_evidence", F.lit(False))
    true = lambda c: F.count(F.when(c, 1))
    rate = lambda n, of: F.coalesce(F.try_divide(n, of), F.lit(1.0))
    return judged.groupBy(*by).agg(
        F.count("*").alias("total_cases"),
        true(F.col("passed")).alias("passed"),
        (F.count("*") - true(F.col("passed"))).alias("failed"),
        rate(true(~none & (F.col("evidence_hits") >= F.coalesce("min_evidence_hits", F.lit(1)))), true(~none)).alias("evidence_hit_rate"),
        F.coalesce(F.avg(F.when(~none, F.col("citation_coverage"))), F.lit(1.0)).alias("citation_coverage_rate"),
        rate(true(none & F.col("refused_no_evidence")), true(none)).alias("no_evidence_refusal_rate"),
        F.coalesce(F.try_divide(true(F.col("unsupported_answer")), F.count("*")), F.lit(0.0)).alias("unsupported_answer_rate"),
    )


# --- smoke queries ------------------------------------------------------------------------


def assess_queries(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, passed, failure_reason, matched_doc_id, matched_file_url of smoke queries.

    ``results`` has query_id, status, failure_reason, evidence_count and references (structs
    of doc_id and file_url); ``catalog`` has doc_id and file_url.  A query passes if a
    reference is in the catalog; the first one counts.
    """
    known = ("query_execution_failed", "query_process_failed", "query_timed_out")
    failed = F.coalesce(F.col("status") != "ok", F.lit(True))
    empty = F.coalesce("evidence_count", F.lit(0)) <= 0
    asked = results.filter(~failed & ~empty).select("query_id", F.posexplode("references").alias("pos", "ref")).select("query_id", "pos", _strip(F.col("ref.doc_id")).alias("d"), _strip(F.col("ref.file_url")).alias("u"))
    by_doc = catalog.select(F.col("doc_id").alias("d")).distinct().withColumn("has_doc", F.lit(True))
    by_url = catalog.select(F.col("file_url").alias("u")).distinct().withColumn("has_url", F.lit(True))
    met = asked.join(by_doc, "d", "left").join(by_url, "u", "left").filter("has_doc OR has_url")
    first = met.groupBy("query_id").agg(F.min_by(F.struct(F.when(F.col("has_doc"), F.col("d")).otherwise("").alias("doc"), F.when(F.col("has_url"), F.col("u")).otherwise("").alias("url")), "pos").alias("hit"))
    reason = F.when(failed, F.when(F.col("failure_reason").isin(*known), F.col("failure_reason")).otherwise("query_process_failed")).when(empty, "no_evidence").when(F.col("hit").isNull(), "catalog_reference_missing").otherwise("")
    j = results.join(first, "query_id", "left")
    return j.select("query_id", (reason == "").alias("passed"), reason.alias("failure_reason"), F.coalesce("hit.doc", F.lit("")).alias("matched_doc_id"), F.coalesce("hit.url", F.lit("")).alias("matched_file_url"))
