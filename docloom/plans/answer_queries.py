"""Queries over results and answers: duplicate removal, citations, evidence, and the evaluation of cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import answers, evaluation
from docloom.plans import bindings as b
from docloom.plans.registry import query

# --- greedy removal -----------------------------------------------------------------------

_W = "list_distinct(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"
_SIM = f"""CASE WHEN {{a}} = '' OR {{b}} = '' THEN 0.0 WHEN contains({{a}}, {{b}}) OR contains({{b}}, {{a}}) THEN least(length({{a}}), length({{b}})) / greatest(length({{a}}), length({{b}}))
 ELSE len(list_intersect({_W.format('{a}')}, {_W.format('{b}')})) / len(list_distinct(list_concat({_W.format('{a}')}, {_W.format('{b}')}))) END"""


def _fold_sql(source: str, k: int, above: float) -> str:
    """A recursive walk over each query's first k results that carries the texts kept so far."""
    sim = _SIM.format(a="o", b="c.text")
    return f"""WITH RECURSIVE c AS (SELECT * FROM ({source}) WHERE place <= {k}),
 r AS (SELECT DISTINCT q, CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS kept, FALSE AS keep FROM c
  UNION ALL SELECT c.q, c.place, CASE WHEN len(list_filter(r.kept, lambda o: {sim} > {above})) = 0 THEN list_append(r.kept, c.text) ELSE r.kept END, len(list_filter(r.kept, lambda o: {sim} > {above})) = 0 FROM r JOIN c ON c.q = r.q AND c.place = r.place + 1)
 SELECT q, CAST(place AS INT) AS place FROM r WHERE keep"""


_TURNS = "SELECT conv_id AS q, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations"
# the first turn again before every second one, so that there is something to remove
_TWICE = "SELECT q, text, row_number() OVER (PARTITION BY q ORDER BY turn, part) AS place FROM (SELECT conv_id AS q, turn, 1 AS part, text FROM conversations UNION ALL SELECT c.conv_id, c.turn, 0, CASE WHEN c.turn % 4 = 1 THEN f.text ELSE f.text || ' more' END FROM conversations c JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0 WHERE c.turn % 2 = 1)"


@query("txt18_greedy_removal", _fold_sql(_TWICE, 9, 0.95))
def _greedy(spark, d):
    c = b.raw(spark, d, "conversations").select(F.col("conv_id").alias("q"), "turn", F.lit(1).alias("part"), "text")
    first = c.filter("turn = 0").select("q", F.col("text").alias("f"))
    again = c.filter("turn % 2 = 1").join(first, "q").select("q", "turn", F.lit(0).alias("part"), F.when(F.col("turn") % 4 == 1, F.col("f")).otherwise(F.concat("f", F.lit(" more"))).alias("text"))
    return answers.without_similar(c.unionByName(again), "q", [F.col("turn"), F.col("part")], "text", 9).select("q", "place")


@query("joi18_greedy_by_words", _fold_sql(_TURNS, 50, 0.06))
def _by_words(spark, d):
    c = b.raw(spark, d, "conversations").select(F.col("conv_id").alias("q"), "turn", "text")
    return answers.without_similar(c, "q", [F.col("turn")], "text", 50, 0.06).select("q", "place")


# --- citations and evidence ---------------------------------------------------------------

_RESULTS = """SELECT lang AS q, CASE WHEN id % 4 = 0 THEN '' ELSE 'f' || (id % 7) END AS filename, CASE WHEN id % 3 = 0 THEN 'u' || (id % 5) END AS file_url, CASE WHEN id % 8 <> 4 THEN 'c' || (id % 9) END AS chunk_id, bytes % 97 AS score, id, text FROM files"""


@query("vec10_serialized_citations", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place FROM ({_RESULTS})), k AS (SELECT *, coalesce(nullif(file_url, ''), nullif(filename, ''), nullif(chunk_id, ''), '#' || place) AS source FROM r WHERE place <= 50),
 o AS (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY place) AS rn FROM k) SELECT q, CAST(place AS INT) AS place, coalesce(filename, '') AS filename, coalesce(file_url, '') AS file_url, coalesce(chunk_id, '') AS chunk_id, score AS similarity_score, trim(substring(text, 1, 280), ' ' || chr(10) || chr(9) || chr(13)) AS quote FROM o WHERE rn = 1""")  # fmt: skip
def _citations(spark, d):
    i = F.col("id")
    name = lambda c, n: F.concat(F.lit(c), (i % n).cast("string"))
    rows = b.files(spark, d).select(
        F.col("lang").alias("q"), F.when(i % 4 == 0, "").otherwise(name("f", 7)).alias("filename"), F.when(i % 3 == 0, name("u", 5)).alias("file_url"), F.when(i % 8 != 4, name("c", 9)).alias("chunk_id"),
        (F.col("bytes") % 97).alias("similarity_score"), "id", F.col("text").alias("content"), F.lit("kb").alias("kb_id"), F.lit(None).cast("string").alias("kb_name"),
    )
    return answers.citations(rows, "q", [F.desc("similarity_score"), F.col("id")]).select("q", "place", "filename", "file_url", "chunk_id", "similarity_score", "quote")


@query("str26_evidence_blocks", """SELECT id, CASE WHEN trim(t) <> '' THEN trim(t) WHEN id % 2 = 0 THEN source_site ELSE 'Agentic evidence' END AS shown_as, CASE WHEN id % 6 = 0 THEN trim(h) ELSE 'has_section ' || id END AS shown_text, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 0.5 + id ELSE NULL END AS shown_score, CASE WHEN id % 5 = 0 THEN url ELSE 'd' || id END AS shown_url
 FROM (SELECT *, CASE WHEN id % 4 = 0 THEN '  ' ELSE lang END AS t, ' ' || lang || ' ' AS h FROM files)""")  # fmt: skip
def _blocks(spark, d):
    i = F.col("id")
    text = i.cast("string")
    e = b.files(spark, d).select(
        "id", F.when(i % 4 == 0, "  ").otherwise(F.col("lang")).alias("title"), F.when(i % 2 == 0, F.col("source_site")).alias("source"), F.when(i % 6 == 0, F.concat(F.lit(" "), "lang", F.lit(" "))).alias("summary"),
        F.lit("has_section").alias("relation_type"), F.lit(None).cast("string").alias("target_type"), text.alias("target_id"), F.when(i % 5 == 0, F.col("url")).alias("file_url"), F.concat(F.lit("d"), text).alias("source_url"),
        F.when(i % 3 == 0, "-1.5").when(i % 3 == 1, F.concat(text, F.lit(".5"))).otherwise("high").alias("score"),
    )
    return answers.evidence_blocks(e, "kb").select("id", "shown_as", "shown_text", "shown_score", "shown_url")


@query("str24_bounded_text", "SELECT doc_id, rtrim(substring(regexp_replace(trim(nfkc, ' ' || chr(10) || chr(9)), '\\s+', ' ', 'g'), 1, 60)) AS head FROM (SELECT doc_id, 'ﬁt ' || chr(10) || ' ' || nfc_normalize(text) AS t, 'fit ' || chr(10) || ' ' || nfc_normalize(text) AS nfkc FROM documents)")
def _bounded(spark, d):
    return b.raw(spark, d, "documents").select("doc_id", answers.bounded_text(F.concat(F.lit("ﬁt \n "), "text"), 60).alias("head"))


# --- evaluation of retrieval --------------------------------------------------------------
# A case a source: its first and last file and one that isn't there are expected, the largest files come.

_CASES = """cases AS (SELECT source_site AS case_id, CASE WHEN ends_with(source_site, '3') THEN CAST([] AS VARCHAR[]) ELSE ['doc://' || min(id), 'doc://' || max(id), 'nowhere'] END AS ids,
  CASE WHEN ends_with(source_site, '1') OR ends_with(source_site, '3') THEN ['ai', 'risk & capital', 'none'] ELSE CAST([] AS VARCHAR[]) END AS cats, CASE WHEN ends_with(source_site, '2') THEN 2 ELSE 1 END AS min_hits FROM files GROUP BY source_site),
 got AS (SELECT source_site AS case_id, url AS doc_id, category, row_number() OVER (PARTITION BY source_site ORDER BY bytes DESC, id) AS rank FROM files f LEFT JOIN catalog c ON c.file_url = f.url),
 near AS (SELECT * FROM got WHERE rank <= 7),
 judged AS (SELECT case_id, (SELECT count(DISTINCT doc_id) FROM near n WHERE n.case_id = x.case_id AND list_contains(x.ids, n.doc_id)) AS hits,
  (SELECT count(DISTINCT lower(trim(part))) FROM (SELECT unnest(string_split(category, ';')) AS part FROM near n WHERE n.case_id = x.case_id) WHERE list_contains(x.cats, lower(trim(part)))) AS category_hits,
  len(cats) AS n_categories, (SELECT count(*) FROM near n WHERE n.case_id = x.case_id) AS total_retrieved, len(ids) = 0 AS no_ids, min_hits FROM cases x),
 results AS (SELECT case_id, hits, category_hits, n_categories, total_retrieved, no_ids OR hits >= min_hits AS doc_met, CASE WHEN no_ids AND n_categories > 0 THEN category_hits > 0 ELSE hits >= min_hits END AS passed FROM judged)"""


def _judged(spark, d):
    f = b.files(spark, d).join(b.catalog(spark, d).select(F.col("file_url").alias("url"), "category"), "url", "left")
    site, none = F.col("source_site"), F.array().cast("array<string>")
    doc = lambda c: F.concat(F.lit("doc://"), c.cast("string"))
    ends = lambda *xs: F.substring(site, -1, 1).isin(*xs)
    cases = b.files(spark, d).groupBy("source_site").agg(F.array(doc(F.min("id")), doc(F.max("id")), F.lit("nowhere")).alias("e")).select(
        site.alias("case_id"), F.when(ends("3"), none).otherwise(F.col("e")).alias("expected_doc_ids"), F.when(ends("1", "3"), F.array(F.lit("AI; risk & Capital "), F.lit("None"))).otherwise(none).alias("expected_categories"), F.when(ends("2"), 2).otherwise(1).alias("min_hits"), F.lit(7).alias("top_k")
    )
    found = answers.top(f, "source_site", [F.desc("bytes"), F.col("id")], 20).select(site.alias("case_id"), F.col("place").alias("rank"), F.col("url").alias("doc_id"), "category")
    return evaluation.judge_retrieval(cases, found)


@query("srh15_retrieval_cases", f"WITH {_CASES} SELECT case_id, hits, category_hits, n_categories, total_retrieved, doc_met, passed FROM results")
def _retrieval(spark, d):
    return _judged(spark, d)


@query("agg16_retrieval_report", f"WITH {_CASES} SELECT count(*) AS total_cases, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (doc_met) / count(*), 6) AS doc_hit_rate, round(sum(category_hits) / sum(n_categories), 6) AS category_hit_rate FROM results")
def _report(spark, d):
    return evaluation.retrieval_report(_judged(spark, d)).withColumns({c: F.round(c, 6) for c in ("doc_hit_rate", "category_hit_rate")})


# --- evaluation of answers ----------------------------------------------------------------
# A case a file: it and the next one come as evidence, under sources that turn with the id.


def _answer_cases(spark, d):
    i = F.col("id")
    doc = lambda k: F.concat(F.lit("doc://"), (i + k).cast("string"))
    kind = "array<struct<doc_id:string,file_url:string,title:string,heading:string,source:string,sources:array<string>>>"
    text = lambda x: x.cast("string")
    null = F.lit(None).cast("string")
    one = F.struct(doc(0).alias("doc_id"), null.alias("file_url"), F.concat(F.lit(" Title "), text(i)).alias("title"), null.alias("heading"), F.lit("titles").alias("source"), F.array(F.lit("summaries"), F.lit(" ")).alias("sources"))
    two = F.struct(F.lit("").alias("doc_id"), doc(1).alias("file_url"), null.alias("title"), F.concat(F.lit("Part "), text(i)).alias("heading"), F.when(i % 4 == 0, "").otherwise("sections").alias("source"), F.array().cast("array<string>").alias("sources"))
    none, arr = F.array().cast("array<string>"), lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    rows = b.files(spark, d).select(
        "id", "lang", "source_site",
        F.when(i % 5 == 0, none).when(i % 5 == 1, arr(doc(0))).otherwise(arr(doc(0), doc(1))).alias("expected_evidence_doc_ids"),
        F.when(i % 3 == 0, none).when(i % 3 == 1, arr("titles")).otherwise(arr("summaries", "sections")).alias("expected_evidence_sources"),
        F.when(i % 7 == 0, arr("titles", "sections")).otherwise(none).alias("expected_citation_sources"),
        F.when(i % 6 == 0, arr("", "SECRET")).alias("forbidden_answer_terms"),
        (i % 11 < 3).alias("expect_no_evidence"),
        F.when(i % 2 == 0, 1).otherwise(2).alias("min_evidence_hits"),
        F.when(i % 11 < 2, F.array().cast(kind)).when(i % 13 == 0, F.array(one).cast(kind)).otherwise(F.array(one, two).cast(kind)).alias("evidence"),
        F.when(i % 11 < 2, F.array().cast(kind)).when(i % 10 == 0, F.array(two).cast(kind)).otherwise(F.array(one, two).cast(kind)).alias("citations"),
        F.when((i % 11 < 2) & (i % 4 != 0), evaluation.NO_EVIDENCE).when(i % 12 == 0, "a Secret of title").when(i % 8 == 3, "no anchor at all").otherwise(F.concat(F.lit("As TITLE "), text(i), F.lit(" says"))).alias("answer"),
    )
    return evaluation.judge_answers(rows.withColumn("case_id", F.col("id")))


_ANSWERS = f"""a AS (SELECT id, lang, CASE WHEN id % 5 = 0 THEN CAST([] AS VARCHAR[]) WHEN id % 5 = 1 THEN ['doc://' || id] ELSE ['doc://' || id, 'doc://' || (id + 1)] END AS ids,
  CASE id % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['titles'] ELSE ['summaries', 'sections'] END AS src, CASE WHEN id % 7 = 0 THEN ['titles', 'sections'] ELSE CAST([] AS VARCHAR[]) END AS cit0, id % 6 = 0 AS forbids, id % 11 < 3 AS none, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS least_hits,
  CASE WHEN id % 11 < 2 THEN 0 WHEN id % 13 = 0 THEN 1 ELSE 2 END AS n, id % 11 >= 2 AND id % 10 <> 0 AS cites_one, id % 11 >= 2 AS cites_two,
  CASE WHEN id % 11 < 2 AND id % 4 <> 0 THEN '{evaluation.NO_EVIDENCE}' WHEN id % 12 = 0 THEN 'a Secret of title' WHEN id % 8 = 3 THEN 'no anchor at all' ELSE 'As TITLE ' || id || ' says' END AS answer FROM files),
 q AS (SELECT *, CASE WHEN len(cit0) > 0 THEN cit0 ELSE src END AS cit FROM a), p AS (SELECT *, CASE WHEN len(src) > 0 THEN src ELSE cit END AS req FROM q),
 ev AS (SELECT id, 'doc://' || id AS doc, ['titles', 'summaries'] AS ss, TRUE AS one FROM p UNION ALL SELECT id, 'doc://' || (id + 1), CASE WHEN id % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['sections'] END, FALSE FROM p),
 m AS (SELECT p.id, ev.doc, ev.ss, list_contains(ids, ev.doc) AS by_id, CASE WHEN one THEN n >= 1 ELSE n >= 2 END AS is_ev, CASE WHEN one THEN cites_one ELSE cites_two END AS is_cit,
  (len(ids) = 0 OR list_contains(ids, ev.doc)) AND (len(req) = 0 OR list_has_any(ev.ss, req)) AS fits, (len(ids) = 0 OR list_contains(ids, ev.doc)) AND (len(cit) = 0 OR list_has_any(ev.ss, cit)) AS fits_cit FROM p JOIN ev ON ev.id = p.id),
 f AS (SELECT p.id, lang, none, least_hits, n, answer, forbids, src, CASE WHEN len(ids) > 0 THEN (SELECT count(DISTINCT doc) FROM m WHERE m.id = p.id AND is_ev AND fits AND by_id) ELSE (SELECT count(*) FROM m WHERE m.id = p.id AND is_ev AND fits) END AS evidence_hits,
  (SELECT count(DISTINCT s) FROM (SELECT unnest(ss) AS s FROM m WHERE m.id = p.id AND is_ev AND fits) WHERE list_contains(p.src, s)) AS evidence_source_hits,
  (SELECT count(*) FROM m WHERE m.id = p.id AND is_cit AND fits_cit AND len(ss) > 0) AS citable_evidence,
  CASE WHEN len(ids) = 0 AND len(cit) = 0 THEN 1.0 WHEN len(cit) = 0 THEN (SELECT count(DISTINCT doc) FROM m WHERE m.id = p.id AND is_cit AND fits_cit AND len(ss) > 0 AND by_id) / len(ids)
   WHEN len(ids) = 0 THEN (SELECT count(DISTINCT s) FROM (SELECT unnest(ss) AS s FROM m WHERE m.id = p.id AND is_cit AND fits_cit) WHERE list_contains(p.cit, s)) / len(cit)
   ELSE (SELECT count(DISTINCT (doc, s)) FROM (SELECT doc, unnest(ss) AS s FROM m WHERE m.id = p.id AND is_cit AND fits_cit) WHERE list_contains(p.cit, s)) / (len(ids) * len(cit)) END AS citation_coverage FROM p),
 g AS (SELECT *, n = 0 AND answer = '{evaluation.NO_EVIDENCE}' AS refused, (forbids AND contains(lower(answer), 'secret')) OR (n = 0 AND answer <> '{evaluation.NO_EVIDENCE}') OR (n > 0 AND NOT starts_with(answer, 'As TITLE')) AS unsupported FROM f),
 r AS (SELECT *, CASE WHEN none THEN refused AND NOT unsupported ELSE evidence_hits >= least_hits AND evidence_source_hits >= len(src) AND citation_coverage >= 1 AND NOT unsupported END AS passed FROM g)"""


@query("srh15_answer_cases", f"WITH {_ANSWERS} SELECT id, evidence_hits, evidence_source_hits, n AS total_evidence, citable_evidence, round(citation_coverage, 6) AS citation_coverage, refused AS refused_no_evidence, unsupported AS unsupported_answer, passed FROM r")
def _answers(spark, d):
    j = _answer_cases(spark, d)
    return j.select("id", "evidence_hits", "evidence_source_hits", "total_evidence", "citable_evidence", F.round("citation_coverage", 6).alias("citation_coverage"), "refused_no_evidence", "unsupported_answer", "passed")


@query("agg17_answer_report", f"""WITH {_ANSWERS} SELECT lang, count(*) AS total_cases, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (NOT none AND evidence_hits >= least_hits) / count(*) FILTER (NOT none), 6) AS evidence_hit_rate, round(avg(citation_coverage) FILTER (NOT none), 6) AS citation_coverage_rate,
 round(count(*) FILTER (none AND refused) / count(*) FILTER (none), 6) AS no_evidence_refusal_rate, round(count(*) FILTER (unsupported) / count(*), 6) AS unsupported_answer_rate FROM r GROUP BY lang""")  # fmt: skip
def _answer_report(spark, d):
    rates = ("evidence_hit_rate", "citation_coverage_rate", "no_evidence_refusal_rate", "unsupported_answer_rate")
    return evaluation.answer_report(_answer_cases(spark, d), "lang").withColumns({c: F.round(c, 6) for c in rates})


# --- smoke queries ------------------------------------------------------------------------


@query("fil24_smoke_verdicts", """WITH r AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN id % 18 = 0 THEN 'query_timed_out' WHEN id % 27 = 0 THEN 'odd' END AS why, id % 4 AS n, url FROM files), k AS (SELECT file_url FROM catalog WHERE status = 'ok')
 SELECT id AS query_id, reason = '' AS passed, reason AS failure_reason, CASE WHEN reason = '' AND n % 2 = 1 THEN url ELSE '' END AS matched_doc_id, CASE WHEN reason = '' AND n % 2 = 0 THEN url ELSE '' END AS matched_file_url
 FROM (SELECT *, CASE WHEN status <> 'ok' THEN CASE WHEN why = 'query_timed_out' THEN why ELSE 'query_process_failed' END WHEN n = 0 THEN 'no_evidence' WHEN url IN (SELECT file_url FROM k) THEN '' ELSE 'catalog_reference_missing' END AS reason FROM r)""")  # fmt: skip
def _smoke(spark, d):
    i = F.col("id")
    null, ref = F.lit(None).cast("string"), lambda x, y: F.struct(x.alias("doc_id"), y.alias("file_url"))
    refs = F.array(ref(F.lit(" nowhere "), null), F.when(i % 4 % 2 == 1, ref(F.col("url"), F.lit("x"))).otherwise(ref(F.lit(""), F.concat(F.lit(" "), "url"))))
    results = b.files(spark, d).select(i.alias("query_id"), F.when(i % 9 == 0, "error").otherwise("ok").alias("status"), F.when(i % 18 == 0, "query_timed_out").when(i % 27 == 0, "odd").alias("failure_reason"), (i % 4).alias("evidence_count"), refs.alias("references"))
    known = b.catalog(spark, d).filter("status = 'ok'").select(F.col("file_url").alias("doc_id"), "file_url")
    return evaluation.assess_queries(results, known)
