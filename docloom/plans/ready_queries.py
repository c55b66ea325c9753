"""Queries over ready-data artifacts that are built from Markdown documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import ready
from docloom.plans import bindings as b
from docloom.plans.registry import query

_EDGE = r"[^\p{L}\p{N}_]"
_SNIPPET = "(CASE WHEN length({0}) <= 480 THEN {0} ELSE rtrim(substring({0}, 1, 477)) || '...' END)"
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def _secs(spark, d):
    return ready.sections(b.markdown(spark, d))


def _has(text: str, tokens: str, weight: float) -> str:
    return " + ".join(f"CASE WHEN contains(lower(coalesce({text}, '')), '{t}') THEN {weight} ELSE 0 END" for t in tokens.split())


def _spotted(text: str) -> str:
    each = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i)(^|{_EDGE}){p}($|{_EDGE})') THEN '{label}' END" for label, p in ready.TERMS)
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


@query("str09_heading_paths", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ['Markdown'] ELSE [source_site, lang] END AS headings FROM markdown")
def _paths(spark, d):
    return b.markdown(spark, d).select("doc_id", ready.heading_path(F.col("md")).alias("headings"))


@query("srh11_win09_sections", "SELECT section_id, heading, text, md5(text) AS digest FROM md_sections")
def _sections(spark, d):
    return _secs(spark, d).select("section_id", "heading", "text", F.md5("text").alias("digest"))


@query("srh11_str10_formulas", "SELECT formula_id, section_id, heading, formula_text, context, terms FROM md_formulas")
def _formulas(spark, d):
    return ready.formula_cards(_secs(spark, d)).select("formula_id", "section_id", "heading", "formula_text", "context", "terms")


@query("str11_arr04_tables", "SELECT table_id, heading, headers, rows, 'Term Value term_2 reserve ' || rows[1][2] || '  v x ' || rows[2][3] AS text, 'reserve ' || rows[1][2] || ' v x ' || rows[2][3] AS cells FROM md_tables")
def _tables(spark, d):
    return ready.structured_tables(_secs(spark, d)).select("table_id", "heading", "headers", "rows", "text", ready.rows_text(F.col("rows")).alias("cells"))


@query("str12_calculation_terms", f"SELECT section_id || '#term-' || n AS term_id, term, lower(term) AS normalized_term FROM (SELECT section_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS n FROM (SELECT section_id, {_spotted('text')} AS t FROM md_sections))")
def _terms(spark, d):
    return ready.calculation_terms(_secs(spark, d)).select("term_id", "term", "normalized_term")


@query("srh04_search_formulas", f"SELECT formula_id, CAST(score AS DOUBLE) AS score FROM (SELECT formula_id, title, {_has('formula_text', 'net premium en', 6)} + {_has('array_to_string(terms, chr(32))', 'net premium en', 5)} + {_has('heading', 'net premium en', 3)} + {_has('context', 'net premium en', 1.5)} + {_has('title', 'net premium en', 1)} + CASE WHEN contains(lower(formula_text || ' ' || context), 'net premium en') THEN 4 ELSE 0 END AS score FROM md_formulas) WHERE score > 0 ORDER BY score DESC, lower(title), formula_id LIMIT 25")
def _search_formulas(spark, d):
    return ready.search_formulas(ready.formula_cards(_secs(spark, d)), "net premium EN", 25).select("formula_id", "score")


@query("srh05_search_tables", f"SELECT table_id, CAST(score AS DOUBLE) AS score FROM (SELECT table_id, title, {_has('array_to_string(headers, chr(32))', 'v x 12', 4)} + {_has('cells', 'v x 12', 4)} + {_has('heading', 'v x 12', 2)} + {_has('text', 'v x 12', 1)} + CASE WHEN contains(lower(concat_ws(' ', '', heading, 'Term Value term_2', cells, text)), 'v x 12') THEN 4 ELSE 0 END AS score FROM (SELECT *, 'Term Value term_2 reserve ' || rows[1][2] || '  v x ' || rows[2][3] AS text, 'reserve ' || rows[1][2] || ' v x ' || rows[2][3] AS cells FROM md_tables)) WHERE score > 0 ORDER BY score DESC, lower(title), table_id LIMIT 25")
def _search_tables(spark, d):
    return ready.search_tables(ready.structured_tables(_secs(spark, d)), "v x 12", 25).select("table_id", "score")


@query("srh06_search_terms", f"""WITH t AS (SELECT section_id || '#term-' || n AS term_id, term, title, heading, {_SNIPPET.format('flat')} AS context FROM (SELECT section_id, title, heading, {_FLAT} AS flat, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS n FROM (SELECT *, {_spotted('text')} AS t FROM md_sections)))
 SELECT term_id, CAST(score AS DOUBLE) AS score FROM (SELECT term_id, term, {_has("term || ' ' || lower(term)", 'net premium', 8)} + {_has('context', 'net premium', 2)} + {_has('heading', 'net premium', 1)} + {_has('title', 'net premium', 0.5)} + CASE WHEN contains(lower(term || ' ' || lower(term)), 'net premium') THEN 6 WHEN contains(lower(context), 'net premium') THEN 2 ELSE 0 END AS score FROM t) WHERE score > 0 ORDER BY score DESC, lower(term), term_id LIMIT 40""")  # fmt: skip
def _search_terms(spark, d):
    return ready.search_terms(ready.calculation_terms(_secs(spark, d)), "net premium", 40).select("term_id", "score")


@query("srh03_joi15_section_search", f"""WITH s AS (SELECT section_id, title, heading, text, array_to_string(list_distinct([title] || CASE doc_id % 3 WHEN 1 THEN [CAST(doc_id % 20 AS VARCHAR)] WHEN 0 THEN [CAST(doc_id AS VARCHAR)] ELSE [CAST(doc_id AS VARCHAR)] END || [CAST(doc_id AS VARCHAR)]), ' ') AS names FROM md_sections)
 SELECT section_id, CAST(score AS DOUBLE) AS score FROM (SELECT section_id, title, {_has('heading', 'guideline src1', 7)} + {_has('text', 'guideline src1', 1)} + {_has('title', 'guideline src1', 1)} + {_has('names', 'guideline src1', 4)} + CASE WHEN contains(lower(heading || ' ' || text), 'guideline src1') THEN 3 ELSE 0 END AS score FROM s) WHERE score > 0 ORDER BY score DESC, lower(title), section_id LIMIT 30""")  # fmt: skip
def _search_sections(spark, d):
    docs = b.markdown(spark, d)
    return ready.search_sections(ready.sections(docs), ready.aliases(docs), "guideline src1", 30).select("section_id", "score")


@query("str07_doc_aliases", """SELECT doc_id, [title] || ids AS aliases, ids AS identifiers, CASE WHEN doc_id % 3 = 2 THEN [CAST(doc_id AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS document_numbers, CASE WHEN doc_id % 3 = 1 THEN [CAST(doc_id % 20 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS rule_numbers
 FROM (SELECT *, CASE WHEN doc_id % 3 = 1 AND doc_id % 20 <> doc_id THEN [CAST(doc_id % 20 AS VARCHAR), CAST(doc_id AS VARCHAR)] ELSE [CAST(doc_id AS VARCHAR)] END AS ids FROM markdown)""")  # fmt: skip
def _aliases(spark, d):
    return ready.aliases(b.markdown(spark, d)).select("doc_id", "aliases", "identifiers", "document_numbers", "rule_numbers")


_NAMES = "CASE WHEN doc_id % 3 = 1 THEN [CAST(doc_id % 20 AS VARCHAR), CAST(doc_id AS VARCHAR)] ELSE [CAST(doc_id AS VARCHAR)] END"
_Q = "see guideline 9 src1 and article 7 in fr"


@query("str05_alias_scores", f"""WITH c AS (SELECT doc_id, lower(title) AS a, FALSE AS number FROM markdown UNION ALL SELECT doc_id, unnest({_NAMES}), TRUE FROM markdown),
 s AS (SELECT doc_id, CASE WHEN a = '{_Q}' THEN 100.0 WHEN number THEN CASE WHEN regexp_matches('{_Q}', '(^|[^A-Za-z0-9])' || a || '([^A-Za-z0-9]|$)') THEN 92.0 ELSE 0 END
  WHEN regexp_matches('{_Q}', '(^|{_EDGE})' || regexp_escape(a) || '({_EDGE}|$)') THEN 88.0 + least(length(a), {len(_Q)}) / greatest(length(a), {len(_Q)})
  WHEN regexp_matches(a, '(^|{_EDGE}){_Q}({_EDGE}|$)') THEN 80.0 + least(length(a), {len(_Q)}) / greatest(length(a), {len(_Q)}) ELSE 0 END AS score FROM c)
 SELECT doc_id, round(CAST(max(score) AS DOUBLE), 4) AS score FROM s GROUP BY doc_id""")  # fmt: skip
def _alias_scores(spark, d):
    return ready.alias_match(ready.aliases(b.markdown(spark, d)), _Q).select("doc_id", "score")


@query("srh02_search_titles", f"""WITH m AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'Markdown' ELSE source_site || ' ' || lang END AS headings, CASE WHEN lower(title) = 'article 7 in en' THEN 100.0 WHEN doc_id % 3 = 1 AND doc_id % 20 = 7 OR doc_id = 7 THEN 92.0 ELSE 0 END AS known FROM markdown),
 s AS (SELECT m.*, {_has('title', 'article 7 in en', 5)} + {_has('file_url', 'article 7 in en', 1)} + {_has('category', 'article 7 in en', 0.5)} + {_has('summary', 'article 7 in en', 0.5)} + {_has('headings', 'article 7 in en', 0.75)} + CASE WHEN contains(lower(title), 'article 7 in en') THEN 4 ELSE 0 END AS by_fields FROM m)
 SELECT doc_id, CAST(CASE WHEN known > 0 THEN known ELSE by_fields END AS DOUBLE) AS score, CASE WHEN known > 0 THEN 'title_aliases' ELSE 'doc_catalog' END AS source, CASE WHEN known = 100 THEN title WHEN known = 92 THEN '7' END AS matched_alias
 FROM s WHERE known > 0 OR by_fields > 0 ORDER BY known = 0, score DESC, lower(title), file_url LIMIT 60""")  # fmt: skip
def _search_titles(spark, d):
    docs = b.markdown(spark, d)
    return ready.search_titles(docs, ready.aliases(docs), "Article 7 in EN", 60).select("doc_id", "score", "source", "matched_alias")


_EDGES = f"""SELECT 'has_section' AS relation_type, CAST(doc_id AS VARCHAR) AS doc_id, file_url, title, NULL AS alias, section_id, heading AS section_heading, 'section' AS target_type, section_id AS target_id FROM md_sections
 UNION ALL SELECT 'alias_of', CAST(doc_id AS VARCHAR), file_url, title, unnest([title] || CASE WHEN doc_id % 3 = 1 AND doc_id % 20 <> doc_id THEN {_NAMES} ELSE [CAST(doc_id AS VARCHAR)] END), NULL, NULL, 'document', CAST(doc_id AS VARCHAR) FROM markdown"""


@query("srh11_relations", f"SELECT relation_type, doc_id, alias, section_id, target_type, target_id FROM ({_EDGES})")
def _relations(spark, d):
    docs = b.markdown(spark, d)
    return ready.relations(ready.sections(docs), ready.aliases(docs)).select("relation_type", "doc_id", "alias", "section_id", "target_type", "target_id")


@query("srh07_joi16_trace_relations", f"""WITH e AS ({_EDGES}), h AS (SELECT *, lower(concat_ws(' ', doc_id, file_url, title, coalesce(alias, ''), coalesce(section_id, ''), coalesce(section_heading, ''), target_id, target_type, relation_type)) AS hay FROM e),
 n AS (SELECT *, {_has('hay', 'guideline 12', 2)} + CASE WHEN contains(hay, 'guideline 12') THEN 5 ELSE 0 END AS score FROM h WHERE contains(hay, 'guideline') OR contains(hay, '12')),
 f AS (SELECT relation_type, target_id, min(doc_id) AS doc_id, 0.5 AS score FROM e WHERE doc_id IN (SELECT doc_id FROM n) AND (relation_type, target_id) NOT IN (SELECT (relation_type, target_id) FROM n) GROUP BY relation_type, target_id)
 SELECT relation_type, target_id, doc_id, CAST(score AS DOUBLE) AS score FROM (SELECT relation_type, target_id, doc_id, score FROM n UNION ALL SELECT * FROM f) ORDER BY score DESC, relation_type, target_id, doc_id LIMIT 100""")  # fmt: skip
def _trace(spark, d):
    docs = b.markdown(spark, d)
    return ready.trace(ready.relations(ready.sections(docs), ready.aliases(docs)), "guideline 12", 100)


@query("set03_srh12_dangling", """SELECT 'document twice' AS problem, CAST(doc_id AS VARCHAR) AS id FROM markdown WHERE doc_id % 100 = 3
 UNION ALL SELECT 'section without document', section_id FROM md_sections WHERE doc_id % 10 = 9 AND NOT (doc_id % 7 = 2 AND ends_with(section_id, '#section-1')) UNION ALL SELECT 'formula without section', formula_id FROM md_formulas WHERE doc_id % 7 = 2
 UNION ALL SELECT 'table without section', table_id FROM md_tables WHERE doc_id % 7 = 2 UNION ALL SELECT 'relation without document', section_id FROM md_sections WHERE doc_id % 10 = 9""")  # fmt: skip
def _problems(spark, d):
    whole = b.markdown(spark, d)
    docs = whole.filter("doc_id % 10 <> 9").unionByName(whole.filter("doc_id % 100 = 3"))
    all_ = ready.sections(whole)
    secs = all_.filter(~((F.col("doc_id") % 7 == 2) & F.col("section_id").endswith("#section-1")))
    edges = ready.relations(all_, ready.aliases(whole.limit(0)))
    return ready.problems(docs, secs, ready.formula_cards(all_), ready.structured_tables(all_), edges)


@query("srh08_tool_plan", """SELECT item_id, CASE WHEN contains(lower(text), 'summar') OR contains(lower(text), 'overview') THEN ['summaries', 'sections', 'titles'] WHEN contains(lower(text), 'where') OR contains(lower(text), 'locate') OR contains(lower(text), 'find') THEN ['titles', 'sections', 'summaries']
 WHEN contains(lower(text), 'list') OR contains(lower(text), 'catalog') OR contains(lower(text), 'which documents') THEN ['titles', 'summaries', 'sections'] ELSE ['sections', 'formulas', 'tables', 'terms', 'relations', 'titles', 'summaries'] END AS tools FROM benchmark""")  # fmt: skip
def _plan(spark, d):
    from docloom.operators import evidence, textpipe

    there = {"summaries", "titles", "sections", "formulas", "tables", "terms", "relations"}
    kind = textpipe.classify_question(F.col("text"))
    plans = F.create_map(*[x for c in ("summary", "locate", "catalog", "document_qa") for x in (F.lit(c), F.array(*[F.lit(t) for t in evidence.plan_steps(c, there)]))])
    return b.raw(spark, d, "benchmark").select("item_id", plans[kind].alias("tools"))
