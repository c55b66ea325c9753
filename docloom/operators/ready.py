"""Structured ready-data artifacts of Markdown documents, and evidence search over them.

Documents have doc_id, file_url, title, category, source_site and md.  Sections, formulas,
tables, terms and relations are rows of their own tables, keyed by their section.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import field_score, let, query_tokens, snippet, word_count

# Labels and patterns of calculation terms, in order.
TERMS = (
    ("Net Premium", r"net\s+premium"),
    ("Gross Premium", r"gross\s+premium"),
    ("PV Benefits", r"pv\s+benefits"),
    ("PV Premiums", r"pv\s+premiums"),
    ("present value", r"present\s+value"),
    ("mortality rate", r"mortality\s+rate"),
    ("discount rate", r"discount\s+rate"),
    ("discount factor", r"discount\s+factor"),
    ("cash flow", r"cash\s+flow"),
    ("reserve", r"reserve"),
    ("premium", r"premium"),
    ("benefit", r"benefit"),
    ("BEL", r"bel"),
    ("SCR", r"scr"),
    ("q_x", r"q_x"),
    ("v", r"v"),
)
_HEADING = r"(?m)^[ \t]{0,3}#{1,6}[ \t]+(.+?)[ \t]*$"
_WORD = r"\p{L}\p{N}_"


# --- artifacts ----------------------------------------------------------------------------


def heading_path(md: Column) -> Column:
    """The first two headings, else ['Markdown']."""
    found = F.slice(F.regexp_extract_all(md, F.lit(_HEADING), 1), 1, 2)
    return let(found, lambda f: F.when(F.size(f) > 0, F.transform(f, lambda h: F.trim(h))).otherwise(F.array(F.lit("Markdown"))))


def sections(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a heading block, its heading line included; text before the first heading is a block of its own.  Columns to keep come last."""
    parts = F.filter(F.split("md", r"(?m)^(?=[ \t]{0,3}#{1,6}[ \t])"), lambda p: F.trim(p) != "")
    rows = docs.select("doc_id", "file_url", "title", *keep, F.posexplode(parts).alias("pos", "text"))
    heading = F.coalesce(F.nullif(F.regexp_extract("text", _HEADING, 1), F.lit("")), F.lit("Markdown"))
    return rows.select(numbered("doc_id", "section", "pos").alias("section_id"), "doc_id", "file_url", "title", F.trim(heading).alias("heading"), "text", word_count("text").cast("long").alias("token_count"), *keep)


def numbered(parent: str, what: str, pos: str) -> Column:
    return F.concat(F.col(parent).cast("string"), F.lit(f"#{what}-"), (F.col(pos) + 1).cast("string"))


def formula_lines(text: Column) -> Column:
    """Lines, without list marks, of at most 320 characters with something on both sides of '=' and a letter; each once."""
    some = F.filter(F.split(text, "\n"), lambda x: x.contains("="))
    lines = F.transform(some, lambda x: F.regexp_replace(F.trim(x), r"^[-* ]+|[-* ]+$", ""))
    return F.array_distinct(F.filter(lines, lambda x: ~x.startswith("|") & (F.length(x) <= 320) & x.rlike(r"^\s*[^\s=][^=]*=\s*\S") & x.rlike(r"[A-Za-z\x{4e00}-\x{9fff}]")))


def left_term(formula: Column) -> Column:
    """The left side of a formula if it can be a term, else null."""
    left = F.trim(F.split_part(formula, F.lit("="), F.lit(1)))
    return F.when((F.length(left) >= 2) & (F.length(left) <= 80) & left.rlike(r"[A-Za-z\x{4e00}-\x{9fff}]"), left)


def spotted_terms(text: Column, left: Column | None = None) -> Column:
    """The left side, then the labels of the terms that stand in the text as whole words; each once."""

    def there(whole: Column, low: Column, p: str) -> Column:
        """Looked for by its words and by its right edge before the pattern that tries every place."""
        some = F.lit(True)
        for word in p.split(r"\s+"):
            some = some & low.contains(word)
        return some & whole.rlike(rf"(?i){p}(?![{_WORD}])") & whole.rlike(rf"(?i)(^|[^{_WORD}]){p}($|[^{_WORD}])")

    found = let(text, lambda whole: let(F.lower(whole), lambda low: F.array(*[F.when(there(whole, low, p), F.lit(label)) for label, p in TERMS])))
    return F.array_distinct(F.array_compact(found if left is None else F.concat(F.array(left), found)))


def formula_cards(secs: DataFrame) -> DataFrame:
    rows = secs.select("doc_id", "file_url", "title", "section_id", "heading", F.posexplode(formula_lines(F.col("text"))).alias("pos", "formula_text"), snippet("text", 480).alias("context"))
    terms = spotted_terms(F.concat_ws(" ", "formula_text", "context"), left_term(F.col("formula_text")))
    return rows.select(numbered("section_id", "formula", "pos").alias("formula_id"), "doc_id", "file_url", "title", "section_id", "heading", "formula_text", "context", terms.alias("terms"))


def calculation_terms(secs: DataFrame) -> DataFrame:
    rows = secs.select("doc_id", "file_url", "title", "section_id", F.array("heading").alias("heading_path"), F.posexplode(spotted_terms(F.col("text"))).alias("pos", "term"), snippet("text", 480).alias("context"))
    return rows.select(numbered("section_id", "term", "pos").alias("term_id"), "doc_id", "file_url", "title", "section_id", "heading_path", "term", F.lower("term").alias("normalized_term"), "context")


# Line ends as Python counts them; a line is marked c (cells), r (a rule of dashes) or nothing.
_LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_RULE = r"(?U)^\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)++$"
_LINE = r"[^\n]*+\n"
# A header and a rule without rows make no table; a header, a rule or not, and rows do.
_TABLE = rf"(?md)^[cr]{_LINE}r{_LINE}(?!c)|^[cr]{_LINE}(?:r{_LINE})?(?:c{_LINE})++"


def table_blocks(text: Column) -> Column:
    """The pipe tables of a text, each as its marked lines: a header, a rule or not, then rows up to a line without cells or a rule."""
    # lines without a bar are empty in the end
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), _LINE_END), lambda x: F.when(x.contains("|"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(""))
    inner = F.transform(bare, lambda x: F.regexp_replace(x, r"^\||\|$", ""))
    mark = lambda x: F.when(~x.contains("|"), "").when(x.rlike(_RULE), "r").otherwise("c")
    lines = F.transform(inner, lambda x: F.concat(mark(x), F.when(x.contains("|"), x).otherwise(""), F.lit("\n")))
    return F.filter(F.regexp_extract_all(F.array_join(lines, ""), F.lit(_TABLE), 0), lambda t: t.contains("\nc"))


def _padded(cells: Column, width: Column) -> Column:
    return F.concat(cells, F.array_repeat(F.lit(""), width - F.size(cells)))


def unique_headers(names: Column) -> Column:
    """Blank names become column_N, repeated ones (whatever their case) get _2, _3 and so on."""
    flat = F.transform(names, lambda x, k: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    named = F.transform(flat, lambda x, k: F.when(x == "", F.concat(F.lit("column_"), (k + 1).cast("string"))).otherwise(x))

    def numbered_name(x: Column, k: Column) -> Column:
        n = F.size(F.filter(F.slice(named, F.lit(1), k + 1), lambda y: F.lower(y) == F.lower(x)))
        return F.when(n == 1, x).otherwise(F.concat(x, F.lit("_"), n.cast("string")))

    return F.transform(named, numbered_name)


def structured_tables(secs: DataFrame) -> DataFrame:
    """One row a pipe table: headers, rows (a list of cells each) and all of it as text."""
    named = "doc_id", "file_url", "title", "section_id", "heading"
    found = secs.filter(F.col("text").contains("|")).select(*named, F.posexplode(table_blocks(F.col("text"))).alias("pos", "block"))
    cells = lambda line: F.transform(F.split(F.substring(line, F.lit(2), F.length(line)), r"\|"), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    lines = F.slice(F.split("block", "\n"), 1, F.size(F.split("block", "\n")) - 1)  # the last line ends the block
    split = found.select(*named, "pos", cells(lines[0]).alias("head"), F.transform(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x.startswith("c")), cells).alias("body"))
    width = split.withColumn("width", F.greatest(F.size("head"), F.array_max(F.transform("body", lambda r: F.size(r)))))
    whole = width.select(*named, "pos", unique_headers(_padded(F.col("head"), F.col("width"))).alias("headers"), F.transform("body", lambda r: _padded(r, F.col("width"))).alias("rows"))
    text = F.array_join(F.concat(F.array(F.array_join("headers", " ")), F.transform("rows", lambda r: F.array_join(r, " "))), " ")
    return whole.select(*named, numbered("section_id", "table", "pos").alias("table_id"), "headers", "rows", text.alias("text"))


def rows_text(rows: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.flatten(rows), lambda x: F.trim(x)), lambda x: x != ""), " ")


def aliases(docs: DataFrame, *keep: str) -> DataFrame:
    """Names of each document: title, document and rule numbers, other identifiers, and the file's stem.  Columns to keep come last."""
    t = F.col("title")
    numbers = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?:第\s*)?([0-9]+)\s*号"), 1))
    rules = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?i)\b(?:rule|article)\s*[-#: ]\s*([A-Za-z0-9_.-]+)"), 1))
    others = F.regexp_extract_all(t, F.lit(r"(?i)\b(?:regulation|guideline|standard)\s*[-#: ]\s*([A-Za-z0-9_.-]+)"), 1)
    stem = F.regexp_replace(F.regexp_extract("file_url", r"([^/?#]+)(?:[?#].*)?$", 1), r"(?<=.)\.[A-Za-z0-9]+$", "")
    ids = F.array_distinct(F.filter(F.concat(numbers, rules, others, F.array(stem)), lambda x: x != ""))
    names = F.array_distinct(F.filter(F.concat(F.array(F.coalesce(t, F.lit(""))), ids), lambda x: x != ""))
    return docs.select("doc_id", "file_url", "title", names.alias("aliases"), ids.alias("identifiers"), numbers.alias("document_numbers"), rules.alias("rule_numbers"), *keep)


def relations(secs: DataFrame, names: DataFrame) -> DataFrame:
    """has_section edges of documents, and alias_of edges of their names."""
    none = F.lit(None).cast("string")
    doc = F.col("doc_id").cast("string")
    has = secs.select(F.lit("has_section").alias("relation_type"), doc.alias("doc_id"), "file_url", "title", none.alias("alias"), "section_id", F.col("heading").alias("section_heading"), F.lit("section").alias("target_type"), F.col("section_id").alias("target_id"))
    of = names.select(doc.alias("doc_id"), "file_url", "title", F.explode("aliases").alias("alias"))
    return has.unionByName(of.select(F.lit("alias_of").alias("relation_type"), "doc_id", "file_url", "title", "alias", none.alias("section_id"), none.alias("section_heading"), F.lit("document").alias("target_type"), F.col("doc_id").alias("target_id")))


# --- search -------------------------------------------------------------------------------


def _ranked(df: DataFrame, query: str, weights: dict[str, Column], phrases: list[tuple[Column, float]], by: tuple[Column | str, ...], limit: int) -> DataFrame:
    """Rows with a positive score.  Each weight's key is ``number name``; the first phrase column that holds the query adds its bonus."""
    tokens, score, bonus = query_tokens(query), F.lit(0.0), F.lit(0.0)
    for name, c in weights.items():
        score = score + field_score(tokens, c, float(name.split(" ")[0]))
    for c, more in reversed(phrases):
        bonus = F.when(F.lower(F.coalesce(c, F.lit(""))).contains(query.strip().lower()), more).otherwise(bonus)
    if not tokens:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    return df.withColumn("score", F.round(score + bonus, 4)).filter("score > 0").orderBy(F.desc("score"), *by).limit(max(1, min(100, limit)))


def search_formulas(cards: DataFrame, query: str, limit: int = 10) -> DataFrame:
    c = F.col
    weights = {"6 formula": c("formula_text"), "5 terms": F.array_join("terms", " "), "3 heading": c("heading"), "1.5 context": c("context"), "1 title": c("title")}
    return _ranked(cards, query, weights, [(F.concat_ws(" ", "formula_text", "context"), 4.0)], (F.lower("title"), "formula_id"), limit)


def search_tables(tables: DataFrame, query: str, limit: int = 10) -> DataFrame:
    c, cells, heads = F.col, rows_text(F.col("rows")), F.array_join("headers", " ")
    caption = c("caption") if "caption" in tables.columns else F.lit("")
    weights = {"4 headers": heads, "4 rows": cells, "2 caption": caption, "2 heading": c("heading"), "1 text": c("text")}
    return _ranked(tables, query, weights, [(F.concat_ws(" ", caption, "heading", heads, cells, "text"), 4.0)], (F.lower("title"), "table_id"), limit)


def search_terms(terms: DataFrame, query: str, limit: int = 10) -> DataFrame:
    c, name = F.col, F.concat_ws(" ", "term", "normalized_term")
    weights = {"8 term": name, "2 context": c("context"), "1 path": F.array_join("heading_path", " "), "0.5 title": c("title")}
    return _ranked(terms, query, weights, [(name, 6.0), (c("context"), 2.0)], (F.lower("term"), "term_id"), limit)


def search_sections(secs: DataFrame, names: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Sections with the aliases of their documents."""
    rows = secs.join(names.select("doc_id", F.array_join("aliases", " ").alias("alias_text")), "doc_id", "left")
    c = F.col
    weights = {"4 heading": c("heading"), "3 path": c("heading"), "1 text": c("text"), "1 title": c("title"), "4 aliases": c("alias_text")}
    return _ranked(rows, query, weights, [(F.concat_ws(" ", "heading", "text"), 3.0)], (F.lower("title"), "section_id"), limit)


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _within(text: Column, phrase: Column) -> Column:
    """The phrase stands in the text, not inside a longer word."""
    return F.regexp_like(text, F.concat(F.lit(rf"(?<![{_WORD}])\Q"), phrase, F.lit(rf"\E(?![{_WORD}])")))


def _named(number: bool) -> Callable[[Column], Column]:
    return lambda x: F.struct(x.alias("text"), F.lit(number).alias("number"))


def alias_match(names: DataFrame, query: str) -> DataFrame:
    """Adds score and matched_alias: 100 for the query itself, 92 for a number that the query names, 88 to 89 for a name in it, 80 to 81 for two words or more within a name.

    Numbers never match as plain phrases.  Of equal scores the first name counts, in the
    order aliases, identifiers, document numbers, rule numbers, title.
    """
    q = " ".join(query.lower().split())
    lit, n_tokens = F.lit(q), len(query_tokens(q))
    kinds = (("aliases", False), ("identifiers", False), ("document_numbers", True), ("rule_numbers", True))
    own = [F.transform(c, _named(number)) for c, number in kinds]
    title = F.array(F.struct(F.coalesce("title", F.lit("")).alias("text"), F.lit(False).alias("number")))

    def score(x: Column) -> Column:
        a = _squeezed(x["text"])
        ratio = F.least(F.length(a), F.lit(len(q))) / F.greatest(F.length(a), F.lit(len(q)))
        edge = r"(?<![A-Za-z0-9])"
        named = F.regexp_like(lit, F.concat(F.lit(rf"{edge}(?:第\s*)?\Q"), a, F.lit(r"\E\s*号?(?![A-Za-z0-9])"))) | F.regexp_like(lit, F.concat(F.lit(rf"{edge}(?:rule|article)\s*[-#: ]\s*\Q"), a, F.lit(r"\E(?![A-Za-z0-9])")))
        number = x["number"] | a.rlike("^[0-9]+$")
        phrase = F.when(_within(lit, a), 88.0 + ratio).when(F.lit(n_tokens >= 2) & _within(a, lit), 80.0 + ratio).otherwise(0.0)
        return F.when((a == "") | (F.lit(q) == ""), 0.0).when(a == lit, 100.0).when(number, F.when(named, 92.0).otherwise(0.0)).otherwise(phrase)

    tried = F.transform(F.concat(*own, title), lambda x, i: F.struct(score(x).alias("score"), (-i).alias("i"), x["text"].alias("text")))
    best = F.array_max(tried)
    return names.withColumn("best", best).withColumn("score", F.round("best.score", 4)).withColumn("matched_alias", F.col("best.text")).drop("best")


def search_titles(docs: DataFrame, names: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(doc_id, title, score, source, matched_alias): documents known by a name of the query first, then the others by their fields."""
    k = max(1, min(100, limit))
    hits = alias_match(names, query).filter("score > 0")
    rest = docs.join(hits.select("doc_id"), "doc_id", "left_anti")
    c = F.col
    weights = {"5 title": c("title"), "1 url": c("file_url"), "0.5 category": c("category"), "0.5 summary": c("summary"), "0.75 headings": F.array_join(heading_path(c("md")), " ")}
    plain = _ranked(rest, query, weights, [(c("title"), 4.0)], (F.lower("title"), "file_url"), k)
    shape = lambda df, source, alias, tier: df.select("doc_id", "file_url", "title", "score", F.lit(source).alias("source"), alias.alias("matched_alias"), F.lit(tier).alias("tier"))
    first = shape(hits.orderBy(F.desc("score"), F.lower("title"), "file_url").limit(k), "title_aliases", c("matched_alias"), 0)
    return first.union(shape(plain, "doc_catalog", F.lit(None).cast("string"), 1)).orderBy("tier", F.desc("score"), F.lower("title"), "file_url").limit(k).drop("tier")


def trace(edges: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Edges that name the query (2 a token, 5 the phrase), then those of the same documents at 0.5, once for each type and target not named."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("doc_id", "file_url", "title", "alias", "section_id", "section_heading", "target_id", "target_type", "relation_type")]))
    score = field_score(query_tokens(query), hay, 2.0) + F.when(hay.contains(query.strip().lower()), 5.0).otherwise(0.0)
    named = edges.withColumn("score", score).filter("score > 0")
    near = edges.join(named.select("doc_id").distinct(), "doc_id", "left_semi").join(named.select("relation_type", "target_id").distinct(), ["relation_type", "target_id"], "left_anti")
    near = near.groupBy("relation_type", "target_id").agg(F.min("doc_id").alias("doc_id")).withColumn("score", F.lit(0.5))
    shown = ("relation_type", "target_id", "doc_id", "score")
    return named.select(*shown).unionByName(near.select(*shown)).orderBy(F.desc("score"), "relation_type", "target_id", "doc_id").limit(max(1, min(100, limit)))


def problems(docs: DataFrame, secs: DataFrame, cards: DataFrame, tables: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, id): keys that occur twice, and rows whose document or section is not there."""
    known, section = docs.select(F.col("doc_id").cast("string").alias("k")), secs.select(F.col("section_id").alias("k"))
    out = []
    for what, df, key in (("document", docs, "doc_id"), ("section", secs, "section_id"), ("formula", cards, "formula_id"), ("table", tables, "table_id")):
        twice = df.groupBy(F.col(key).cast("string").alias("id")).agg(F.count("*").alias("n")).filter("n > 1")
        out.append(twice.select(F.lit(f"{what} twice").alias("problem"), "id"))
    for what, df, ref, to, key in (("section without document", secs, "doc_id", known, "section_id"), ("formula without section", cards, "section_id", section, "formula_id"), ("table without section", tables, "section_id", section, "table_id"), ("relation without document", edges, "doc_id", known, "target_id")):
        lost = df.select(F.col(ref).cast("string").alias("k"), F.col(key).cast("string").alias("id")).join(to, "k", "left_anti")
        out.append(lost.select(F.lit(what).alias("problem"), "id"))
    first, *rest = out
    for x in rest:
        first = first.union(x)
    return first
