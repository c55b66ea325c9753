"""Keywords, summaries and categories of documents, each within its row."""

from __future__ import annotations

import re
from collections import Counter
from heapq import nlargest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docloom.functions.text import let, sentences

STOP = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "have", "not", "but", "can", "will", "its", "our", "their", "which", "into", "than", "these", "those")
RULES = {"AI": ("machine learning", "ai", "model"), "Pricing": ("pricing", "premium", "rate"), "Risk": ("risk", "capital", "solvency"), "Reserving": ("reserve", "reserving", "claims")}


_WORD = r"([a-z][a-z0-9-]*)"
SPECIAL = r"\b(ifrs\s*17|covid[-\s]*19|solvency\s*ii)\b"
_SPECIAL_STARTS = ("ifrs", "covid", "solvency")


_FOUND = re.compile(_WORD)


def _counted(text: str) -> tuple[Counter[str], Counter[str]]:
    """Good words and pairs of adjacent good words with their counts, in the order of first occurrence."""
    words = _FOUND.findall(text)
    good = {w for w in set(words) if len(w) >= 3 and w not in STOP}
    pairs = Counter(p for p in zip(words, words[1:]) if p[0] in good and p[1] in good)
    return Counter(w for w in words if w in good), Counter({f"{a} {b}": n for (a, b), n in pairs.items()})


def _ranked_terms(text: str, title: str, special: list[str], top_n: int) -> list[str]:
    """The best terms of one document, by score, then by kind and first place."""
    (words, pairs), (heads, head_pairs) = _counted(text), _counted(title)
    score: Counter[str] = Counter()
    first: dict[str, tuple[int, int]] = {}
    for kind, (found, in_title, bonus, each) in enumerate(((words, heads, 3, 1), (pairs, head_pairs, 4, 1), (Counter(" ".join(x.split()) for x in special), (), 0, 10))):
        for place, (term, n) in enumerate(found.items()):
            score[term] += each * n + (bonus if term in in_title else 0)
            first.setdefault(term, (kind, place))
    if len(score) > top_n:
        least = nlargest(top_n, score.values())[-1] if top_n > 0 else 0
        score = {t: n for t, n in score.items() if n >= least}
    return sorted(score, key=lambda t: (-score[t], first[t]))[:top_n]


def ranked_terms(text: Column, title: Column, special: Column, top_n: int) -> Column:
    @F.arrow_udf(ArrayType(StringType()))
    def run(texts: pa.Array, titles: pa.Array, specials: pa.Array) -> pa.Array:
        rows = zip(texts, titles, specials)
        return pa.array((_ranked_terms(a.as_py() or "", b.as_py() or "", c.as_py() or [], top_n) for a, b, c in rows), pa.list_(pa.string()))

    return run(text, title, special)


def keyword_column(text: Column, title: Column, top_n: int = 8) -> Column:
    """Words of three characters or more and pairs of adjacent ones by score, for one row's text.

    A word scores its count, plus 3 if the title has it; a pair its count, plus 4 if the
    title has it; special names 10 for each time, in title or text.  Ties go to words before
    pairs before special names, then to the first to occur.  A null text has none.
    """
    low = F.replace(F.replace(F.lower(F.concat_ws("\n", title, text)), F.lit("–"), F.lit("-")), F.lit("—"), F.lit("-"))
    return ranked_terms(F.lower(text), F.lower(title), let(low, _special), top_n)


def _special(low: Column) -> Column:
    """The special names of a text; only texts with the start of one are searched."""
    some = F.lit(False)
    for start in _SPECIAL_STARTS:
        some = some | low.contains(start)
    return F.when(some, F.regexp_extract_all(low, F.lit(SPECIAL), 1)).otherwise(F.array().cast("array<string>"))


def first_line(text: Column | str) -> Column:
    return F.split_part(text if isinstance(text, Column) else F.col(text), F.lit("\n"), F.lit(1))


def keywords(docs: DataFrame, top_n: int = 8) -> DataFrame:
    """(doc_id, keywords) of each row by ``keyword_column``, with the first line as title; nothing moves."""
    return docs.select("doc_id", keyword_column(F.col("text"), first_line("text"), top_n).alias("keywords"))


def ranked_sentences(text: Column, terms: Column) -> Column:
    """Sentences as struct(hits, pos, sentence), those with most of the terms first; equal ones stay in their order."""
    found = lambda s, low: F.size(F.filter(low, lambda t: F.contains(s, t)))
    hits = lambda s, low: let(F.lower(s), lambda x: found(x, low))
    rows = lambda low: F.transform(sentences(text), lambda s, i: F.struct((-hits(s, low)).alias("less"), i.alias("pos"), s.alias("sentence")))
    return F.sort_array(let(F.transform(terms, lambda t: F.lower(t)), rows))


def summary_column(text: Column, terms: Column, max_sentences: int = 4) -> Column:
    """The sentences with most of the terms, in rank order."""
    ranked = F.slice(ranked_sentences(text, terms), 1, max_sentences)
    return F.coalesce(F.array_join(F.transform(ranked, lambda x: x["sentence"]), " "), F.lit(""))


def summarize(docs: DataFrame, terms: Column, max_sentences: int = 4) -> DataFrame:
    """(doc_id, summary) of each row."""
    return docs.select("doc_id", summary_column(F.col("text"), terms, max_sentences).alias("summary"))


def _whole_word(term: str) -> str:
    """A pattern of the term as a whole word; a term of plain characters is found first and its edges are looked at then."""
    if re.fullmatch(r"[a-z0-9_ -]+", term):
        return rf"{term}(?<![a-z0-9_]{term})(?![a-z0-9_])"
    return rf"(^|[^a-z0-9_]){term}([^a-z0-9_]|$)"


def category_score(text: Column, terms: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for t in terms:
        total = total + F.when(text.rlike(_whole_word(t)), 1).otherwise(0)
    return total


def categorize(text: Column, rules: dict[str, tuple[str, ...]] = RULES, top: int = 3) -> Column:
    """Up to three rule names by number of matching terms, joined by '; ', else Other."""
    scored = lambda low: F.array(*[F.struct((-category_score(low, terms)).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, terms) in enumerate(rules.items())])
    hit = F.slice(F.sort_array(F.filter(let(F.lower(text), scored), lambda x: x["s"] < 0)), 1, top)
    return let(hit, lambda h: F.when(F.size(h) > 0, F.array_join(F.transform(h, lambda x: x["name"]), "; ")).otherwise("Other"))


def classify_question(q: Column) -> Column:
    low = F.lower(q)
    has = lambda *w: F.greatest(*[low.contains(x) for x in (*w, w[0])])
    return F.when(has("summar", "overview"), "summary").when(has("where", "locate", "find"), "locate").when(has("list", "catalog", "which documents"), "catalog").otherwise("document_qa")
