"""Cleaning of texts, lists, names, JSON and timestamps as column expressions."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The named entities that are decoded, in an order that leaves &amp; for the end.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def norm(c: Column) -> Column:
    """Text without white space around it; null is empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def list_text(c: Column) -> Column:
    """The elements that are not blank, without white space around them."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), norm), lambda x: x != "")


def last_text(c: Column) -> Column:
    """The last element of a list that is not blank, else empty."""
    return F.coalesce(F.try_element_at(list_text(c), F.lit(-1)), F.lit(""))


def distinct_ignoring_case(c: Column, most: int) -> Column:
    """The first ``most`` elements that differ by more than case and white space, in order."""
    clean = list_text(c)
    low = F.transform(clean, lambda x: F.lower(x))
    return F.slice(F.filter(clean, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most)


def allowed_categories(c: Column, allowed: tuple[str, ...], most: int = 3) -> Column:
    """Elements of a semicolon list that are allowed, under their allowed spelling."""
    spelled = F.create_map(*[F.lit(x) for a in allowed for x in (a.lower(), a)])
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda p: F.try_element_at(spelled, F.lower(F.trim(p))))
    return F.slice(F.array_distinct(F.array_compact(parts)), 1, most)


def trimmed_sentence(c: Column, n: int) -> Column:
    """At most n characters; a longer text ends with its last whole sentence, if one ends beyond half of n."""
    cut = F.substring(c, 1, n)
    whole = F.regexp_extract(cut, r"(?s)^(.*[.!?])(\s|$)", 1)
    return F.when(F.length(c) <= n, c).otherwise(F.when(F.length(whole) * 2 > n, whole).otherwise(F.rtrim(cut)))


def clean_markdown(c: Column) -> Column:
    """Without page-number lines, blanks at line ends and runs of more than one empty line."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.rtrim(x))
    kept = F.filter(lines, lambda x: ~x.rlike(r"(?i)^\s*(page\s+)?[0-9]{1,4}(\s*(of|/)\s*[0-9]{1,4})?\s*$"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")


def unescape(c: Column) -> Column:
    """Named and decimal entities of ASCII decoded."""
    for entity, sign in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


@F.arrow_udf(StringType())
def _decoded(texts: pa.Array) -> pa.Array:
    return pa.array([None if (t := x.as_py()) is None else html.unescape(t) if "&" in t else t for x in texts], pa.string())


def unescape_all(c: Column) -> Column:
    """All named and numbered references of the HTML standard decoded once, with or without their semicolon."""
    return _decoded(c)


def file_name(c: Column, most: int = 120) -> Column:
    """A name without separators and control characters, at most so long, never empty."""
    made = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|\x00-\x1F]+', "_"), r"^[ .]+|[ .]+$", "")
    return F.when(made == "", "file").otherwise(F.substring(made, 1, most))


def first_object(c: Column) -> Column:
    """The text itself if it is an object, else from its first brace to its last, else null."""
    found = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def iso_time(c: Column) -> Column:
    """A timestamp of an ISO text, null where it is none."""
    return F.try_to_timestamp(F.replace(F.regexp_replace(c, r"Z$", "+00:00"), F.lit("T"), F.lit(" ")))


def latest_time(*texts: Column) -> Column:
    """The latest of the texts that are timestamps."""
    return F.greatest(*[iso_time(t) for t in texts])


def format_chain(path: Column, chains: dict[str, tuple[str, ...]], enabled: tuple[str, ...]) -> Column:
    """The enabled tools for a file's ending, in order; an empty list for unknown endings."""
    by = F.create_map(*[x for k, v in chains.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v if t in enabled]).cast("array<string>"))])
    return F.coalesce(F.try_element_at(by, F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))), F.array().cast("array<string>"))


def budgeted(lengths: Column, budget: int, least: int = 1) -> Column:
    """How much of each source fits, in order: what is cut advances the sum by its cut length only; less than ``least`` ends it."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        room = F.greatest(F.lit(0), F.lit(budget) - acc["used"])
        fits = F.when(room >= least, F.least(n.cast("long"), room)).otherwise(F.lit(0)).cast("long")
        return F.struct((acc["used"] + fits).alias("used"), F.array_append(acc["out"], fits).alias("out"))

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])
