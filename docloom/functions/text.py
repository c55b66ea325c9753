"""Column helpers: matching, scoring and cutting text with built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is worked out once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def blank(c: Column | str) -> Column:
    """Null and white space count as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def contains_any(q: str, *cols: str) -> Column:
    """Case-insensitive literal search in several columns; % and _ in q are ordinary characters."""
    out = F.lit(False)
    for c in cols:
        out = out | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q.lower())
    return out


def in_category(category: Column | str, name: str) -> Column:
    """Membership in a semicolon list: equal, or first, last or middle element (those three ignore case)."""
    c = F.col(category) if isinstance(category, str) else category
    low, x = F.lower(c), name.lower()
    return (c == name) | low.startswith(f"{x};") | low.endswith(f"; {x}") | low.contains(f"; {x};")


def visible_categories(c: Column | str) -> Column:
    """Elements of a semicolon list without blanks and ``(internal)`` labels."""
    parts = F.transform(F.split(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), ";"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "") & ~(p.startswith("(") & p.endswith(")")))


def query_tokens(query: str) -> list[str]:
    """Lower-case ASCII words and CJK runs (runs also as pairs of characters), each once, in order."""
    out: dict[str, None] = {}
    for run in re.findall(r"[a-z0-9_]+|[一-鿿]+", query.lower()):
        out[run] = None
        if "一" <= run[0] <= "鿿":
            out |= dict.fromkeys(run[i : i + 2] for i in range(len(run) - 1))
    return list(out)


def field_score(tokens: list[str], c: Column | str, weight: float) -> Column:
    """weight for each token that occurs in the text; presence, not frequency."""
    low = F.lower(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")))
    total = F.lit(0.0)
    for t in tokens:
        total = total + F.when(low.contains(t), F.lit(weight)).otherwise(0.0)
    return total


def snippet(c: Column | str, n: int = 240) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), r"\s+", " "))
    return let(flat, lambda f: F.when(F.length(f) <= n, f).otherwise(F.concat(F.rtrim(F.substring(f, 1, n - 3)), F.lit("..."))))


def slug(c: Column | str, fallback: str = "item") -> Column:
    """Lower-case name of letters, digits, points, underscores and hyphens; the fallback where nothing is left."""
    low = F.lower(F.regexp_replace(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), r"(?U)^\s+|\s+$", ""))
    made = F.regexp_replace(F.regexp_replace(low, r"[^A-Za-z0-9_.-]+", "-"), r"^-+|-+$", "")
    return F.when(made == "", fallback).otherwise(made)


def word_count(c: Column | str) -> Column:
    """Runs of word characters of any script."""
    return F.regexp_count(c if isinstance(c, Column) else F.col(c), F.lit(r"(?U)[\w一-鿿]+"))


def keyword_list(c: Column | str) -> Column:
    """A JSON array, else a comma list."""
    c = c if isinstance(c, Column) else F.col(c)
    return F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda x: x != ""))


def sentences(c: Column | str, longer_than: int = 20) -> Column:
    # (?<=[.!?])\s+, but looked back only from white space
    parts = F.transform(F.split(c if isinstance(c, Column) else F.col(c), r"\s(?<=[.!?]\s)\s*"), lambda p: F.trim(p))
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def looks_bad(c: Column | str) -> Column:
    c = c if isinstance(c, Column) else F.col(c)
    control = F.regexp_count(c, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    return F.coalesce((F.length(c) < 800) | (control > F.length(c) * 0.02) | (F.regexp_count(c, F.lit(r"\n{3}")) > 5), F.lit(True))


def squash(c: Column | str) -> Column:
    flat = F.translate(c if isinstance(c, Column) else F.col(c), "\u0000�", "")
    return F.trim(F.regexp_replace(flat, r"\s+", " "))


def escape_markdown(c: Column | str) -> Column:
    """Backslash first, then the other marks, one after another."""
    out = c if isinstance(c, Column) else F.col(c)
    for ch in "\\`*_{}[]()#+-.!|":
        out = F.replace(out, F.lit(ch), F.lit("\\" + ch))
    return out


def html_text(c: Column | str) -> Column:
    c = c if isinstance(c, Column) else F.col(c)
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))


def week_start(ts: Column | str) -> Column:
    return F.date_trunc("week", ts if isinstance(ts, Column) else F.col(ts))
