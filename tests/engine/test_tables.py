"""Pipe tables against a plain walk over the lines, and the keyed changes that go with them."""

import random
import re

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import merge, ready, textpipe


def cells(line):
    line = line.strip()
    if "|" not in line:
        return None
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") else line
    return [x.strip() for x in line.split("|")] if "|" in line else None


def walk(text):
    """(header, rows) by a small machine that is fed one line after another."""
    out, head, rows, rule = [], None, [], False

    def done():
        if head and rows:
            out.append((head, list(rows)))
        rows.clear()

    for line in [*text.splitlines(), ""]:
        c = cells(line)
        is_rule = bool(c) and all(re.fullmatch(":?-{3,}:?", x) for x in c)
        if c is None:
            done()
            head = None
        elif head is None:
            head, rule = c, False
        elif is_rule and not rows and not rule:
            rule = True
        elif is_rule:
            done()
            head, rule = c, False
        else:
            rows.append(c)
    return out


def headers(names, width):
    out, seen = [], []
    for k in range(width):
        name = " ".join((names[k] if k < len(names) else "").split()) or f"column_{k + 1}"
        seen.append(name.lower())
        n = seen.count(name.lower())
        out.append(name if n == 1 else f"{name}_{n}")
    return out


def brute(text):
    out = []
    for head, rows in walk(text):
        width = max(len(head), *map(len, rows))
        out.append((headers(head, width), [r + [""] * (width - len(r)) for r in rows]))
    return out


def built(spark, texts):
    secs = spark.createDataFrame([(i, f"u{i}", "t", f"{i}#section-1", "h", t) for i, t in enumerate(texts)], "doc_id long, file_url string, title string, section_id string, heading string, text string")
    got = {}
    for r in ready.structured_tables(secs).orderBy(F.col("doc_id"), F.length("table_id"), "table_id").collect():
        assert r.text == " ".join(" ".join(x) for x in (r.headers, *r.rows))
        got.setdefault(r.doc_id, []).append((r.headers, r.rows))
        assert r.table_id == f"{r.section_id}#table-{len(got[r.doc_id])}"
    return [got.get(i, []) for i in range(len(texts))]


def test_duplicate_and_blank_headers(spark):
    text = "Reserve Factor = Premium / Benefit.\n| Value | Value | |\n| 2024 | 2025 | notes |"
    assert built(spark, [text]) == [[(["Value", "Value_2", "column_3"], [["2024", "2025", "notes"]])]]


def test_random_grids(spark):
    rng = random.Random(4)
    lines = ["| a | A |", "|---|---|", "x|y|z", ":--|--:", "text", "", "|only", "| |", "||", "| a\tb  c | a b c |  | column_3 |", "|---|x|", "c|\\d$", "é|日本| é |", "  | p | q |  "]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(14))) for _ in range(600)]
    texts += ["a|b\r\n1|2\x0c3|4 ---|---\x855|6", "a|b\n" + "1|2\n" * 30_000, "|---|---|\n|---|---|\n|---|---|\na|b"]
    assert built(spark, texts) == [brute(t) for t in texts]


def test_slugs(spark):
    rows = spark.createDataFrame([(" Net Premium!  2024 ",), ("***",), (None,), ("A_b.C-d",)], "t string")
    assert [r[0] for r in rows.select(tx.slug("t")).collect()] == ["net-premium-2024", "item", "item", "a_b.c-d"]


def test_upsert_with_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "old"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "new"), (2, "B"), (3, None)], "k int, v string")
    got = sorted((tuple(r) for r in merge.upsert(old, new, ["k"]).collect()), key=repr)
    assert got == sorted([(1, "a"), (None, "old"), (None, "new"), (2, "B"), (3, None)], key=repr)


def test_keywords_stay_in_their_row(spark):
    docs = spark.createDataFrame([(1, "alpha alpha beta"), (1, "gamma"), (2, None), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id, tuple(r.keywords)) for r in textpipe.keywords(docs).collect())
    assert got == [(1, ("alpha", "alpha alpha", "alpha beta", "beta")), (1, ("gamma",)), (2, ()), (2, ())]
