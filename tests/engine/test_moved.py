"""What is read, moved or worked out on the way to a result, and that the result stays."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import ready, ready_build
from docloom.sources import artifacts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [200, 4000, 9000])
def test_digest_of_one_level(spark, n):
    lines = [f"line {i % (n - 3)} é" for i in range(n)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    items = sorted(f"{h}:{k}" for h, k in Counter(map(sha, lines)).items())
    groups = {}
    for x in items:
        groups.setdefault(x[0], []).append(x)
    whole = items if len(items) <= 256 else [f"{p}={sha(','.join(xs))}" for p, xs in sorted(groups.items())]
    got = artifacts.lines_digest(spark.createDataFrame([(x,) for x in lines], "t string").repartition(3), levels=1)
    assert (got.rows, got.sha256) == (n, sha(",".join(whole)))


def test_sections_get_names_in_their_row(spark):
    rows = [("d1", "http://x/a-7.pdf", "Rule 7", "# A\nx = y\n## B\ntext | no | table"), ("d2", "u", None, "plain")]
    docs = spark.createDataFrame(rows, "doc_id string, file_url string, title string, md string")
    got = ready_build.build(docs, "formula")["sections_structured.jsonl"]
    assert "Join" not in plan(got) and "split(md" not in plan(got)
    assert [(r.section_id, r.heading, r.token_count, r.document_aliases) for r in got.orderBy("section_id").collect()] == [
        ("d1#section-1", "A", 3, ["Rule 7", "7", "a-7"]),
        ("d1#section-2", "B", 4, ["Rule 7", "7", "a-7"]),
        ("d2#section-1", "Markdown", 1, ["u"]),
    ]


def test_terms_are_those_of_the_plain_patterns(spark):
    edge = r"[^\p{L}\p{N}_]"
    texts = ["Net  Premium", "net\npremiums", "a𝐀reserve", "reserve𝐀", "x_v v_", "V", "v\n", "\nBEL.", "belle", "éscr", "SCR-q_x", "KK discount rate", "PV BENEFITS pv\tpremiums", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i")
    df = rows.select(ready.spotted_terms(F.col("t")).alias("x"))
    plain = F.array_compact(F.array(*[F.when(F.col("t").rlike(f"(?i)(^|{edge}){p}($|{edge})"), F.lit(label)) for label, p in ready.TERMS]))
    got = [r.x for r in df.collect()]
    assert got == [r.x for r in rows.select(plain.alias("x")).collect()]
    assert got[0] == ["Net Premium", "premium"] and got[5] == ["v"]
    assert plan(df).count("lower(") == 1


def test_lines_without_an_equals_sign_are_not_stripped(spark):
    rows = spark.createDataFrame([("* a = b -\nwords\n| x = 1 |\n - a = b\n= c\n-=-",)], "t string")
    df = rows.select(ready.formula_lines(F.col("t")).alias("x"))
    assert df.first().x == ["a = b"]
    assert "Contains" in plan(df) or "contains(" in plan(df).lower()


def test_texts_of_chunks_do_not_meet_the_bindings(spark, sf):
    from docloom.plans import registry

    top = plan(registry.queries()["txt14_bound_chunks"](spark, sf)).split("Join Inner")[0]
    assert "md5(" not in top
