"""Cases that no table holds: headings, tables of categories, small state machines."""

import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import chunking, evidence, merge, textpipe, vectors
from docloom.sources import readers
from docloom.streaming import streams


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr).first()[0]


def test_category_membership(spark):
    rows = [("AI",), ("ai; Pricing",), ("Pricing; AI",), ("A; ai; B",), ("ai",), ("Pair",), (None,), ("",)]
    got = [bool(r[0]) for r in spark.createDataFrame(rows, "c string").select(tx.in_category("c", "AI")).collect()]
    assert got == [True, True, True, True, False, False, False, False]


def test_search_is_literal(spark):
    assert one(spark, "100% sure", tx.contains_any("0% S", "c")) and not one(spark, "100 sure", tx.contains_any("0%", "c"))


def test_tokens_and_scores(spark):
    assert tx.query_tokens("Net premium 偿付能力 net") == ["net", "premium", "偿付能力", "偿付", "付能", "能力"]
    assert one(spark, "Net net premium", tx.field_score(["net", "premium", "x"], "c", 2.5)) == 5.0


def test_snippet_and_slug(spark):
    assert one(spark, "a  b\nc", tx.snippet("c")) == "a b c" and one(spark, "x" * 300, tx.snippet("c")) == "x" * 237 + "..."
    assert one(spark, "  Art. 5 / §x ", tx.slug("c")) == "art.-5-x"


def test_chunks_follow_headings_and_lose_nothing():
    text = "# A\n" + "alpha beta. " * 60 + "\n## B\nsmall\n### C\n" + "gamma delta. " * 400 + "\n## D\ntail"
    got = chunking.chunk(text, most=200, least=40)
    assert got[0][0] == "A" and any(p == "A > B > C" for p, _ in got)
    assert all(chunking.token_count(c) <= 215 for _, c in got)
    assert "".join("".join(c for _, c in got).split()) == "".join(text.split())
    assert chunking.chunk("") == [] and chunking.chunk("tiny") == [("", "tiny")]


def test_keywords_prefer_title_and_pairs(spark):
    docs = spark.createDataFrame([(1, "Capital model\ncapital model capital model reserve"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.keywords for r in textpipe.keywords(docs, 3).collect()}
    assert got[1] == ["capital model", "capital", "model"] and got[2] == got[3] == []


def test_summary_ranks_sentences(spark):
    docs = spark.createDataFrame([(1, "Nothing of any interest here. The premium and the reserve differ. A premium is what one pays.")], "doc_id long, text string")
    assert textpipe.summarize(docs, F.array(F.lit("premium"), F.lit("reserve")), 2).first().summary == "The premium and the reserve differ. A premium is what one pays."


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, first long")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "id long, v string, first long")
    once = merge.upsert(old, new, ["id"], keep=("first",))
    twice = merge.upsert(once, new, ["id"], keep=("first",))
    want = [(1, "a", 1), (2, "c", 1), (3, "d", 9)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_rate_limit_counts_only_what_passes(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(i, 1, at(s)) for i, s in enumerate([0, 1, 2, 10, 11, 12])]
    got = [r.allowed for r in streams.rate_limit(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), [(2, 10.0)]).orderBy("event_id").collect()]
    assert got == [True, True, False, True, True, False]


def test_weekly_stream(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, d),) for d in (1, 7, 8)]
    spark.createDataFrame(rows, "first_seen timestamp").write.parquet(str(tmp_path / "in"))
    out = streams.weekly(spark.readStream.schema("first_seen timestamp").parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("weeks").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.week.day: r.n for r in spark.table("weeks").collect()} == {1: 2, 8: 1}


def test_vectors_leave_other_dimensions_out(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    got = vectors.search(v, [1.0, 0.0], 5).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (2, -1.0)]


def test_relations_second_pass(spark):
    edges = spark.createDataFrame([("cites", "d1", "capital", "t1"), ("alias_of", "d1", "zzz", "d1"), ("alias_of", "d2", "yyy", "d2")], "relation_type string, doc_id string, alias string, target_id string")
    got = {(r.relation_type, r.target_id): r.score for r in evidence.trace_relations(edges, "capital").collect()}
    assert got == {("cites", "t1"): 7.0, ("alias_of", "d1"): 0.5}


def test_jsonl_and_paths(spark, tmp_path):
    (tmp_path / "doc_catalog.jsonl").write_text('{"doc_id": "a"}\nbroken\n\n{"doc_id": "b"}\n')
    got = readers.read_artifacts(spark, str(tmp_path), {"doc_catalog": "doc_id string", "sections": "section_id string"})
    assert sorted(r.doc_id for r in got["doc_catalog"].collect() if r.doc_id) == ["a", "b"] and got["sections"].isEmpty()
    with pytest.raises(ValueError):
        readers.confined(str(tmp_path), "../x")


def test_kinds(spark):
    rows = [(b"%PDF-1.4",), (b"\xff\xd8\xff\xe0",), (b"\x89PNG\r\n\x1a\n",), (b"<!DOCTYPE html>",), (b"plain",), (b"\x00\x01\x00",), (b"",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c binary").select(readers.detect_kind(F.col("c"))).collect()]
    assert got == ["pdf", "jpeg", "png", "html", "txt", "unknown", "unknown"]
