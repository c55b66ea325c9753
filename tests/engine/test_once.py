"""Long texts are worked out once within their row, with the results of the plain rules."""

import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import cataloging, textpipe


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


ODD = ["", "The of.", "other of_x theory", "x the", "the\n", "the", "THE-of", "a𝐀the b", "éthe", "1the the1 of", "of\r\nla LE", "der,und;des de", None, "ofof the the"]


@pytest.mark.parametrize("term", ["the", "of", "machine learning", "a.b", "x|of"])
def test_whole_words_are_those_of_the_plain_pattern(spark, term):
    rows = spark.createDataFrame([(x,) for x in [*ODD, "machine learning", "a machine learnings, machine learning.", "axb", "of x"]], "t string")
    plain = F.coalesce(F.col("t").rlike(rf"(^|[^a-z0-9_]){term}([^a-z0-9_]|$)"), F.lit(False))
    assert rows.filter((textpipe.category_score(F.col("t"), (term,)) == 1) != plain).count() == 0


def test_categories_lower_a_text_once(spark):
    rules = {"Alpha": ("the", "of"), "Beta": ("de", "la", "le"), "Gamma": ("der", "und")}
    df = spark.createDataFrame([(x,) for x in ODD], "t string").select(textpipe.categorize(F.col("t"), rules).alias("c"))
    assert plan(df).count("lower(") == 1
    assert [r.c for r in df.collect()] == ["Other", "Alpha", "Other", "Alpha", "Alpha", "Alpha", "Alpha", "Alpha", "Alpha", "Alpha", "Beta; Alpha", "Gamma; Beta", "Other", "Alpha"]


def test_sentences_are_cut_where_the_plain_pattern_cuts(spark):
    texts = ["One. Two!  Three?\n\nFour", " . a", "a.  b", "a .\tb.c! ", "...  x", "a! ?  b", ".", "", "a. b.  c"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r.s for r in rows.select(tx.sentences("t", -1).alias("s")).collect()]
    plain = F.transform(F.split("t", r"(?<=[.!?])\s+"), lambda p: F.trim(p))
    assert got == [r.s for r in rows.select(plain.alias("s")).collect()]
    assert got[0] == ["One.", "Two!", "Three?", "Four"]


def test_summaries_lower_a_sentence_and_the_terms_once(spark):
    rows = spark.createDataFrame([("A first sentence of words. The second one has Words and terms! Short. Terms are here again, says it.", ["Words", "terms"])], "t string, k array<string>")
    df = rows.select(textpipe.summary_column(F.col("t"), F.col("k"), 2).alias("s"))
    assert plan(df).count("lower(") == 2
    assert df.first().s == "The second one has Words and terms! A first sentence of words."


def test_terms_of_one_document(spark):
    text = "Solvency II is here. solvency ii, covid–19 and Covid — 19! rate of rates rate rate rate of rates"
    rows = spark.createDataFrame([(text, "Rate rates", "x"), (None, None, "y"), ("the of", "covid 19", "z")], "t string, h string, i string")
    got = {r.i: r.k for r in rows.select("i", textpipe.keyword_column(F.col("t"), F.col("h")).alias("k")).collect()}
    assert got["x"][:3] == ["solvency ii", "covid-19", "covid - 19"]
    assert got["y"] == [] and got["z"] == ["covid 19"]


def test_kinds_look_at_a_beginning_once(spark):
    from docloom.sources import readers

    df = spark.createDataFrame([(bytearray(b" <!DOCTYPE html>"),), (bytearray(b"x\0"),), (None,)], "c binary").select(readers.detect_kind(F.col("c")).alias("k"))
    assert len(re.findall(r"substring\(c#", plan(df))) == 1
    assert [r.k for r in df.collect()] == ["html", "unknown", "unknown"]


def test_related_texts_are_lowered_once(spark):
    rows = spark.createDataFrame([("of an LLM", "t", ["zzz"]), ("words", None, ["Word"]), ("x", "y", ["z"]), ("x", "y", [])], "t string, h string, k array<string>")
    df = rows.select(cataloging.related(F.col("t"), F.col("h"), F.col("k"), cataloging.AI_TERMS).alias("r"))
    assert plan(df).count("lower(concat_ws") == 1
    assert [r.r for r in df.collect()] == [True, True, False, False]
