import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import langid as g
from docloom.llm.tables import table


def test_held_out_accuracy_and_shape(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    got = g.op10_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert sum(held) >= 0.98 * len(held)


@pytest.fixture(scope="module")
def model(spark):
    rows = [("en", "the house and the tree Straße"), ("de", "das Haus und der Baum das Haus"), ("el", "το σπίτι και το δέντρο")] * 5 + [(None, "x"), ("de", None)]
    return g.fit(spark.createDataFrame(rows, "lang string, text string"), F.col("lang"), F.col("text"), F.col("text"))


def test_words_then_shorter_grams(spark, make_docs, model):
    texts = {1: "THE house", 2: "Haus", 3: "Bäume", 4: "hous", 5: "σπίτια", 6: None, 7: "", 8: "123 !!! --", 9: "漢字", 10: "the " * 50000, 11: "\U0001d54f", 12: "12 und"}
    got = {r.doc_id: r.lang_pred for r in g.predict(make_docs(texts), model).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 10, 12)] == ["en", "de", "de", "en", "el", "en", "de"]
    assert [got[i] for i in (6, 7, 8)] == ["und"] * 3
    assert got[9] in model.langs and got[11] in model.langs


def test_no_training_rows_and_empty(spark, make_docs):
    none = spark.createDataFrame([], "lang string, text string")
    m = g.fit(none, F.col("lang"), F.col("text"), F.col("text"))
    docs = make_docs(["word"]).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("s"))
    assert [(r.lang_pred, r.score) for r in g.predict(docs.union(docs), m).collect()] == [("und", 0.0)] * 2
    assert g.predict(docs.limit(0), m).count() == 0


def test_long_text_votes_as_a_whole(spark, make_docs, model):
    text = "the house " * 3 + "das Haus und der Baum " * 20000
    assert [r.lang_pred for r in g.predict(make_docs([text]), model).collect()] == ["de"]


def runs(text):
    out, now = [], ""
    for ch in text:
        if ch.isalpha():
            now += ch.lower() if len(ch.lower()) == 1 else ch
        elif now:
            out.append(now)
            now = ""
    return [*out, now] if now else out


def grams(word, n):
    w = f" {word} "
    return [x for x in (w[i : i + n] for i in range(len(w) - n + 1)) if x != " "]


def brute_model(rows):
    from collections import Counter, defaultdict

    counts = [defaultdict(Counter) for _ in range(g.MAX_ORDER + 1)]
    for lang, text in rows:
        for w in runs(text):
            counts[0][w][lang] += 1
            for n in range(1, g.MAX_ORDER + 1):
                for x in grams(w, n):
                    counts[n][x][lang] += 1
    langs = sorted({x for x, _ in rows})
    totals = [{x: sum(c[x] for c in level.values()) for x in langs} for level in counts]
    return langs, counts, totals


def brute_predict(model, text):
    import math

    langs, counts, totals = model
    log = lambda n, x, lang: math.log((counts[n][x][lang] + g.SMOOTH) / (totals[n][lang] + g.SMOOTH * (len(counts[n]) + 1)))
    sums, got = dict.fromkeys(langs, 0.0), 0
    words = runs(text or "")
    for w in words:
        for n in range(g.MAX_ORDER + 1):
            known = [x for x in ([w] if n == 0 else grams(w, n)) if x in counts[n]] if n == 0 else []
            order = 0 if n == 0 else g.MAX_ORDER + 1 - n
            known = known or [x for x in (grams(w, order) if order else []) if x in counts[order]]
            if known:
                got += 1
                for lang in langs:
                    sums[lang] += sum(log(order, x, lang) for x in known) / len(known)
                break
    if not words:
        return "und", 0.0
    mean = {x: s / max(got, 1) for x, s in sums.items()}
    top = max(mean.values())
    best = min(x for x in langs if mean[x] >= top - 1e-12)
    return best, 1 / sum(math.exp(v - mean[best]) for v in mean.values())


def test_whole_table_equals_brute_force(spark):
    """Every prediction and score of the query; the table is small enough that the sample is all of it."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").collect()
    assert len(docs) <= g.MAX_ROWS
    model = brute_model([(r.lang, r.text) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and r.text is not None])
    got = {r.doc_id: r for r in g.op10_language_id(spark, sf).collect()}
    for r in docs:
        lang, score = brute_predict(model, r.text)
        assert abs(got[r.doc_id].score - score) < 1e-4, r.doc_id
        assert got[r.doc_id].lang_pred == lang


def test_any_labels(spark, make_docs):
    rows = [(f"l{k}", f"wort{chr(97 + k % 26)}{chr(97 + k // 26)} abc") for k in range(80)] + [("h", "heading"), ("ord", "ordinal"), ("total", "sum"), ("`a`.b", "tick"), ("", "empty")]
    m = g.fit(spark.createDataFrame(rows, "lang string, text string"), F.col("lang"), F.col("text"), F.col("text"))
    assert len(m.langs) == len(rows)
    got = [r.lang_pred for r in g.predict(make_docs([t for _, t in rows]), m).orderBy("doc_id").collect()]
    assert got[80:] == ["h", "ord", "total", "`a`.b", ""] and got[:80] == [f"l{k}" for k in range(80)]
