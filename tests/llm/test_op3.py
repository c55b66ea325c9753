import hashlib
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    out = {}
    wins = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lens = {len(w) for w in wins}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lens:
            for i in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= got
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def test_whole_table_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in d.op3_winnowing(spark, sf).collect()}
    assert got == brute(docs, items)
    assert any(x[1] for x in got.values())


def test_edges(spark, make_docs):
    base = [f"w{i}" for i in range(40)]
    texts = [None, "", "!!! ...", " ".join(base), "X " + " ".join(base[5:15]).upper() + ", y", " ".join(base[5:14]) + " z", "short item", "a short item b short-item", "é" * 3 + " été", " ".join(base * 500)]
    items = [(1, " ".join(base[:20])), (2, "Short, item"), (3, None), (4, "..."), (5, "ÉTÉ"), (5, "été"), (6, " ".join(base[:20])), (None, "w0 w1 w2")]
    got = {r.doc_id: r for r in d.decontaminate(make_docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(list(enumerate(texts)), items)
    assert {k: (v.n_words, v.n_hit, len(v["items"]), hashlib.sha256(",".join(v["items"]).encode()).hexdigest()) for k, v in got.items()} == want
    assert got[4].n_hit == 10 and got[5].n_hit == 0 and got[7].n_hit == 4


def test_repeated_rows_and_other_columns(spark, make_docs):
    docs = make_docs(["same words here in this one"] * 1)
    twice = docs.union(docs).withColumn("n_words", F.lit(3)).withColumn("item_id", F.lit("x")).withColumn("win", F.lit(None).cast("string"))
    items = spark.createDataFrame([(1, "in this one", 0)], "item_id long, text string, doc_id long")
    rows = d.decontaminate(twice, items).collect()
    assert [(r.n_words, r.n_hit) for r in rows] == [(6, 3), (6, 3)]
    assert d.clean_documents(twice, items).count() == 0


@pytest.mark.parametrize("side", ["docs", "items"])
def test_empty_tables(spark, make_docs, side):
    docs = make_docs(["one two"])
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    out = d.decontaminate(docs.limit(0) if side == "docs" else docs, items.limit(0) if side == "items" else items).collect()
    assert [r.n_hit for r in out] == ([] if side == "docs" else [0])


def test_null_ids_are_judged_by_their_text(spark, make_docs):
    docs = make_docs({None: "one two"}).union(make_docs({None: "three"})).union(make_docs({1: "four"}))
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert sorted(r.text for r in d.clean_documents(docs, items).collect()) == ["four", "three"]


def test_clashing_names_long_texts_and_no_filter(spark, make_docs):
    base = [f"w{i}" for i in range(60)]
    texts = ["lead " * 60_000 + " ".join(base[3:31]) + " tail" * 50, " ".join(base[40:50]), " ".join(base[40:49]), None, "", "the the the the the the the the the the the the"]
    items = spark.createDataFrame([(1, " ".join(base)), (1, " ".join(base)), (2, "the " * 11)], "item_id long, text string")
    docs = make_docs(texts)
    for c in ("row", "hit_id", "hit_key", "copy_key", "text_hash", "dirty_id", "fp"):
        docs = docs.withColumn(c, F.lit("clash"))
    want = brute(list(enumerate(texts)), [(1, " ".join(base)), (2, "the " * 11)])
    for bits in (d.MOST_BLOOM_BITS, 0):
        got = {r.doc_id: r for r in d.decontaminate(docs, items, most_bits=bits).collect()}
        assert {k: (v.n_words, v.n_hit, len(v["items"]), hashlib.sha256(",".join(v["items"]).encode()).hexdigest()) for k, v in got.items()} == want
    kept = d.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]


def test_winnowing_keeps_few_and_meets_every_shared_window():
    import numpy as np

    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    kept = d._kept(h, np.zeros(len(h), np.int64), d.WINDOW, d.KGRAM)
    assert len(kept) < 0.4 * len(h)
    assert all(((kept >= i) & (kept <= i + d.WINDOW - d.KGRAM)).any() for i in range(len(h) - d.WINDOW + 1))
    part = d._kept(h[1000:1400], np.zeros(400, np.int64), d.WINDOW, d.KGRAM) + 1000
    assert set(part.tolist()) <= set(kept.tolist())


def test_repeated_words_stay_cheap(spark, make_docs):
    """Items and documents of one word, or of a short phrase, over and over: every window recurs on both sides."""
    import time

    texts = ["w " * 2000] * 150 + ["x y " * 500] * 20 + ["w " * 9 + "end", "w " * 10, "z " + "x y " * 5, "plain words of no item at all"]
    items = [(i, "w " * (50 + i)) for i in range(40)] + [(100 + i, "y x " * (20 + i)) for i in range(20)] + [(200, "z " + "x y " * 20)]
    began = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, len(r.items), r.hits) for r in d.decontaminate(make_docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert time.time() - began < 60
    few = [0, 149, 150, *range(170, 174)]
    want = brute([(i, texts[i]) for i in few], items)
    assert {i: got[i][:3] for i in few} == {i: w[:3] for i, w in want.items()}
    assert all(got[i][:3] == got[0][:3] for i in range(150)) and got[0][3] == [(0, 2000)]


def test_ranges_against_places(spark, make_docs):
    """Ranges of hits are apart, in order, and cover the words that brute force finds."""
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.choices("a b c".split(), k=rng.randrange(60))) for _ in range(80)]
    items = [(i, " ".join(rng.choices("a b c".split(), k=rng.randrange(25)))) for i in range(30)]
    want = brute(list(enumerate(texts)), items)
    for r in d.decontaminate(make_docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect():
        assert (r.n_words, r.n_hit, len(r.items)) == want[r.doc_id][:3]
        assert all(x.first + x.size < y.first for x, y in zip(r.hits, r.hits[1:])) and sum(x.size for x in r.hits) == r.n_hit


def test_any_column_names_and_types(spark, make_docs):
    docs = make_docs([" ".join(f"w{i}" for i in range(20)), "clean text", None]).withColumn("a.b", F.lit(1)).withColumn("back`quote", F.create_map(F.lit("k"), "doc_id"))
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5, 16)))], "item_id long, text string")
    kept = d.clean_documents(docs.union(docs), items)
    assert kept.columns == docs.columns and sorted((r.doc_id, r["a.b"], r["back`quote"]["k"]) for r in kept.collect()) == [(1, 1, 1)] * 2 + [(2, 1, 2)] * 2
