import hashlib

import numpy as np
from test_op3 import brute as brute_hits
from test_op7 import brute as brute_classes
from test_op9 import PLAIN

import corpus_pipeline as p
from docloom.llm import kneser_ney, pii
from docloom.llm.tables import table


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    keep = {r.doc_id for r in kneser_ney.judged(docs, table(spark, sf, "labels")).filter("kn_keep").collect()}
    now = docs
    kept = {r.doc_id: r for r in docs.collect() if r.doc_id in keep}
    for name, stage in p.STAGES[:-1]:
        now = p.written(stage(spark, now, sf), "test-stage")
        assert now.columns == docs.columns, name
        rows = {r.doc_id: r for r in now.collect()}
        assert len(rows) == now.count()
        if stage is p.quality:
            assert rows == kept
        elif stage is p.near_duplicates:
            classes = brute_classes([(k, r.text) for k, r in kept.items()])
            kept = {k: r for k, r in kept.items() if classes[k][0] == k}
            assert rows == kept
        elif stage is p.decontamination:
            hits = brute_hits([(k, r.text) for k, r in kept.items()], items)
            assert any(h[1] for h in hits.values())
            kept = {k: r for k, r in kept.items() if not hits[k][1]}
            assert rows == kept
        else:
            assert set(rows) == set(kept)
            for k, r in rows.items():
                found = pii.detect(kept[k].text or "")
                assert (r.text == kept[k].text) == (not found) and r.lang == kept[k].lang
                assert not any(kept[k].text[a:b] in r.text for a, b, _ in found)
    texts = {r.doc_id: r.text for r in now.collect()}
    got = {r.doc_id: r for r in p.run(spark, sf).collect()}
    assert set(got) == set(texts)
    for k, r in got.items():
        ids = PLAIN.encode_ordinary(texts[k] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[k] or "").encode()).hexdigest()


def test_empty_and_null_texts(spark, sf, make_docs):
    docs = make_docs([None, "", "one two three four five six", "one two three four five six", "mail a.b@corp.example.com now please"])
    for _, stage in p.STAGES:
        docs = p.written(stage(spark, docs, sf), "test-stage")
    assert {r.doc_id for r in docs.collect()} == {0, 2, 4}
    none = make_docs(["x"]).limit(0)
    for _, stage in p.STAGES:
        none = p.written(stage(spark, none, sf), "test-stage")
    assert none.count() == 0


def test_any_columns_null_ids_and_repeated_rows(spark, sf, make_docs):
    from pyspark.sql import functions as F

    base = make_docs(["one two three four five six", "one two three four five six", "mail a.b@corp.example.com now please", None])
    docs = base.union(base).union(make_docs({None: "some other words without an id"}))
    docs = docs.withColumn("a.b", F.lit(1)).withColumn("back`quote", F.create_map(F.lit("k"), F.coalesce("doc_id", F.lit(-1).cast("long")))).withColumn("row", F.lit("x"))
    now = docs
    for name, stage in p.STAGES[:-1]:
        now = p.written(stage(spark, now, sf), "test-stage")
        assert now.columns == docs.columns, name
    rows = sorted(((r.doc_id, r["back`quote"]["k"], r["a.b"], r.row) for r in now.collect()), key=repr)
    assert rows == sorted([(0, 0, 1, "x"), (2, 2, 1, "x"), (3, 3, 1, "x"), (None, -1, 1, "x")], key=repr)
    assert {r.doc_id for r in p.STAGES[-1][1](spark, now, sf).collect()} == {0, 2, 3, None}
