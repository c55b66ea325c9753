import random
import re

from pyspark.sql import functions as F

from docloom.llm import neardup as n
from docloom.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs):
    texts = {}
    for d, t in docs:
        texts.setdefault(t or "", []).append(d)
    keys = list(texts)
    sets = [grams(t) for t in keys]
    links = {i: set() for i in range(len(keys))}
    for i in range(len(keys)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if u and sets[i] and sets[j] and len(sets[i] & sets[j]) / u >= 0.8 - 1e-9:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in range(len(keys)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        cls = min(min(texts[keys[j]]) for j in seen)
        for d in texts[keys[i]]:
            out[d] = (cls, len(links[i]), len(texts[keys[i]]))
    return out


def test_bands_reach_recall():
    b, r = n.choose_bands(0.8, 0.999, 128)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 128


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in n.op7_minhash_join(spark, sf).collect()}
    assert got == brute(docs)
    assert any(v[1] for v in got.values())


def test_large_group_in_small_blocks(spark, make_docs):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(900)}" for _ in range(200)]
    texts = {}
    for i in range(70):
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(200)] = f"x{rnd.randrange(50)}"
        texts[i] = " ".join(w)
    texts |= {100: None, 101: "", 102: "!!!", 103: "one two", 104: "ONE  two", 105: "one two three"}
    docs = make_docs(texts).withColumn("text_key", F.lit("x")).withColumn("node", F.lit(1)).withColumn("comp", F.lit(2))
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in n.jaccard_classes(docs, block=16).collect()}
    assert got == brute(list(texts.items()))
    assert n.one_per_class(docs).count() == len({v[0] for v in got.values()})


def test_repeats_and_empty(spark, make_docs):
    docs = make_docs(["a b c d e f"])
    assert [(r.class_id, r.n_copies) for r in n.jaccard_classes(docs.union(docs)).collect()] == [(0, 2), (0, 2)]
    assert n.one_per_class(docs.union(docs)).count() == 1
    assert n.jaccard_classes(docs.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (60, 61), (61, 60)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {60: 60, 61: 60}


def test_null_ids(spark, make_docs):
    docs = make_docs(["a b c d e f", "g h i j k l m"]).union(make_docs({None: "a b c d e f"})).union(make_docs({None: "only here one two three"}))
    got = sorted(((r.doc_id, r.class_id, r.n_copies) for r in n.jaccard_classes(docs).collect()), key=repr)
    assert got == [(0, 0, 2), (1, 1, 1), (None, 0, 2), (None, None, 1)]
    kept = sorted(((r.doc_id, r.text) for r in n.one_per_class(docs).collect()), key=repr)
    assert kept == [(0, "a b c d e f"), (1, "g h i j k l m"), (None, "only here one two three")]


def test_one_id_with_several_texts(spark, make_docs):
    """Each class keeps exactly one row, also where an id names texts of two classes or of one."""
    rows = [(0, "a b c d e f"), (0, "g h i j k l m"), (1, "g h i j k l m"), (2, "a b c d e f"), (0, "a b c d e f"), (3, "n o p q r"), (3, None), (4, "")]
    parts = [make_docs({i: t}) for i, t in rows]
    docs = parts[0]
    for part in parts[1:]:
        docs = docs.union(part)
    got = sorted((r.text or "", r.doc_id) for r in n.one_per_class(docs).collect())
    assert got == [("", 3), ("a b c d e f", 0), ("g h i j k l m", 0), ("n o p q r", 3)]


def test_clashing_names_long_texts_and_ties(spark, make_docs):
    long_ = " ".join(f"w{i}" for i in range(60_000))
    docs = make_docs({0: long_, 1: long_ + " end", 2: "short one", 3: None})
    docs = docs.union(make_docs({0: "other text here", 3: ""}))
    for c in ("kept_id", "kept_key", "own_id", "own_key", "row", "rep", "root", "node"):
        docs = docs.withColumn(c, F.lit("clash"))
    kept = n.one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, len(r.text or "")) for r in kept.collect()) == [(0, 15), (0, len(long_)), (2, 9), (3, 0)]


def test_numbers_of_texts_are_their_own(spark):
    """Hashes of four bits for 300 keys: nearly all collide, and each still has one number."""
    keys = spark.createDataFrame([(bytes([k % 256, k // 256]),) for k in range(300)], "text_key binary").repartition(5)
    got = n.numbered(keys, bits=4).collect()
    assert len(got) == 300 == len({r.node for r in got}) == len({bytes(r.text_key) for r in got})
    assert sum(0 <= r.node < 16 for r in got) == 16
    assert len({r.node for r in n.numbered(keys).collect()}) == 300 and n.numbered(keys.limit(0)).count() == 0


def test_any_column_names_and_types(spark, make_docs):
    docs = make_docs(["a b c d e f", "a b c d e f", "other words here", None]).withColumn("a.b", F.lit(1)).withColumn("back`quote", F.create_map(F.lit("k"), "doc_id")).withColumn("v", F.parse_json(F.lit('{"x":1}')))
    kept = n.one_per_class(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["back`quote"]["k"], r["a.b"]) for r in kept.collect()) == [(0, 0, 1), (2, 2, 1), (3, 3, 1)]
