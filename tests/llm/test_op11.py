import hashlib
import random
import re

from docloom.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    t = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(t), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(t), "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    made = fim.transformed(docs)
    got = made.select("*", fim.restored(made["output"], made["form"]).alias("restored")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((brute(*r) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.restored) for r in got), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    return got


def test_random_texts(spark, make_docs):
    rng = random.Random(11)
    parts = ["a", "Zz", "word", " ", "  ", "\n", "é", "日本", "😀", "é", "[", "@", "`", "{", "<", "<P", "<S", ">", "<M", "P>", "1", "\u0000", "ÿ"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(2000)]
    forms = {r.form for r in check(make_docs(texts).repartition(3))}
    assert forms == {"plain", "spm", "psm"}


def test_edges(spark, make_docs):
    long = ("abc déf 日本 " * 100_000) + "x" * 500_000 + "." * 500_000
    texts = [None, "", "x", "é", "has <P> in it", "<S>", "a<M>b", long, "😀" * 5, "same", "same"] + ["one two three"] * 40
    got = check(make_docs(texts))
    assert {r.form for r in got if r.doc_id in (0, 1, 4, 5, 6)} == {"plain"}
    rows = spark.createDataFrame([(None, "some text here", 1), (3, "a b c", 2), (3, "a b c", 2)], "doc_id long, text string, n int")
    assert len(check(rows)) == 3
    assert check(rows.limit(0)) == []


def test_runs_are_maximal_and_cut_at_every_unit(spark, make_docs):
    texts = ["ab, c", None, "日x", "", "word", "  "]
    got = {r.doc_id: r for r in fim.encode_runs(make_docs(texts)).collect()}
    assert (got[0].run_start, got[0].run_letters, got[0].units_before) == ([0, 2, 4], [True, False, True], [0, 1, 3])
    assert got[1].run_start == [] == got[3].run_start
    assert (got[2].run_start, got[2].units_before) == ([0, 1], [0, 1])
    assert got[5].run_start == [0]
    import numpy as np

    for text in ("ab, c日日d", "", "...", "abc"):
        raw = np.frombuffer(text.encode(), np.uint8)
        runs, t = fim.class_runs(raw, np.array([0, len(raw)])), UNIT.findall(text)
        assert runs.units().tolist() == [len(t)]
        assert [int(runs.cut(np.array([u]))[0]) for u in range(len(t) + 1)] == [len("".join(t[:u])) for u in range(len(t) + 1)]
