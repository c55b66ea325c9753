"""Removal, citations and evaluation against plain models."""

import random

from pyspark.sql import functions as F

from docloom.operators import answers, evaluation

ITEM = "struct<doc_id:string,file_url:string,title:string,term:string,source:string,sources:array<string>>"


def similar(a, b):
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return min(len(a), len(b)) / max(len(a), len(b))
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else 0.0


def test_greedy_removal(spark):
    rng = random.Random(2)
    words = ["one", "two", "three", "four", " ", "\n"]
    rows = [(q, i, " ".join(rng.choices(words, k=rng.randrange(7))) if rng.random() < 0.95 else None) for q in range(40) for i in range(rng.randrange(30))]
    table = spark.createDataFrame(rows, "q int, score int, `the text` string").repartition(5)
    for above, k in ((0.95, 50), (0.4, 12), (0.0, 3)):
        want = set()
        for q in range(40):
            kept = []
            for i, text in [(i, t or "") for p, i, t in sorted(rows, key=lambda r: -r[1]) if p == q][:k]:
                if all(similar(text, o) <= above for o in kept):
                    kept.append(text)
                    want.add((q, i))
        got = answers.without_similar(table, "q", [F.desc("score")], "the text", k, above)
        assert got.columns == ["q", "score", "the text", "place"]
        assert {(r.q, r.score) for r in got.collect()} == want
    assert answers.without_similar(table.limit(0), "q", [F.desc("score")], "the text").count() == 0


def test_citations_without_names(spark):
    rows = spark.createDataFrame([("q", 3, "f", "u", "c1"), ("q", 2, "g", "u", "c2"), ("q", 1, None, None, None), ("q", 0, "", " ", ""), ("p", 9, "f", None, "c")], "q string, similarity_score int, filename string, file_url string, chunk_id string")
    full = rows.withColumns({"kb_id": F.lit(None).cast("string"), "kb_name": F.lit("n"), "content": F.lit(" " + "x" * 300)})
    got = sorted((r.q, r.place, r.filename, r.chunk_id, r.quote) for r in answers.citations(full, "q", [F.desc("similarity_score")]).collect())
    assert got == [("p", 1, "f", "c", "x" * 279), ("q", 1, "f", "c1", "x" * 279), ("q", 3, "", "", "x" * 279), ("q", 4, "", "", "x" * 279)]


def test_small_columns(spark):
    row = spark.createDataFrame([("ﬁne  Ⅳ \n\t x" + "y" * 20, "1.5", "-1"), (None, "nan", "high")], "t string, a string, b string")
    got = row.select(answers.bounded_text(F.col("t"), 9), answers.score_of(F.col("a")), answers.score_of(F.col("b")), answers.cut(F.coalesce("t", F.lit("")), 4), answers.first_text(F.lit(None), F.lit(" "), F.lit(" z "))).collect()
    assert tuple(got[0]) == ("fine IV x", 1.5, None, "ﬁne…", "z")
    assert got[1][0] == "" and got[1][2] is None and got[1][3] == ""


def doc(e):
    return (e["doc_id"] or e["file_url"] or "").strip()


def sources(e):
    return {x.strip() for x in [*(e["sources"] or []), e["source"] or ""] if x and x.strip()}


def judge(c):
    ids, src, cit = set(c["ids"] or []), set(c["src"] or []), set(c["cit"] or [])
    cit = cit or src
    fit = lambda e, ss: (not ids or doc(e) in ids) and (not ss or sources(e) & ss)
    found = [e for e in c["evidence"] if fit(e, src or cit)]
    hits = len({doc(e) for e in found} & ids) if ids else len(found)
    source_hits = len({s for e in found for s in sources(e)} & src)
    citing = [e for e in c["citations"] if fit(e, cit) and any((e[k] or "").strip() for k in ("doc_id", "file_url", "title")) and sources(e)]
    pairs = {(d, s) for d in ids or {""} for s in cit or {""}} if ids or cit else set()
    got = {(d if ids else "", s if cit else "") for e in citing for d in [doc(e)] for s in sources(e) or {""}} & pairs
    coverage = len(got) / len(pairs) if pairs else 1.0
    answer = c["answer"] or ""
    refused = not c["evidence"] and answer == evaluation.NO_EVIDENCE
    anchored = any(len((e[k] or "").strip()) >= 4 and e[k].strip().lower() in answer.lower() for e in c["evidence"] for k in ("doc_id", "file_url", "title", "term"))
    unsupported = any(t and t.lower() in answer.lower() for t in c["bad"] or []) or (not c["evidence"] and answer != evaluation.NO_EVIDENCE) or (bool(c["evidence"]) and not anchored)
    ok = refused and not unsupported if c["none"] else hits >= c["least"] and source_hits >= len(src) and coverage >= 1 and not unsupported
    return hits, source_hits, round(coverage, 9), len(citing), refused, unsupported, bool(ok)


def test_answers_against_a_plain_judge(spark):
    rng = random.Random(7)
    pick = lambda xs, n: [rng.choice(xs) for _ in range(rng.randrange(n))]
    some = lambda *xs: rng.choice([*xs, None])

    def item():
        return {"doc_id": some("d1", "d2", ""), "file_url": some("d3", " d1 "), "title": some("Long title", "abc", " "), "term": some("reserve"), "source": some("s1", " s2 ", ""), "sources": rng.choice([None, [], ["s3", " "], ["s1", "s1"]])}

    cases = []
    for i in range(600):
        cases.append({
            "id": i, "ids": rng.choice([None, pick(["d1", "d2", "d3"], 4)]), "src": pick(["s1", "s2", "s3"], 3), "cit": rng.choice([None, pick(["s1", "s2"], 3)]), "bad": rng.choice([None, ["", "WORD"]]), "none": rng.random() < 0.3,
            "least": rng.randrange(3), "evidence": [item() for _ in range(rng.randrange(4))], "citations": [item() for _ in range(rng.randrange(4))], "answer": some(evaluation.NO_EVIDENCE, "a long Title", "some word of Reserve", ""),
        })
    schema = f"case_id int, expected_evidence_doc_ids array<string>, expected_evidence_sources array<string>, expected_citation_sources array<string>, forbidden_answer_terms array<string>, expect_no_evidence boolean, min_evidence_hits int, evidence array<{ITEM}>, citations array<{ITEM}>, answer string"
    table = spark.createDataFrame([tuple(c.values()) for c in cases], schema)
    judged = evaluation.judge_answers(table)
    got = {r.case_id: (r.evidence_hits, r.evidence_source_hits, round(r.citation_coverage, 9), r.citable_evidence, r.refused_no_evidence, r.unsupported_answer, r.passed) for r in judged.collect()}
    want = {c["id"]: judge(c) for c in cases}
    assert got == want and {w[-1] for w in want.values()} == {True, False}
    r = evaluation.answer_report(judged).first()
    none = [c["id"] for c in cases if c["none"]]
    assert (r.total_cases, r.passed) == (600, sum(w[-1] for w in want.values()))
    assert abs(r.no_evidence_refusal_rate - sum(want[i][4] for i in none) / len(none)) < 1e-9
    empty = evaluation.answer_report(evaluation.judge_answers(table.limit(0))).first()
    assert tuple(empty) == (0, 0, 0, 1.0, 1.0, 1.0, 0.0)


def test_retrieval_cases(spark):
    cases = spark.createDataFrame([(1, ["a", "b"], None, 1, 2), (2, [], ["X; y"], 1, 5), (3, None, None, 0, None), (4, ["a"], ["z"], 2, 1), (5, ["q"], None, 1, 5)], "case_id int, expected_doc_ids array<string>, expected_categories array<string>, min_hits int, top_k int")
    found = spark.createDataFrame([(1, 1, "c", "x"), (1, 2, "b", None), (1, 3, "a", "x"), (2, 1, "a", "w; Y "), (4, 1, "a", "z"), (9, 1, "a", "z")], "case_id int, rank int, doc_id string, category string")
    judged = evaluation.judge_retrieval(cases, found)
    got = {r.case_id: (r.hits, r.category_hits, r.total_retrieved, r.doc_met, r.passed) for r in judged.collect()}
    assert got == {1: (1, 0, 2, True, True), 2: (0, 1, 1, True, True), 3: (0, 0, 0, True, True), 4: (1, 1, 1, False, False), 5: (0, 0, 0, False, False)}
    assert tuple(evaluation.retrieval_report(judged).first()) == (5, 3, 2, 0.6, 2 / 3)
    assert tuple(evaluation.retrieval_report(judged.limit(0)).first()) == (0, 0, 0, 0.0, 0.0)
