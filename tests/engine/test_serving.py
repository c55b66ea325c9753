"""Rules of serving: edges that the tables do not have."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import cleaning, serving
from docloom.sources import crawl
from docloom.streaming import streams


def test_rate_rules():
    assert streams.parse_rules("200 per hour, 50 per minute") == [(200, 3600.0), (50, 60.0)]
    assert streams.parse_rules(" 3 Requests/Days ,0 per second, x per day, 5 per week, 1 req per second") == [(3, 86400.0), (1, 1.0)]
    assert streams.parse_rules(None) == [] == streams.parse_rules("")


def test_manifest_edges(spark):
    kbs = spark.createDataFrame([("a",), ("b",), ("c",)], "kb_id string")
    manifests = spark.createDataFrame([("a", "ready", None, 0, None), ("b", "failed", None, 1, None)], "kb_id string, status string, built_at timestamp, doc_count long, error_message string")
    members = spark.createDataFrame([], "kb_id string, file_url string, changed_at timestamp")
    got = {r.kb_id: tuple(r)[1:] for r in serving.manifest_status(kbs, manifests, members).collect()}
    assert got == {"a": ("ready", True, 0, None), "b": ("failed", False, 0, "ready_data is unavailable"), "c": ("missing", False, 0, "ready_data manifest has not been built")}


def test_collections_of_queries(spark):
    kbs = spark.createDataFrame([(f"k{i}", f"name {i}", None, None) for i in range(6)], "kb_id string, name string, description string, categories array<string>")
    q = spark.createDataFrame([(1, None, ["name"], None), (2, None, None, None), (3, None, ["3"], ["NAME 3"])], "query_id int, q_categories array<string>, q_keywords array<string>, q_entities array<string>")
    got = {}
    for r in serving.select_for_queries(q, kbs).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.kb_id, round(r.relevance, 6)))
    assert got[1] == [(f"k{i}", 0.4) for i in range(6)]
    assert got[2] == [(f"k{i}", 0.0) for i in range(4)]
    assert got[3] == [("k3", 0.6)]
    with pytest.raises(ValueError):
        serving.select_for_queries(q, kbs, most_kbs=5)


def test_kept_files(spark):
    rows = [("/x/a.PDF", 1), ("/x/a.b.docx", 5), ("a", 5), (".pdf", 5), ("/x.d/b.txt", 0), ("b.txt", None), ("b.txt", 524288001), ("b.exe", 1)]
    got = spark.createDataFrame(rows, "p string, n long").select(serving.keepable(F.col("p"), F.col("n")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [
        (True, "Accepted"), (True, "Accepted"), (False, "Unsupported file type: "), (False, "Unsupported file type: "),
        (False, "Empty file"), (False, "File not found"), (False, "File too large (500.0 MB > 500 MB)"), (False, "Unsupported file type: .exe"),
    ]


def test_weekly_summaries(spark):
    rows = spark.createDataFrame([("2024-01-01", "b", '[{"b":1,"a":2}]', None), ("2024-01-08", "a", "broken", "{}"), ("2024-01-08", "c", "", '{"x": [1, 2]}')], "period_start string, generated_at string, files_json string, metadata_json string")
    assert [tuple(r)[2:] for r in serving.decoded_summary(rows).collect()] == [('[{"a":2,"b":1}]', "{}"), ("[]", "{}"), ("[]", '{"x":[1,2]}')]
    assert serving.latest_summary(rows).first().generated_at == "c"


def test_references(spark):
    got = spark.createDataFrame([("&amp;amp; &lt &bogus; &#x1F600;",), (None,), ("plain",)], "t string").select(cleaning.unescape_all(F.col("t"))).collect()
    assert [r[0] for r in got] == ["&amp; < &bogus; 😀", None, "plain"]


def test_crawl_follows_a_queue(spark, tmp_path):
    """The budget is spent level by level, in the order in which pages name their links."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    links = {"": ["b", "a", "x.pdf"], "b": ["e", "c", "", "a"], "a": ["d", "c"], "c": ["f"], "d": [], "e": ["y.doc"], "f": []}
    base = "http://h.org/"
    pages = spark.createDataFrame([(base + n, "".join(f'<a href="{x and base + x or base}">t</a>' for x in xs)) for n, xs in links.items()], "url string, html string")

    def queue(budget, depth):
        seen, now, files, order = set(), [("", 0)], set(), []
        while now and len(order) < budget:
            n, k = now.pop(0)
            if n in seen:
                continue
            seen.add(n)
            order.append(n)
            if k < depth:
                files |= {x for x in links[n] if "." in x}
                now += [(x, k + 1) for x in links[n] if "." not in x]
        return {base + x for x in [*order, *files]}

    seed = spark.createDataFrame([(base,)], "url string")
    for budget, depth in ((1, 3), (2, 3), (4, 3), (6, 3), (99, 1), (99, 9)):
        got = {r.url for r in crawl.crawl(pages, seed, depth, max_pages=budget).collect()}
        want = queue(budget, depth)
        assert {u for u in got if "." not in u[13:]} == {u for u in want if "." not in u[13:]}
        assert {u for u in want if "." in u[13:]} == {u for u in got if "." in u[13:]}
    assert {r.url for r in crawl.crawl(pages, seed, 5, allow=("/[ab]$",)).collect()} == {base, base + "a", base + "b"}
