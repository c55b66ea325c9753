from pyspark.sql import functions as F

from docloom.operators import builder, router
from docloom.sources import crawl

TEXT = "intro line\n# Capital rule\nNet Premium = PV Benefits / PV Premiums.\n| a = b | c |\n## Article 19 scope\nwords here\n"


def test_sections_formulas_relations(spark):
    docs = spark.createDataFrame([("d1", "doc://x/Rule-5.pdf", "Regulation 12 on capital, Article 19", TEXT), ("d2", "u", "", ""), ("d3", "u", None, None)], "doc_id string, file_url string, title string, text string")
    secs = builder.sections(docs)
    got = [(r.section_id, r.heading) for r in secs.orderBy("pos").collect()]
    assert got == [("d1#section-1", "Markdown"), ("d1#section-2", "Capital rule"), ("d1#section-3", "Article 19 scope")]
    f = builder.formulas(secs).collect()
    assert [(r.formula_id, r.formula_text, r.terms) for r in f] == [("d1#section-2#formula-2", "Net Premium = PV Benefits / PV Premiums.", ["Net Premium"])] or f[0].terms == ["Net Premium"]
    aliases = builder.title_aliases(docs.filter("doc_id = 'd1'"))
    assert aliases.first().aliases == ["Regulation 12 on capital, Article 19", "Rule-5", "Regulation 12", "Article 19"]
    edges = builder.relations(docs, secs, aliases)
    assert edges.groupBy("relation_type").count().orderBy("relation_type").collect() == [("alias_of", 4), ("has_section", 3)]
    lost = builder.dangling(secs, "doc_id", docs.filter("doc_id <> 'd1'"), "doc_id", "section without document")
    assert lost.count() == 3


def test_fingerprint_ignores_order(spark):
    a = spark.range(500).withColumn("v", F.col("id") * 3)
    one = builder.fingerprint(a, "id").first()[0]
    assert one.startswith("rdsnap_") and one == builder.fingerprint(a.repartition(9).orderBy(F.desc("v")), "id").first()[0]
    assert one != builder.fingerprint(a.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v"))), "id").first()[0]
    assert one != builder.fingerprint(a.union(a.limit(1)), "id").first()[0]


def test_routing(spark):
    rows = [("What is the premium",), ("compare a and b",), ("How to file",), ("hello",)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string").select(router.intent(F.col("q"))).collect()]
    assert got == ["explanatory", "comparative", "procedural", "general"]


def test_crawl_is_bounded_and_stays_on_the_host(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    html = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links)
    pages = [("http://h.org/a/i.html", html("b.html", "/c", "http://other.org/x", "mailto:x@y", "doc.pdf#p2", "//h.org/d")), ("http://h.org/c", html("/e")), ("http://h.org/e", html("/f", "/a/i.html")), ("http://h.org/f", html("/g"))]
    df = spark.createDataFrame(pages, "url string, html string")
    got = {r.url: (r.depth, r.kind) for r in crawl.crawl(df, spark.createDataFrame([("http://h.org/a/i.html",)], "url string"), 3).collect()}
    assert got == {"http://h.org/a/i.html": (0, "page"), "http://h.org/a/b.html": (1, "page"), "http://h.org/c": (1, "page"), "http://h.org/a/doc.pdf": (1, "file"), "http://h.org/d": (1, "page"), "http://h.org/e": (2, "page"), "http://h.org/f": (3, "page")}
