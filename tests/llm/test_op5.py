import hashlib

from pyspark.sql import functions as F

from docloom.llm import warc_fixity as w


def record(p, url, html):
    body = (html or "").encode()
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'none' if p is None else p}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_whole_table(spark, sf):
    sf = "/root/testdata/sf0.01"
    pages = sorted((r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect())
    want, offset = [], 0
    for p, url, html in pages:
        if p % 1024 == 0:
            offset = 0
        raw = record(p, url, html)
        mark = p * 48271 % 1009
        want.append((p, p // 1024, offset, len(raw), hashlib.sha256(raw).hexdigest(), {7: "corrupt", 11: "missing"}.get(mark, "ok")))
        offset += len(raw)
    got = sorted(tuple(r) for r in w.op5_merkle_fixity(spark, sf).collect())
    assert got == want


def statuses(a, b):
    return sorted(((r.page_id, r.status) for r in w.audit(a, b).collect()), key=repr)


def test_faults_of_all_kinds(spark):
    schema = "page_id long, url string, html string"
    rows = [(i * 37, f"u{i}", f"body {i}" * (i % 5)) for i in range(200)] + [(None, None, None), (5, None, "x"), (5, "y", "z"), (1 << 34, "far", "away")]
    a = spark.createDataFrame(rows, schema).withColumn("status", F.lit("s"))
    assert set(x for _, x in statuses(w.records(a), w.records(a))) == {"ok"}
    other = [r for r in rows if r[0] != 37 * 9]
    other = [(p, u, h + "!") if p in (0, 37 * 150, 1 << 34) else (p, u, h) for p, u, h in other] + [(3, "new", "new"), (5, "y", "z")]
    got = statuses(w.records(a), w.records(spark.createDataFrame(other, schema)))
    bad = [x for x in got if x[1] != "ok"]
    assert bad == sorted([(0, "corrupt"), (3, "extra"), (5, "corrupt"), (5, "corrupt"), (37 * 9, "missing"), (37 * 150, "corrupt"), (1 << 34, "corrupt")], key=repr)
    assert len(got) == len(rows) + 1


def test_order_does_not_matter_and_empty(spark):
    a = spark.createDataFrame([(i, "u", "b") for i in range(40)], "page_id long, url string, html string")
    shuffled = a.repartition(7).orderBy(F.desc("page_id"))
    assert {x for _, x in statuses(w.records(a), w.records(shuffled))} == {"ok"}
    assert statuses(w.records(a.limit(0)), w.records(a.limit(0))) == []
    assert {x for _, x in statuses(w.records(a), w.records(a.limit(0)))} == {"missing"}
    assert {x for _, x in statuses(w.records(a.limit(0)), w.records(a))} == {"extra"}


def test_descent_reads_only_differing_branches(spark):
    a = spark.createDataFrame([(i, "u", "b") for i in range(3000)], "page_id long, url string, html string")
    b = a.withColumn("html", F.when(F.col("page_id") == 1777, "c").otherwise(F.col("html")))
    ta, tb = (w.tree(w.manifest(w.records(x)), 4) for x in (a, b))
    assert [t.count() for t in ta] == [3000, 94, 3, 1]
    assert [r.slot for r in w.differing_slots(ta, tb).collect()] == [1777]
