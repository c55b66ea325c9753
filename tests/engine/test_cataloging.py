"""Catalog runs: failures stay with their row, and a second run does only what is left."""

import datetime

import pytest
from pyspark.sql import functions as F

from docloom.operators import cataloging as c

FILES = "id long, url string, sha256 string, title string, source_site string, original_filename string, local_path string, content binary"
ITEMS = "file_url string, file_sha256 string, title string, source_site string, original_filename string, local_path string, keywords string, summary string, category string, catalog_version string, processed_at timestamp, status string, error string, markdown_content string"
LONG = b"The premium rate of this risk model is high. Capital is held against it, says the report."


def now(day):
    return F.lit(f"2024-01-{day:02d}").cast("timestamp")


@pytest.fixture()
def files(spark):
    contents = [LONG, b"<html><body><p>A page about machine learning and pricing.</p></body></html>", b"\xff\xfe broken", b"%PDF-1.7 x", None, b"", b"   \n ", LONG, LONG]
    rows = [(i, f"u{i}", f"s{i}", None if i == 7 else f"Title {i}", None if i == 8 else f"Site{i % 2}.org", f"f{i}", "" if i == 8 else f"/p/{i}", x) for i, x in enumerate(contents)]
    return spark.createDataFrame(rows, FILES)


def by_url(df):
    return {r.file_url: r for r in df.collect()}


def test_each_row_has_its_own_outcome(spark, files):
    run = c.run(files, spark.createDataFrame([], ITEMS), "v1", now(1), source="source")
    got = by_url(run.outcomes)
    assert {u: (r.status, r.error) for u, r in got.items()} == {
        "u0": ("ok", None),
        "u1": ("ok", None),
        "u2": ("error", "text is not UTF-8"),
        "u3": ("error", "no reader for pdf"),
        "u4": ("error", "File not found: /p/4 (orig: /p/4)"),
        "u5": ("error", "empty extracted text"),
        "u6": ("error", "empty extracted text"),
        "u7": ("ok", None),
    }
    assert got["u1"].category == "AI; Pricing" and "machine learning" in got["u1"].summary
    assert (got["u3"].keywords, got["u3"].summary, got["u3"].category) == ("[]", "", "")
    s = run.stats.first()
    assert (s.scanned, s.processed, s.written, s.skipped_ai, s.errors, s.missing_files) == (8, 3, 3, 0, 5, 1)
    assert s.error_samples == [got[u].error for u in ("u6", "u5", "u4", "u3", "u2")]


def test_a_second_run_takes_what_is_new_changed_or_blank(spark, files):
    first = c.run(files, spark.createDataFrame([], ITEMS), "v1", now(1), source="source").catalog
    changed = files.withColumn("sha256", F.when(F.col("id") == 0, "other").otherwise(F.col("sha256"))).withColumn("content", F.when(F.col("id") == 2, F.lit(LONG)).otherwise(F.col("content")))
    second = c.run(changed, first, "v1", now(2), source="source")
    assert set(by_url(second.outcomes)) == {"u0", "u2", "u3", "u4", "u5", "u6"}
    after = by_url(second.catalog)
    assert len(after) == 8 and after["u2"].status == "ok" and after["u0"].file_sha256 == "other"
    assert {u for u, r in after.items() if r.processed_at == datetime.datetime(2024, 1, 1)} == {"u1", "u7"}
    again = c.run(changed, second.catalog, "v1", now(3), source="source")
    assert set(by_url(again.outcomes)) == {"u3", "u4", "u5", "u6"}
    assert set(by_url(c.run(changed, second.catalog, "v2", now(3), source="source").outcomes)) == {f"u{i}" for i in range(8)}
    assert set(by_url(c.run(changed, second.catalog, "v1", now(3), source="source", skip_existing=False).outcomes)) == {f"u{i}" for i in range(8)}


def test_choice_of_candidates(spark, files):
    none = spark.createDataFrame([], ITEMS)
    urls = lambda **k: [r.url for r in c.candidates(files, none, "v1", **k).collect()]
    assert sorted(urls(sites=" site1 , ,nowhere")) == ["u1", "u3", "u5", "u7"]
    assert urls(limit=3, offset=1) == ["u6", "u5", "u4"]
    ok = c.run(files, none, "v1", now(1), source="source").catalog.withColumn("summary", F.lit("x"))
    assert c.candidates(files, ok, "v1").count() == 0
    assert c.candidates(files, ok, "v1", retry_errors=True).count() == 5


def test_skipped_rows(spark):
    rows = spark.createDataFrame([("u1", "t", "of an it"), ("u2", "Deep Learning", "of an it"), ("u3", None, "plain words here"), ("u4", "t", None), ("u5", "t", " \n")], "url string, title string, markdown_content string")
    got = {r.url: (r.status, r.category, r.error) for r in c.described(rows, ai_only=True).collect()}
    assert got["u1"] == ("skipped", c.LEFT_OUT, None)
    assert (got["u2"][0], got["u3"][0]) == ("ok", "ok")
    assert got["u4"] == got["u5"] == ("error", "", c.NO_MARKDOWN)
    with pytest.raises(ValueError):
        c.described(rows, source="elsewhere")


def test_full_build_and_report(spark, files, tmp_path):
    assert [r.url for r in c.build(files, limit=2, offset=1).collect()] == ["u1"]
    items = c.build(files)
    assert {r.url for r in items.collect()} == {"u0", "u1", "u7"}
    c.write_report(items.filter("url = 'u0'"), str(tmp_path / "r"))
    c.write_report(items.filter("url <> 'u0'"), str(tmp_path / "r"), append=True)
    lines = [x.strip() for p in sorted((tmp_path / "r").rglob("*.txt")) for x in p.read_text().splitlines()]
    assert lines[:2] == ["| category | source_site | title | original_filename | keywords | summary | url | local_path |", "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    assert len(lines) == 5 and all(x.count("|") == 9 for x in lines)


def test_categories_by_terms(spark):
    sets = {"A": ("one", "Two"), "B": ("two", "three"), "C": ("zzz",)}
    row = spark.createDataFrame([("TWO three", "x", ["one"]), ("", None, None), (None, "zzz", None)], "text string, title string, keys array<string>")
    got = row.select(c.categorize_by_terms(F.col("text"), F.col("title"), F.col("keys"), sets), c.categories_by_terms(F.col("text"), F.col("title"), F.col("keys"), sets)).collect()
    assert [tuple(r) for r in got] == [("A", ["A", "B"]), ("", []), ("C", ["C"])]
