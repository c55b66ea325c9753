"""Artifact folders that fail on the way, digests, parts of pages and free names against plain models."""

import hashlib
import random
import re
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.operators import naming, ready_build
from docloom.sources import artifacts, selectors


def frame(spark, n, extra=""):
    return spark.range(n).select(F.concat(F.lit("x" + extra), "id").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))


def test_a_crash_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "ready")
    artifacts.publish(spark, root, "v1", {"a.jsonl": frame(spark, 5), "b.jsonl": frame(spark, 3)}, "2024-01-01", profile="p")
    broken = frame(spark, 4).withColumn("v", F.raise_error(F.lit("disk full")).cast("long"))
    with pytest.raises(Exception):  # noqa: B017
        artifacts.publish(spark, root, "v2", {"a.jsonl": frame(spark, 9), "b.jsonl": broken}, "2024-01-02")
    assert artifacts.versions(spark, root) == ["v1"]
    manifest, got = artifacts.open_version(spark, root)
    assert (manifest["version"], manifest["profile"], got["a.jsonl"].count(), got["b.jsonl"].count()) == ("v1", "p", 5, 3)
    assert sorted(tuple(r) for r in got["b.jsonl"].collect()) == [("x0", 0), ("x1", None), ("x2", 2)]
    artifacts.publish(spark, root, "v2", {"a.jsonl": frame(spark, 9)}, "2024-01-02")
    assert artifacts.versions(spark, root) == ["v1", "v2"]
    assert artifacts.open_version(spark, root)[1]["a.jsonl"].count() == 9
    assert artifacts.open_version(spark, root, "v1")[1]["a.jsonl"].count() == 5
    with pytest.raises(ValueError):
        artifacts.publish(spark, root, "v2", {"a.jsonl": frame(spark, 1)}, "2024-01-03")
    for bad in ("../x", "", ".hidden", "a/b"):
        with pytest.raises(ValueError):
            artifacts.publish(spark, root, bad, {}, "2024")
    with pytest.raises(artifacts.Mismatch):
        artifacts.open_version(spark, str(tmp_path / "nothing"))


def test_readers_refuse_what_the_manifest_does_not_say(spark, tmp_path):
    root = tmp_path / "ready"
    artifacts.publish(spark, str(root), "v1", {"a.jsonl": frame(spark, 5), "b.jsonl": frame(spark, 0)}, "2024-01-01")
    artifacts.open_version(spark, str(root))
    part = next(p for p in (root / "v1/a.jsonl").glob("part-*") if p.stat().st_size)
    Path(f"{part.parent}/.{part.name}.crc").unlink(missing_ok=True)
    old = part.read_bytes()
    for new in (old.replace(b"x", b"y", 1), old + old.splitlines(keepends=True)[0], b""):
        part.write_bytes(new)
        with pytest.raises(artifacts.Mismatch):
            artifacts.open_version(spark, str(root))
        artifacts.open_version(spark, str(root), verify=False)
    part.write_bytes(old)
    artifacts.open_version(spark, str(root))
    (root / "v1/b.jsonl").rename(root / "v1/c.jsonl")
    with pytest.raises(artifacts.Mismatch):
        artifacts.open_version(spark, str(root))


def test_digests(spark, tmp_path):
    def plain(lines):
        items = [(h, f"{h}:{n}") for h, n in Counter(hashlib.sha256(x.encode()).hexdigest() for x in lines).items()]
        width = 0
        while 256 * 16**width < len(items):
            width += 1
        for k in range(width, -1, -1):
            groups = {}
            for h, item in items:
                groups.setdefault(h[:k], []).append(item)
            items = [(p, f"{p}={hashlib.sha256(','.join(sorted(xs)).encode()).hexdigest()}") for p, xs in groups.items()]
        return items[0][1].removeprefix("=") if items else hashlib.sha256(b"").hexdigest()

    for n in (0, 1, 5, 300, 9000):
        lines = [f"line {i % max(1, n - 3)} é" for i in range(n)]
        got = artifacts.lines_digest(spark.createDataFrame([(x,) for x in lines], "t string").repartition(3))
        assert (got.rows, got.sha256) == (n, plain(lines))
    for name, extra, parts, at in (("a", "", 1, "2024"), ("b", "", 4, "2025"), ("c", "z", 1, "2024")):
        artifacts.publish(spark, str(tmp_path / name), "v", {"x.jsonl": frame(spark, 50, extra).repartition(parts)}, at, source_db=name)
    digest = {n: artifacts.artifact_digest(spark, str(tmp_path / n / "v"), ["x.jsonl", artifacts.MANIFEST]) for n in "abc"}
    assert digest["a"] == digest["b"] != digest["c"]
    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/one").write_bytes(b"1")
    (tmp_path / "t/sub/two").write_bytes(b"\xff\x00")
    want = hashlib.sha256(b"".join(f"{n}\0{hashlib.sha256(c).hexdigest()}\0".encode() for n, c in (("one", b"1"), ("sub/two", b"\xff\x00")))).hexdigest()
    assert artifacts.tree_digest(spark, str(tmp_path / "t")) == (want, ["one", "sub/two"])


def test_profiles_and_terms(spark):
    md = "# Part\nNet Premium = PV Benefits / 12\n| Term | Term | |\n|---|---|---|\n|---|---|---|\n| Discount rate | 3 | x |\n## Other\nplain words"
    docs = spark.createDataFrame([("d1", "http://x/a-7.pdf", "Rule 7", md), ("d2", "http://x/b", None, None)], "doc_id string, file_url string, title string, md string")
    got = ready_build.build(docs, "formula")
    assert list(got) == list(artifacts.PROFILES["formula"])
    cat = {r.doc_id: r for r in got["doc_catalog.jsonl"].collect()}
    assert (cat["d2"].title, cat["d2"].category, cat["d2"].keywords, cat["d2"].rag_chunk_count) == ("http://x/b", "general", [], 0)
    assert [(r.headers, r.rows, r.caption) for r in got["tables_structured.jsonl"].collect()] == [(["---", "---_2", "---_3"], [["Discount rate", "3", "x"]], "Part")]
    terms = {r.term_id: r.term for r in got["calculation_terms.jsonl"].collect()}
    assert terms["d1#section-1#term-net-premium"] == "Net Premium" and terms["d1#section-1#term-discount-rate"] == "discount rate"
    kinds = Counter(r.relation_type for r in got["relations_graph.json"].collect())
    assert kinds["document_has_section"] == 2 and kinds["document_has_formula"] == 1 and kinds["alias_of"] >= 3 and kinds["document_has_calculation_term"] == len(terms)
    assert list(ready_build.build(docs)) == ["doc_catalog.jsonl", "sections.jsonl"]
    with pytest.raises(ValueError):
        ready_build.build(docs, "other")


# --- selectors ----------------------------------------------------------------------------


class Tree(HTMLParser):
    """Elements as (tag, attributes, parent, start, end) by a plain walk."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.lines = [0]
        for i, c in enumerate(page):
            if c == "\n":
                self.lines.append(i + 1)
        self.page, self.all, self.open = page, [], []
        self.feed(page)
        self.close()
        for e in self.open:
            e["end"] = len(page)

    def here(self):
        line, col = self.getpos()
        return self.lines[line - 1] + col

    def handle_starttag(self, tag, attrs):
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        e = {"tag": tag, "attrs": own, "up": self.open[-1] if self.open else None, "start": self.here(), "end": self.here() + len(self.get_starttag_text())}
        self.all.append(e)
        if tag not in selectors.VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in selectors.VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.open):
            at = self.here()
            stop = self.page.index(">", at) + 1
            while True:
                e = self.open.pop()
                e["end"] = stop if e["tag"] == tag else at
                if e["tag"] == tag:
                    break


def fits(e, word):
    for token in re.findall(r"\[[^\]]*\]|[#.]?[\w*-]+", word):
        if token.startswith("["):
            key, _, value = token[1:-1].partition("=")
            ok = key in e["attrs"] and value in ("", e["attrs"][key])
        elif token.startswith("#"):
            ok = e["attrs"].get("id") == token[1:]
        elif token.startswith("."):
            ok = token[1:] in e["attrs"].get("class", "").split()
        else:
            ok = token in ("*", e["tag"])
        if not ok:
            return False
    return True


def matches(e, words):
    """Right to left over the ancestors, all ways tried."""
    if not fits(e, words[-1]):
        return False
    if len(words) == 1:
        return True
    if words[-2] == ">":
        return e["up"] is not None and matches(e["up"], words[:-2])
    up = e["up"]
    while up is not None:
        if matches(up, words[:-1]):
            return True
        up = up["up"]
    return False


def test_selectors_against_a_plain_tree():
    rng = random.Random(3)
    bits = ["<div class='a b'>", "<div id=x>", "<p class=b>", "</p>", "</div>", "</div>", "<b>", "</b>", "text", "<br>", "<img src=\"a>b\" class=a>", "<!-- <div class='a'> -->", "<script>var a='<div class=a>';</script>", "\n", "<p>", "</span>", "<span data-k=v>", "<DIV CLASS='B a'>", "</DIV>"]
    chosen = ["div", ".a", "#x", "p.b", "div p", "div > p", "div .a, p", ".a > .a", "div.a.b p.b", "[data-k=v]", "*", "div[id] > *", "div div > b"]
    for _ in range(300):
        page = "".join(rng.choices(bits, k=rng.randrange(16)))
        tree = Tree(page)
        for s in chosen:
            alternatives = [part.replace(">", " > ").split() for part in s.split(",")]
            want = [page[e["start"] : e["end"]] for e in tree.all if any(matches(e, w) for w in alternatives)]
            assert selectors.select(page, selectors.parse(s)) == want, (page, s)


def test_selector_texts(spark):
    pages = spark.createDataFrame([("<main><p>a</main><main>b",), (None,), ("<p>x",)], "h string")
    got = [tuple(r) for r in pages.select(selectors.content_html(F.col("h"), "main"), selectors.content_parts(F.col("h"), "main > p")).collect()]
    assert got == [("<main><p>a</main>\n<main>b", ["<p>a"]), (None, []), (None, [])]
    for bad in ("", "a >", "> a", "a,,b", "a > > b", "a:hover", "a b!", "ab.c d e f .g h#"):
        with pytest.raises(ValueError):
            selectors.parse(bad)


# --- names --------------------------------------------------------------------------------


def test_free_names_against_a_plain_walk(spark):
    rng = random.Random(8)
    pool = ["a.pdf", "a_1.pdf", "a_2.pdf", "a_3.pdf", "b", "b_1", "b_2", ".env", ".env_1", "_1.pdf", "x.tar.gz", "x.tar_1.gz", "a_1_1.pdf", "a_01.pdf"]
    rows = [(f"f{rng.randrange(3)}" if rng.random() < 0.9 else None, rng.choice(pool), i) for i in range(400)]
    rows += [("hot", "same.txt", 1000 + i) for i in range(1500)]
    there = [("f0", "a.pdf"), ("f0", "a_2.pdf"), ("f1", "b_1"), ("f2", ".env_1"), ("hot", "same_7.txt"), ("hot", "same_8.txt"), (None, "x.tar.gz"), ("f0", "a.pdf")]

    def split(name):
        at = name.rfind(".")
        return (name, "") if at <= 0 or at == len(name) - 1 else (name[:at], name[at:])

    used = {(f or "", n) for f, n in there}
    first = {}
    for f, n, i in sorted(rows, key=lambda r: r[2]):
        first.setdefault((f or "", n), i)
    want = {i: n for (f, n), i in first.items() if (f, n) not in used}
    fixed = used | set(first)
    for f, n, i in sorted(rows, key=lambda r: r[2]):
        if i not in want:
            stem, suffix = split(n)
            k = 1
            while (f or "", f"{stem}_{k}{suffix}") in fixed:
                k += 1
            fixed.add((f or "", f"{stem}_{k}{suffix}"))
            want[i] = f"{stem}_{k}{suffix}"
    new = spark.createDataFrame(rows, "folder string, name string, id int").repartition(6)
    out = naming.without_conflicts(new, spark.createDataFrame(there, "folder string, name string"), ["id"]).collect()
    assert {r.id: r.free_name for r in out} == want and len(out) == len(rows)
    assert len({(r.folder, r.free_name) for r in out}) == len(rows)
    assert naming.without_conflicts(new.limit(0), new.select("folder", "name"), ["id"]).count() == 0


def test_safe_names(spark):
    got = [r[0] for r in spark.createDataFrame([(' a<b>:"c" / d\\e|f?*g\t h ',), ("  ",), (None,), ("\u0000x  y",), ("...",)], "n string").select(naming.safe_name(F.col("n"))).collect()]
    assert got == ["a_b_c_ _ d_e_f_g h", "file", "file", "x y", "..."]
    parts = spark.createDataFrame([("a.b.c",), (".a",), ("a.",), ("a",), ("..",), (".a.b",)], "n string").select(naming.stem_of(F.col("n")), naming.suffix_of(F.col("n"))).collect()
    assert [tuple(r) for r in parts] == [("a.b", ".c"), (".a", ""), ("a.", ""), ("a", ""), ("..", ""), (".a", ".b")]
