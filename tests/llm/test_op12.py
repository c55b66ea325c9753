import html
import re
from html.parser import HTMLParser

import numpy as np
import pytest

from docloom.llm import dom
from docloom.llm import html_crf as h

SCHEMA = "page_id long, url string, html string, text string"


def squeezed(x):
    return " ".join(x.split())


def marked_article(page):
    """The blocks of a page of the tables, cut by patterns."""
    body = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = [squeezed(html.unescape(re.sub(r"<[^>]*>", "", x))) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in blocks if x)


@pytest.fixture(scope="module")
def model(spark):
    return h.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def texts(page):
    return [b.text for b in dom.leaf_blocks(page, dom.Paths())]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = sorted(tuple(r) for r in h.op12_html_crf(spark, sf).collect())
    want = [marked_article(r.html) for r in pages]
    assert got == sorted((r.page_id, r.url, t, len(t)) for r, t in zip(pages, want))


def test_held_out_layouts(model):
    """Pages of another seed: nearly all blocks right, and nearly all pages to the last block."""
    ex, wrong, blocks, whole = h.Extractor(model), 0, 0, 0
    pages = h.made_pages(200, 2024)
    for p in pages:
        found = list(dom.leaf_blocks(p, ex.paths))
        want = [b.text.startswith(h.MARK) for b in found]
        for b in found:
            b.text = b.text.removeprefix(h.MARK) or "."
        miss = sum(a != b for a, b in zip(want, ex.labels(found)))
        wrong, blocks, whole = wrong + miss, blocks + len(want), whole + (miss == 0)
    assert wrong / blocks < 0.02 and whole / len(pages) > 0.85


LAYOUTS = {
    "semantic": ("<body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav><main><h1>Title one</h1><p>First text here.<p>Second &amp; third.</main><aside><p>Read this too.</p></aside><footer>&copy; me</footer>", "Title one\nFirst text here.\nSecond & third."),
    "names": (
        '<div id="header">My site</div><div class="menu"><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></div><div class="post-content"><h2>The title</h2><p>Some words, and more of them.</p>'
        '<div class="ad">Buy this thing now, it is good.</div><p>Closing words.</p></div><div class="comments"><h3>Comments</h3><div class="comment"><p>I like this text a lot.</p></div></div><div class="footer">Imprint</div>',
        "The title\nSome words, and more of them.\nClosing words.",
    ),
    "within": (
        "<article><h1>Head</h1><p>One.</p><form><label>Name</label><input><button>Send</button></form><p>Two.</p><section class='comments'><p>Nice, thank you for it.</p></section></article>"
        "<div class='cookie-notice'><p>We use cookies, do you agree?</p></div>",
        "Head\nOne.\nTwo.",
    ),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(model, name):
    page, want = LAYOUTS[name]
    assert h.Extractor(model).text(page) == want


def test_blocks_of_broken_pages():
    assert texts("<p>a<p>b<b>c<p>d</p>e") == ["a", "bc", "d", "e"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><td><p>c<p>d</table>e") == ["a", "b", "c", "d", "e"]
    assert texts("x<script>var t='</p>';if(a<b){}</script>y<STYLE>p{}</Style >z") == ["xyz"]
    assert texts("a<!-- <p>b</p> -->c<!-- open <p>d") == ["ac"]
    assert texts('<a title="x>y" href=\'>\'>k</a>') == ["k"]
    assert texts("1 < 2 and 3 > 2 &lt;p&gt; &amp;amp; &copy; &#233;&#xE9; &nbsp;x&nbsp;") == ["1 < 2 and 3 > 2 <p> &amp; © éé x"]
    assert texts("a\n\t b<br>c<br/>d<hr>e</div></p></b>f") == ["a b c d", "e", "f"]
    assert texts("<div>" * 3000 + "deep" + "</div>" * 10 + "<p>x") == ["deep", "x"]
    assert texts("") == [] == texts("<p> \n </p><!doctype html><script>never closed")
    assert texts("<title>no</title><textarea>no<p></textarea>yes <span>a</span><span>b</span>") == ["yes ab"]
    assert texts("<a href='unclosed>text <p>more") == ["<a href='unclosed>text", "more"]


def test_against_a_parser_of_the_library():
    """Blocks of made pages agree with a plain walk by html.parser."""

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.now, self.skip = [], [], 0

        def cut(self):
            if text := squeezed("".join(self.now)):
                self.out.append(text)
            self.now = []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title", "textarea")
            self.now.append(" " if tag == "br" else "")
            if tag in dom.BLOCK or tag == "hr":
                self.cut()

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title", "textarea")
            if tag in dom.BLOCK:
                self.cut()

        def handle_data(self, data):
            if not self.skip:
                self.now.append(data)

    for page in h.made_pages(100, 5):
        walk = Walk()
        walk.feed(page)
        walk.close()
        walk.cut()
        assert texts(page) == walk.out


def test_viterbi_and_gradient_against_all_labellings():
    rng = np.random.default_rng(3)
    model = h.Model({}, tuple(rng.normal(size=4)), 0.3, -0.4)
    for n in range(1, 8):
        s = rng.normal(size=n).tolist()

        def value(y):
            inner = sum(model.step[2 * a + b] for a, b in zip(y, y[1:]))
            return inner + sum(x for x, a in zip(s, y) if a) + y[0] * model.first + y[-1] * model.last

        best = max(([bool(k >> i & 1) for i in range(n)] for k in range(1 << n)), key=value)
        assert h.viterbi(s, model) == best
    # with one block a chain the field is a logistic regression: its weight settles at the log odds
    chains = [[([""], i % 4 == 0)] for i in range(400)]
    fitted = h.train(chains, 600)
    assert abs(fitted.weights[""] + fitted.first + fitted.last - np.log(1 / 3)) < 0.05


def test_edges(spark, model):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<p>", "t"), (4, "u", "<article><p>a</p></article>", "t"), (4, "u", "<article><p>a</p></article>", "t"), (5, "u", "<article>" + "<p>word one, two.</p>" * 50_000 + "</article>", "t")]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r.text for r in h.extract(pages, model).collect()}
    assert (got[1], got[2], got[None], got[4]) == ("", "", "", "a")
    assert got[5] == "\n".join(["word one, two."] * 50_000)
    assert h.extract(pages, model).count() == 6 and h.extract(pages.limit(0), model).count() == 0
    assert h.fit(pages.limit(0), made=20).weights and h.train([]) == h.Model({}, (0.0, 0.0, 0.0, 0.0), 0.0, 0.0)
    assert h.Extractor(h.train([])).text("<p>x") == ""
