"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

The leaf blocks of a page are a chain of two labels, article or not.  Features of a block are
its ancestors' tags and the words of their class, id, role and itemprop values, its own tag,
and its text: number of words, share of linked characters, punctuation, digits, capitals and
marks of copyright.  Weights of features and of neighbouring labels are those of greatest
likelihood, found by forward and backward sums over all chains at once; a page is decoded by
Viterbi.

Labelled pages to train on are of two kinds, and both are bounded:

* pages of the table that mark their own article, by one ``article`` or ``main`` element, up
  to ``MAX_PAGES`` in expectation, chosen by a hash, none above ``MAX_PAGE_CHARS`` characters
  or ``MAX_BLOCKS`` blocks.  Each is used twice, once without the mark, so that other features
  have to explain it as well;
* ``MADE_PAGES`` pages made by rule from layouts with menus, headers, footers, sidebars,
  adverts, notices, forms and reader comments around and within articles.

All pages are extracted whole, whatever their size.  A null or empty page gives an empty text;
a page without an article may give one too.  Ties between labels go against the article.
Repeated rows give a row each.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import dom
from docloom.llm.tables import table

MAX_PAGES = 400
MAX_PAGE_CHARS = 1 << 16
MAX_BLOCKS = 150
MADE_PAGES = 700
LEAST_SEEN = 3
STEPS = 400
RATE = 0.15
DECAY = 2e-5
MARK = ""
MARKS = ("article", "main")
#: never part of an article that they stand in
_APART = frozenset(f"t:{t}" for t in ("nav", "aside", "footer", "form", "noscript", "button", "select", "dialog"))


def text_features(block: dom.Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    solid = len(text) - words + 1
    share = block.linked / solid
    caps = sum(map(str.isupper, text[:200]))
    digits = sum(map(str.isdigit, text[:200]))
    seen = min(len(text), 200)
    out = [
        f"p:{block.path.parent}",
        *(f"n:{w}" for w in block.path.named.split()),
        f"words:{min(words.bit_length(), 8)}",
        f"links:{0 if share == 0 else 1 if share < 0.34 else 2 if share < 0.9 else 3}",
        f"end:{text[-1] if text[-1] in '.!?:,;…。|' else 'x' if text[-1].isalnum() else 'o'}",
        f"caps:{min(4, 10 * caps // seen)}",
        f"digits:{min(4, 10 * digits // seen)}",
        f"commas:{min(3, text.count(','))}",
    ]
    if "©" in text:
        out.append("copyright")
    if "|" in text or "»" in text or "·" in text:
        out.append("dividers")
    return out


@dataclass
class Model:
    weights: dict[str, float]  # for the label article, against the other
    step: tuple[float, float, float, float]  # other to other, other to article, article to other, article to article
    first: float  # for an article at the start
    last: float  # and at the end


class Extractor:
    """Decodes pages; scores of paths are kept between pages."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.paths = dom.Paths()
        self._scores: dict[dom.Path, float] = {}

    def score(self, block: dom.Block) -> float:
        w = self.model.weights
        path = self._scores.get(block.path)
        if path is None:
            if len(self._scores) > 200_000:
                self._scores.clear()
            path = self._scores[block.path] = sum(w.get(f, 0.0) for f in sorted(block.path.features))
        return path + w.get("", 0.0) + sum(w.get(f, 0.0) for f in text_features(block))

    def labels(self, blocks: list[dom.Block]) -> list[bool]:
        return viterbi([self.score(b) for b in blocks], self.model)

    def text(self, page: str | None) -> str:
        blocks = list(dom.leaf_blocks(page or "", self.paths))
        return "\n".join(b.text for b, keep in zip(blocks, self.labels(blocks)) if keep)


def viterbi(scores: list[float], model: Model) -> list[bool]:
    """The most likely labels for the scores of the label article."""
    if not scores:
        return []
    oo, oa, ao, aa = model.step
    other, article = 0.0, model.first + scores[0]
    back = []
    for s in scores[1:]:
        to_other, to_article = article + ao > other + oo, article + aa > other + oa
        other, article = (article + ao if to_other else other + oo), (article + aa if to_article else other + oa) + s
        back.append((to_other, to_article))
    now = article + model.last > other
    out = [now]
    for to_other, to_article in reversed(back):
        now = to_article if now else to_other
        out.append(now)
    return out[::-1]


Chain = list[tuple[list[str], bool]]


def chain(blocks: list[dom.Block], labels: list[bool], without: frozenset[str] = frozenset()) -> Chain:
    return [(["", *sorted(b.path.features - without), *text_features(b)], y) for b, y in zip(blocks, labels)]


def marked_chain(page: str, paths: dom.Paths) -> Chain:
    """A labelled page whose article blocks begin with the mark."""
    blocks = list(dom.leaf_blocks(page, paths))
    labels = [b.text.startswith(MARK) for b in blocks]
    for b in blocks:
        b.text = b.text.removeprefix(MARK) or "."
    return chain(blocks, labels)


def own_chains(page: str, paths: dom.Paths) -> list[Chain]:
    """A page that marks its own article, with and without that mark; none if it doesn't or is too long."""
    blocks = list(dom.leaf_blocks(page, paths))
    low = page.lower()
    mark = next((m for m in MARKS if low.count(f"<{m}") == 1 and low.count(f"</{m}>") == 1), None)
    if mark is None or not 0 < len(blocks) <= MAX_BLOCKS:
        return []
    labels = [f"t:{mark}" in b.path.features and not b.path.features & _APART for b in blocks]
    return [chain(blocks, labels), chain(blocks, labels, frozenset(f"t:{m}" for m in MARKS))]


def train(chains: list[Chain], steps: int = STEPS) -> Model:
    """Greatest likelihood with a small penalty on the weights."""
    chains = [c for c in chains if c]
    if not chains:
        return Model({}, (0.0, 0.0, 0.0, 0.0), 0.0, 0.0)
    seen = Counter(f for c in chains for fs, _ in c for f in set(fs))
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_SEEN or f == ""))}
    chains = sorted(chains, key=len, reverse=True)  # those that reach a place stand in front
    n, longest = len(chains), len(chains[0])
    feature, cell = [], []
    y, there = np.zeros((longest, n)), np.zeros((longest, n), bool)
    for i, c in enumerate(chains):
        for t, (fs, label) in enumerate(c):
            y[t, i], there[t, i] = label, True
            known = [index[f] for f in fs if f in index]
            feature += known
            cell += [t * n + i] * len(known)
    feature, cell = np.array(feature), np.array(cell)
    reach = there.sum(axis=1)
    ends = (there.sum(axis=0) - 1, np.arange(n))
    both = there[1:]  # steps between neighbours
    steps_seen = np.bincount((2 * y[:-1] + y[1:]).astype(int)[both], minlength=4)
    k = len(index)
    theta, m1, m2 = np.zeros(k + 6), np.zeros(k + 6), np.zeros(k + 6)
    for it in range(1, steps + 1):
        e = np.bincount(cell, theta[feature], n * longest).reshape(longest, n)
        trans, first, last = theta[k : k + 4].reshape(2, 2), theta[k + 4], theta[k + 5]
        a, b = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        a[0, :, 1] = e[0] + first
        for t in range(1, longest):
            r = reach[t]
            a[t, :r] = np.logaddexp(a[t - 1, :r, 0, None] + trans[0], a[t - 1, :r, 1, None] + trans[1])
            a[t, :r, 1] += e[t, :r]
        b[(*ends, 1)] = last
        total = np.logaddexp(a[(*ends, 0)], a[(*ends, 1)] + last)
        for t in range(longest - 2, -1, -1):
            r = reach[t + 1]
            other, article = b[t + 1, :r, 0, None], (b[t + 1, :r, 1] + e[t + 1, :r])[:, None]
            b[t, :r] = np.logaddexp(other + trans[:, 0], article + trans[:, 1])
        p = np.where(there, np.exp(np.minimum(a[..., 1] + b[..., 1] - total, 0.0)), 0.0)
        expected = np.zeros(4)
        for t in range(longest - 1):
            r = reach[t + 1]
            pair = a[t, :r, :, None] + trans + b[t + 1, :r, None, :] - total[:r, None, None]
            pair[..., 1] += e[t + 1, :r, None]
            expected += np.exp(pair).sum(axis=0).ravel()
        grad = np.empty(k + 6)
        grad[:k] = np.bincount(feature, (p - y).ravel()[cell], k)
        grad[k : k + 4] = expected - steps_seen
        grad[k + 4], grad[k + 5] = (p[0] - y[0]).sum(), (p - y)[ends].sum()
        grad = grad / there.sum() + DECAY * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta -= RATE * (m1 / (1 - 0.9**it)) / (np.sqrt(m2 / (1 - 0.99**it)) + 1e-8)
    return Model({f: float(theta[j]) for f, j in index.items()}, tuple(theta[k : k + 4].tolist()), float(theta[k + 4]), float(theta[k + 5]))


class PageMaker:
    """Labelled pages made by rule; article blocks begin with the mark."""

    # fixed values: names that page authors give to parts of a page
    PARTS = {
        "menu": ("nav", "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu tabs toc-nav links"),
        "header": ("header", "header masthead site-header branding top topbar logo"),
        "footer": ("footer", "footer site-footer copyright colophon bottom legal imprint"),
        "side": ("aside", "sidebar side rail widget related related-posts secondary popular trending recommended teaser more-stories tags author-box"),
        "ad": ("div", "ad ads advert advertisement sponsor sponsored promo ad-slot adbox banner-ad"),
        "notice": ("div", "cookie cookie-notice consent gdpr notice alert popup modal overlay disclaimer newsletter subscribe paywall signup message"),
        "form": ("form", "search search-form login contact-form comment-form signup"),
        "talk": ("section", "comments comment-list discussion responses replies thread reader-comments commentlist comment"),
        "share": ("div", "share social sharing toolbar buttons pagination pager"),
    }
    ARTICLE = "content post entry entry-content article article-body story post-body text main main-content page-content prose post-content story-body"
    WRAP = "page wrapper container site wrap row col grid layout inner outer box section block"

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        w = "".join(self.r.choice(("th", "er", "on", "an", "re", "ing", "ou", "é", "ä", "ción", "en", "st", "le", "日本", "ß")) for _ in range(self.r.randint(1, 4)))
        return w + self.r.choice(("",) * 12 + ("%%%", "###", "***", "&amp;", "&nbsp;x", "'s", "-1", "99"))

    def phrase(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        words[0] = words[0].capitalize()
        return " ".join(f"<{t}>{w}</{t}>" if self.r.random() < 0.03 and (t := self.r.choice(("b", "em", "i", "span", "code"))) else w for w in words)

    def sentences(self, n: int) -> str:
        out = [self.phrase(1 if self.r.random() < 0.2 else 4, 18).replace(" ", ", ", self.r.randint(0, 2)) + self.r.choice(".....!?:") for _ in range(n)]
        return " ".join(out)

    def link(self) -> str:
        return f'<a href="/{self.r.randrange(999)}">{self.phrase(1, 3)}</a>'

    def tag(self, name: str, inner: str, **attrs: str) -> str:
        q = self.r.choice("\"\"\"'")
        text = "".join(f" {k}={q}{v}{q}" for k, v in attrs.items() if v)
        name = name.upper() if self.r.random() < 0.05 else name
        shut = "" if name in ("p", "li") and self.r.random() < 0.1 else f"</{name}>"
        return f"<{name}{text}>{inner}{shut}"

    def named(self, plain: str, options: str, inner: str, bare: float = 0.3) -> str:
        """A part by its own element or by a division with a telling name."""
        name = self.r.choice(options.split())
        if self.r.random() < 0.2:
            name += self.r.choice((" clearfix", "-1", " box", "Wrapper", "_inner"))
        key = {self.r.choice(("class", "class", "id")): name}
        if plain != "div" and self.r.random() < 0.5:
            return self.tag(plain, inner, **({} if self.r.random() < bare else key))
        return self.tag(self.r.choice(("div", "div", "section", "div")), inner, **key)

    def links(self) -> str:
        n = self.r.randint(2, 9)
        kind = self.r.random()
        if kind < 0.6:
            return self.tag("ul", "".join(self.tag("li", self.link()) for _ in range(n)))
        if kind < 0.8:
            return self.r.choice((" | ", " &raquo; ", " ")).join(self.link() for _ in range(n))
        return "".join(self.tag(self.r.choice(("p", "div")), self.link()) for _ in range(n))

    def part(self, kind: str) -> str:
        r, plain = self.r, self.PARTS[kind]
        text = lambda n: "".join(self.tag("p", self.sentences(r.randint(1, 3))) for _ in range(r.randint(1, n))) if r.random() < 0.6 else self.sentences(r.randint(1, 3))
        if kind in ("menu", "share"):
            inner = self.links()
        elif kind == "header":
            inner = self.tag(r.choice(("h1", "div", "p", "a")), self.phrase(1, 4)) + r.choice(("", self.tag("p", self.phrase(3, 8)), self.part("menu"), self.part("form")))
        elif kind == "footer":
            inner = r.choice(("&copy; ", "© ", "", "")) + self.word() + r.choice((".example.com &middot; ", " 2024 ", " ")) + self.sentences(1) + r.choice(("", self.links(), text(2)))
        elif kind == "side":
            inner = r.choice(("", self.tag(r.choice(("h2", "h3", "h4")), self.phrase(1, 4)))) + r.choice((self.links(), text(3), self.links() + text(2)))
        elif kind == "form":
            controls = [self.tag("label", self.phrase(1, 3)) + '<input type="text" name="q">', self.tag("button", self.phrase(1, 2)), self.tag("select", self.tag("option", self.word()) * 2), "<textarea>x</textarea>", text(1)]
            inner = "".join(r.sample(controls, r.randint(1, 5)))
        elif kind == "talk":
            own = r.choice(("comment", "comment-body", "reply", "response", ""))
            item = lambda: self.tag(r.choice(("div", "li", "article", "p")), r.choice(("", self.tag("b", self.word()) + ": ", self.tag("h4", self.phrase(1, 2)))) + text(2), **{"class": own})
            inner = r.choice(("", self.tag("h3", self.phrase(1, 3)))) + "".join(item() for _ in range(r.randint(1, 6))) + r.choice(("", "", self.part("form")))
        else:
            inner = text(2)
        return self.named(*plain, inner)

    def article_block(self) -> str:
        r = self.r
        m = lambda n: MARK + self.sentences(n)
        kind = r.random()
        if kind < 0.06:
            return self.tag("p", MARK + self.phrase(1, 6).lower())
        if kind < 0.72:
            return self.tag("p", m(r.choice((1, 1, 2, 3, 5))) + r.choice(("", "", "<br>")))
        if kind < 0.8:
            return self.tag(r.choice(("h2", "h3", "h4")), MARK + self.phrase(1, 8))
        if kind < 0.87:
            return self.tag(r.choice(("ul", "ol")), "".join(self.tag("li", MARK + r.choice((self.sentences(1), self.phrase(1, 6), self.phrase(2, 5) + " " + self.link()))) for _ in range(r.randint(1, 5))))
        if kind < 0.91:
            return self.tag(r.choice(("blockquote", "pre", "div")), m(2))
        if kind < 0.94:
            return self.tag("figure", '<img src="x.png">' + self.tag("figcaption", MARK + self.phrase(2, 9)))
        if kind < 0.97:
            return self.tag("table", "".join(self.tag("tr", "".join(self.tag("td", MARK + self.phrase(1, 3)) for _ in range(3))) for _ in range(r.randint(1, 4))))
        return self.tag("p", MARK + self.phrase(2, 9) + " " + self.link() + " " + self.sentences(1))

    def article(self) -> str:
        r = self.r
        blocks = [self.tag(r.choice(("h1", "h1", "h2")), MARK + self.phrase(2, 12))] if r.random() < 0.85 else []
        blocks += [self.article_block() for _ in range(r.choice((1, 1, 2, 4, 8, 12, 20)))]
        for kind in ("ad", "notice", "share", "side", "form", "menu"):
            if r.random() < 0.12:
                blocks.insert(r.randint(0, len(blocks)), self.part(kind))
        if r.random() < 0.2:
            blocks.append(self.part("talk"))
        body = "".join(blocks)
        kind = r.random()
        if kind < 0.35:
            return self.tag("article", body, **({} if r.random() < 0.5 else {"class": r.choice(self.ARTICLE.split())}))
        if kind < 0.5:
            return self.tag("main", body, **({} if r.random() < 0.5 else {"id": r.choice(self.ARTICLE.split())}))
        if kind < 0.9:
            return self.tag(r.choice(("div", "div", "section", "td")), body, **{r.choice(("class", "id", "itemprop")): r.choice(self.ARTICLE.split())})
        return body

    def page(self) -> str:
        r = self.r
        before = [k for k in ("notice", "header", "menu", "menu", "ad", "form") if r.random() < 0.45]
        after = [k for k in ("share", "side", "talk", "ad", "form", "notice", "menu", "footer", "footer") if r.random() < 0.4]
        r.shuffle(before)
        if r.random() < 0.2:
            before.append("side")
        if r.random() < 0.08:
            before, after = [], []
        out = "".join(map(self.part, before)) + "<!-- x -->" + self.article() + "<script>var t='</p>';</script>" + "".join(map(self.part, after))
        for _ in range(r.choice((0, 0, 1, 2))):
            out = self.tag("div", out, **{"class": r.choice(self.WRAP.split())})
        return f"<!DOCTYPE html><html><head><title>{self.phrase(2, 6)}</title><style>p{{margin:0}}</style></head><body>{out}{r.choice(('</body></html>', ''))}"


def made_pages(n: int, seed: int) -> list[str]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(n)]


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, made: int = MADE_PAGES, id_col: str = "page_id", html_col: str = "html") -> Model:
    """Train on pages that mark their own article and on pages made by rule."""
    paths = dom.Paths()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))
    spread = F.pmod(F.xxhash64("page_id", "html", F.lit(29)), F.lit(1 << 30))
    share = min(1.0, max_pages / max(1, pages.count()))
    marked = F.expr(" OR ".join(f"html ILIKE '%<{m}%'" for m in MARKS))
    chosen = rows.filter(spread < F.lit(int(share * (1 << 30)))).filter((F.length("html") <= MAX_PAGE_CHARS) & marked)
    chosen = chosen.orderBy(spread, "page_id", "html").limit(2 * max_pages)  # repeated rows share a place in the hash
    chains = [c for r in chosen.collect() for c in own_chains(r.html, paths)]
    return train(chains + [marked_chain(p, paths) for p in made_pages(made, 12)])


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of every whole page."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(held.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [extractor.text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def op12_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
