import re
from collections import Counter, defaultdict

import pytest

from docloom.llm import url_templates as u


def parts(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not m else ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[2]), m[3])


def rule(host, path):
    best = None
    for r in u.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.host + r.path) > len(best.host + best.path)):
            best = r
    return best


def shape(seg):
    m = re.search(r"(\.[A-Za-z0-9]{1,5})$", seg)
    stem, ext = (seg[: m.start()], m[1]) if m else (seg, "")
    kind = "{num}" if re.match(r"^[0-9][0-9_.,-]*$", stem) else "{hex}" if re.match(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$", stem) else "{word}"
    return kind + ext


def brute(pages, labels):
    """page_id -> (host, path, rule, verdict, template)."""
    bad = {}
    for p, b in labels:
        if b is not None:
            bad[p] = max(bad.get(p, 0), int(b))
    rows = [(p, *parts(url)) for p, url in pages]
    n, marks = Counter((h, x) for _, h, x in rows), defaultdict(lambda: [0, 0])
    for p, h, x in rows:
        if p in bad:
            marks[h, x][bad[p]] += 1
    segs = {k: ["%7B" + s[1:] if s.startswith("{") else s for s in k[1].split("/") if s] for k in n}
    segs = {k: s if len(s) <= u.MAX_LEVELS else [*s[: u.MAX_LEVELS - 1], u.TAIL] for k, s in segs.items()}
    tpl = {k: "" for k in n}
    for d in range(max([0, *map(len, segs.values())])):
        seg = {k: (shape(s[d]) if re.match(r"\{(num|hex)\}", shape(s[d])) else s[d]) for k, s in segs.items() if len(s) > d}
        child, fan, total = Counter(), Counter(), Counter()
        for k, s in seg.items():
            child[k[0], tpl[k], s] += n[k]
        for (h, t, _), c in child.items():
            fan[h, t] += 1
            total[h, t] += c
        new = {}
        for k, s in seg.items():
            at = (k[0], tpl[k])
            odd = fan[at] > u.MAX_CHILDREN and child[(*at, s)] < u.MIN_SHARE * total[at] and not s.startswith("{")
            new[k] = tpl[k] + "/" + (shape(s) if odd else s)
        tpl |= new
    tpl = {k: t or "/" for k, t in tpl.items()}
    counts = defaultdict(lambda: [0, 0])
    for k, t in tpl.items():
        counts[k[0], t][0] += marks[k][0] if k in marks else 0
        counts[k[0], t][1] += marks[k][1] if k in marks else 0
    merged = {k: k[1] for k in counts}
    for d in range(max([1, *(len(k[1].split("/")) - 1 for k in counts)])):
        branch = defaultdict(lambda: [0, 0])
        for k, (g, b) in counts.items():
            branch[k[0], merged[k]][0] += g
            branch[k[0], merged[k]][1] += b
        groups = defaultdict(list)
        for host, t in branch:
            segs_ = t.split("/")[1:]
            wide = "/" + "/".join([*segs_[:d], "{any}", *segs_[d + 1 :]]) if len(segs_) > d and segs_[d] and not segs_[d].startswith("{") else t
            groups[host, wide].append(t)
        moved = {}
        for (host, wide), own in groups.items():
            bad, all_ = sum(branch[host, t][1] for t in own), sum(sum(branch[host, t]) for t in own)
            apart = {}
            for t in own:
                n1, b1 = sum(branch[host, t]), branch[host, t][1]
                n2 = all_ - n1
                apart[t] = bool(n1 and n2) and abs(b1 / n1 - (bad - b1) / n2) > u.Z_SAME * (bad / all_ * (1 - bad / all_) * (1 / n1 + 1 / n2)) ** 0.5
            for t in own:
                stays = apart[t] or (not sum(branch[host, t]) and any(apart.values())) or len(own) == 1
                moved[host, t] = t if stays else wide
        merged = {k: moved[k[0], t] for k, t in merged.items()}
    both = defaultdict(lambda: [0, 0])
    for k, (g, b) in counts.items():
        both[k[0], merged[k]][0] += g
        both[k[0], merged[k]][1] += b
    all_ = sum(map(sum, both.values()))
    prior = sum(b for _, b in both.values()) / all_ if all_ else 0
    out = []
    for p, h, x in rows:
        m = merged[h, tpl[h, x]]
        g, b = both[h, m]
        own = "block" if (b + u.PRIOR_WEIGHT * prior) / (g + b + u.PRIOR_WEIGHT) >= u.REJECT else "allow"
        r = rule(h, x)
        out.append((p, h, x, r and r.host + r.path, r.verdict if r else own, m))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.template) for r in df.collect()), key=repr)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    labels = [(r.doc_id, r.quality == 0 or r.toxic == 1) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert rows_of(u.op2_url_templates(spark, sf)) == brute(pages, labels)


@pytest.mark.parametrize("labelled", [True, False])
def test_generalising_merging_rejecting(spark, labelled):
    urls = [f"https://SHOP.example.org/item/{w}{k}/view" for k in range(30) for w in ("ab", "cd")] + [f"http://shop.example.org/{s}/{k}" for s in ("spam", "ok", "fine") for k in range(40)]
    urls += [None, "", "no-scheme/x", "x://", "x://Host?q", "a://b://c/d", "http://a.net", "http://a.net/", "http://x.example.net/en/1#f", "http://net/", "http://fr.org/fr/x", "http://h/" + "/".join("abcdefghijklmnopqrs"), "http://h/" + "/".join("abcdefghijklmnopqr1"), "http://h/" + "x" * 100_000 + "/y", "http://h/é/漢\nq"]
    urls += ["http://twice.org/a"] * 3
    pages = list(enumerate(urls)) + [(None, "http://none.org/z")]
    labels = [(i, "/spam/" in (x or "")) for i, x in pages if x and ("/spam/" in x or "/ok/" in x)] + [(None, True), (3, None)] if labelled else []
    df = spark.createDataFrame([(p, x, "h") for p, x in pages], "page_id long, url string, host string")
    got = rows_of(u.judged(df, spark.createDataFrame(labels, "page_id long, is_bad boolean")))
    assert got == brute(pages, labels)
    if labelled:
        assert {r[4] for r in got if r[2].startswith("/spam/")} == {"block"} and {r[4] for r in got if r[2].startswith("/ok/")} == {"allow"}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert u.judged(df, spark.createDataFrame([], "page_id long, is_bad boolean")).count() == 0


def test_branches_below_the_first_segment_merge(spark):
    """Few bad labels on each of many branches, below a literal and below a wildcard: they are pooled."""
    urls = [f"http://s.org/shop/c{x}/{k}" for x in "abcdef" for k in range(2)] + [f"http://s.org/7/c{x}/{k}" for x in "abcdef" for k in range(2)] + [f"http://t.org/ok/{k}" for k in range(80)]
    pages = list(enumerate(urls))
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = u.judged(df, spark.createDataFrame([(i, x.startswith("http://s")) for i, x in pages], "page_id long, is_bad boolean"), ()).collect()
    assert {(r.template, r.verdict) for r in got if r.host == "s.org"} == {("/shop/{any}/{num}", "block"), ("/{num}/{any}/{num}", "block")}
    assert {r.verdict for r in got if r.host == "t.org"} == {"allow"}


def test_deep_urls_cost_no_more_levels(spark):
    """A trap of a thousand segments: the last levels are one wildcard, and no row is lost."""
    import time

    urls = [f"http://t.org/a/{'/'.join('x' + str(j) for j in range(k))}" for k in (1, 5, 18, 19, 20, 40, 1000)] + ["http://t.org/{any}/{num}", "http://t.org/{any}/7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(5, True), (6, True), (0, False)], "page_id long, is_bad boolean")
    began = time.time()
    got = {r.page_id: r for r in u.judged(pages, labels).collect()}
    assert time.time() - began < 240 and set(got) == set(range(len(urls)))
    assert got[5].template == got[6].template and got[5].template.endswith("/" + u.TAIL) and got[4].template != got[3].template
    assert got[2].template.endswith("/x17") and not got[7].template.startswith("/{")
    assert rows_of(u.judged(pages, labels)) == brute(list(enumerate(urls)), [(5, True), (6, True), (0, False)])
