"""URL filter: a path-template tree per host.

1. Urls are reduced to distinct (host, path) with the number of pages and of labelled good
   and bad ones.
2. Level by level, under each (host, template so far), a segment turns into a wildcard of
   its shape (``{num}``, ``{hex}``, ``{word}``) if it looks generated or if its parent has
   more than ``MAX_CHILDREN`` values of which it holds less than ``MIN_SHARE``.  Paths that
   have ended take no part in further levels.  Of paths with more than ``MAX_LEVELS``
   segments, as crawler traps have, the last levels are one wildcard, ``{tail}``, so the
   number of jobs does not follow the deepest url.
3. Branches that differ in one literal segment only are compared, each with the others taken
   together, by a test of two shares of bad labels; those within ``Z_SAME`` standard errors
   merge to ``{any}``.  Branches without labels merge along if no labelled one stays apart.
   This goes level by level from the first segment on, each level with the branches merged
   before.
4. A template is rejected if its bad share, smoothed by ``PRIOR_WEIGHT`` labels at the
   overall rate, reaches ``REJECT``.

Explicit rules (host with all subdomains, path prefix) come first, the longest wins.
Everything is grouping and joining of pre-aggregated counts, so a host with a third of all
urls is not gathered anywhere.

A null url or one without ``://`` has empty host and path.  Pages without a label count as
unlabelled; without any label the prior is 0 and the method allows.  Repeated rows give a
row each and count as pages each; of several labels of a page the bad one counts.  Ties at
``REJECT`` are rejected.  Urls may have any length and depth.  An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.tables import table, written

MAX_LEVELS = 20
MAX_CHILDREN = 20
MIN_SHARE = 0.05
Z_SAME = 1.96
PRIOR_WEIGHT = 5.0
REJECT = 0.5
TAIL = "{tail}"
_SPLIT = r"^(?s)(.*?)://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 3), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """The rule's text (field 'rule') or verdict; null where none fits.  Longer texts are tried first."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.host + r.path if field == "rule" else r.verdict)).otherwise(out)
    return out


def _shape(seg: Column) -> Column:
    stem = F.regexp_replace(seg, r"\.[A-Za-z0-9]{1,5}$", "")
    ext = F.regexp_extract(seg, r"(\.[A-Za-z0-9]{1,5})$", 1)
    kind = F.when(stem.rlike(r"^[0-9][0-9_.,-]*$"), "{num}").when(stem.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), "{hex}").otherwise("{word}")
    return F.concat(kind, ext)


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template) of distinct urls; ``urls`` has host, path, n, good, bad."""
    # a segment that is written like a wildcard is none
    segs = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, r"^\{", "%7B"))
    deep = F.size("segs") > MAX_LEVELS
    now = urls.select("host", "path", "n", segs.alias("segs"), F.lit("").alias("template"))
    now = now.withColumn("segs", F.when(deep, F.concat(F.slice("segs", 1, MAX_LEVELS - 1), F.array(F.lit(TAIL)))).otherwise(F.col("segs")))
    deepest = now.agg(F.max(F.size("segs"))).first()[0] or 0
    ended = now.filter(F.size("segs") == 0)
    for d in range(deepest):
        now = now.filter(F.size("segs") > d)
        seg = F.get("segs", F.lit(d))
        looks_made = _shape(seg).rlike(r"^\{(num|hex)\}") & (seg != TAIL)
        now = now.withColumn("seg", F.when(looks_made, _shape(seg)).otherwise(seg))
        children = now.groupBy("host", "template", "seg").agg(F.sum("n").alias("n_seg"))
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("fan"), F.sum("n_seg").alias("n_all"))
        odd = children.join(nodes, ["host", "template"]).filter((F.col("fan") > MAX_CHILDREN) & (F.col("n_seg") < MIN_SHARE * F.col("n_all")) & ~F.col("seg").startswith("{")).select("host", "template", "seg", F.lit(True).alias("odd"))
        now = now.join(odd, ["host", "template", "seg"], "left")
        step = F.when(F.col("odd"), _shape(F.col("seg"))).otherwise(F.col("seg"))
        now = written(now.select("host", "path", "n", "segs", F.concat("template", F.lit("/"), step).alias("template")), f"templates-{d}")
        ended = ended.union(now.filter(F.size("segs") == d + 1))
    return ended.select("host", "path", F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"))


def merged(counts: DataFrame) -> DataFrame:
    """(host, template, merged): level by level, branches that differ in this literal segment and not in their labels.

    ``counts`` has host, template, good, bad.
    """
    now = counts.withColumn("merged", F.col("template"))
    deepest = counts.agg(F.max(F.size(F.split("template", "/")))).first()[0] or 0
    for d in range(max(1, deepest - 1)):
        slot = rf"^((?:/[^/]*){{{d}}})/([^{{/][^/]*)"
        branch = now.groupBy("host", "merged").agg(F.sum("good").alias("b_good"), F.sum("bad").alias("b_bad")).withColumn("wide", F.regexp_replace("merged", slot, "$1/{any}"))
        mine = F.col("b_good") + F.col("b_bad")
        pooled = branch.groupBy("host", "wide").agg(F.count("*").alias("branches"), F.sum("b_bad").alias("p_bad"), F.sum(mine).alias("p_all"))
        others = F.col("p_all") - mine
        rate = F.try_divide("p_bad", "p_all")
        gap = F.abs(F.try_divide("b_bad", mine) - F.try_divide(F.col("p_bad") - F.col("b_bad"), others))
        error = F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1.0), mine) + F.try_divide(F.lit(1.0), others)))
        # no others with labels, or no spread at all: nothing tells them apart
        apart = (mine > 0) & (others > 0) & (gap > Z_SAME * error)
        tested = branch.join(pooled, ["host", "wide"]).select("host", "merged", "wide", "branches", mine.alias("mine"), F.coalesce(apart, F.lit(False)).alias("apart"))
        tested = written(tested, f"template-tests-{d}")
        split = tested.groupBy("host", "wide").agg(F.max("apart").alias("split"))
        stays = F.col("apart") | ((F.col("mine") == 0) & F.col("split")) | (F.col("branches") == 1)
        step = tested.join(split, ["host", "wide"]).select("host", "merged", F.when(stays, F.col("merged")).otherwise(F.col("wide")).alias("next"))
        now = written(now.join(step, ["host", "merged"]).select("host", "template", "good", "bad", F.col("next").alias("merged")), f"template-merges-{d}")
    return now.select("host", "template", "merged")


def judged(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, template, purity_bad, n_labelled.

    ``labels`` has page_id and is_bad.
    """
    mine = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = labels.groupBy("page_id").agg(F.max(F.col("is_bad").cast("int")).alias("is_bad"))
    marked = mine.join(marks, "page_id", "left")
    urls = marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.when(F.col("is_bad") == 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("is_bad") == 1, 1).otherwise(0)).alias("bad"))
    urls = written(urls, "urls")
    found = templates(urls)
    counts = written(urls.join(found, ["host", "path"]).groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "template-counts")
    wide = merged(counts)
    both = counts.join(wide, ["host", "template"]).groupBy("host", "merged").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    total = counts.agg(F.try_divide(F.sum("bad"), F.sum(F.col("good") + F.col("bad"))).alias("rate")).first().rate
    n = F.col("good") + F.col("bad")
    scored = both.select("host", "merged", ((F.col("bad") + PRIOR_WEIGHT * F.lit(float(total or 0.0))) / (n + PRIOR_WEIGHT)).alias("purity_bad"), n.alias("n_labelled"))
    # written, so that its size is known and a small one is broadcast without moving the urls
    by_template = written(wide.join(scored, ["host", "merged"]), "template-scores")
    out = mine.join(found.join(by_template, ["host", "template"]), ["host", "path"], "left")
    rule, verdict = (matched_rule(F.col("host"), F.col("path"), rules, f) for f in ("rule", "verdict"))
    own = F.when(F.col("purity_bad") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("merged").alias("template"), F.round("purity_bad", 6).alias("purity_bad"), "n_labelled")


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("is_bad"))
    return judged(table(spark, sf_dir, "pages"), labels)
