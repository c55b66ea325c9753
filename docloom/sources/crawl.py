"""Breadth-first crawl over a table of fetched pages: the frontier is a join, a round a level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.readers import page_links

FILE_ENDINGS = (".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx")


def absolute(base: str = "base", link: str = "link"):
    """A link made absolute: full urls as they are, then //host, /path and names beside the page; without fragment."""
    l, u = F.regexp_replace(F.trim(link), "#.*$", ""), F.col(base)
    scheme, origin = F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.when(F.regexp_extract(u, "^([^?#]*://[^/?#]*)([^?#]*/)?", 2) == "", "/").otherwise(F.regexp_extract(u, "^([^?#]*://[^/?#]*)([^?#]*/)", 2))
    return F.when(l.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), l).when(l.startswith("//"), F.concat(scheme, l)).when(l.startswith("/"), F.concat(origin, l)).otherwise(F.concat(origin, folder, l))


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int = 3, exclude: tuple[str, ...] = (), allow: tuple[str, ...] = (), max_pages: int | None = None) -> DataFrame:
    """(url, depth, kind) reached from the seeds within their host; kind is page or file.

    ``pages`` has url and html.  Each round joins the new level with the pages and keeps
    what was not seen; depth bounds the number of rounds.  Links with an excluded text are
    left out; where patterns are allowed, links match one of them.  ``max_pages`` counts
    pages in the order of a queue: by level, then by the page that named them first, then by
    place on it.  Files are those that pages within the budget name.
    """
    host = lambda c: F.lower(F.regexp_extract(c, "://([^/?#]*)", 1))
    is_file = lambda c: F.lower(F.regexp_replace(c, r"[?#].*$", "")).rlike("(" + "|".join(e.replace(".", r"\.") for e in FILE_ENDINGS) + ")$")
    kind = F.when(is_file(F.col("url")), "file").otherwise("page")
    left = max_pages

    def within_budget(level: DataFrame) -> DataFrame:
        nonlocal left
        if left is None:
            return level
        chosen = level.filter("kind = 'page'").orderBy("path", "url").limit(left)
        level = level.filter("kind = 'file'").unionByName(chosen).checkpoint()
        left -= level.filter("kind = 'page'").count()
        return level

    level = within_budget(seeds.select("url").distinct().select("url", F.lit(0).alias("depth"), kind.alias("kind"), F.lit("").alias("path")))
    seen = level
    for depth in range(1, max_depth + 1):
        read = level.filter("kind = 'page'").select("url", "path").join(pages.select("url", "html"), "url")
        links = page_links(read.withColumnRenamed("url", "page_id")).join(read.select(F.col("url").alias("page_id"), "path"), "page_id")
        place = F.concat("path", F.lit("."), F.lpad(F.col("pos").cast("string"), 9, "0"))
        found = links.select(F.col("page_id").alias("base"), absolute(base="page_id").alias("url"), place.alias("path")).filter(host(F.col("base")) == host(F.col("url")))
        for x in exclude:
            found = found.filter(~F.lower("url").contains(x.lower()))
        if allow:
            fits = F.lit(False)
            for x in allow:
                fits = fits | F.col("url").rlike(x)
            found = found.filter(fits)
        first = found.groupBy("url").agg(F.min("path").alias("path"))
        new = first.join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), kind.alias("kind"), "path").checkpoint()
        level = within_budget(new)
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.drop("path")
