"""File listings, change detection and first-candidate positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import blank, contains_any, in_category

SEARCHED = ("title", "original_filename", "url", "summary", "keywords", "category", "markdown_content")
SORTABLE = ("id", "title", "bytes", "first_seen", "last_seen")
CONVERTIBLE = r"(?i)pdf|word|presentation|powerpoint|html|markdown|image/"


def with_catalog(files: DataFrame, catalog: DataFrame, how: str = "left") -> DataFrame:
    return files.join(catalog, files["url"] == catalog["file_url"], how)


def query_files(files: DataFrame, catalog: DataFrame, query: str = "", category: str = "", site: str = "", include_deleted: bool = False, order_by: str = "last_seen", descending: bool = True, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the file list; ``count_files`` gives the total for the same filters."""
    if order_by not in SORTABLE:
        raise ValueError(f"cannot order by {order_by}")
    out = _filtered(files, catalog, query, category, site, include_deleted)
    by = F.desc(order_by) if descending else F.asc(order_by)
    return out.orderBy(by, "id").offset(offset).limit(limit)


def count_files(files: DataFrame, catalog: DataFrame, query: str = "", category: str = "", site: str = "", include_deleted: bool = False) -> DataFrame:
    """Without a catalog filter the join is left out: files match at most one item."""
    if not query and not category:
        return _visible(files, site, include_deleted).agg(F.count("*").alias("total"))
    return _filtered(files, catalog, query, category, site, include_deleted).agg(F.count("*").alias("total"))


def _visible(files: DataFrame, site: str, include_deleted: bool) -> DataFrame:
    out = files.filter(~blank("local_path"))
    if not include_deleted:
        out = out.filter("deleted_at IS NULL")
    return out.filter(F.lower("source_site").contains(site.lower())) if site else out


def _filtered(files: DataFrame, catalog: DataFrame, query: str, category: str, site: str, include_deleted: bool) -> DataFrame:
    files = _visible(files, site, include_deleted)
    if query:  # each side is searched before the join, so that long texts need not move
        files, catalog = (x.withColumn(hit, contains_any(query, *[c for c in SEARCHED if c in x.columns])) for x, hit in ((files, "_in_file"), (catalog, "_in_item")))
    out = with_catalog(files, catalog)
    if query:
        out = out.filter(F.col("_in_file") | F.coalesce("_in_item", F.lit(False))).drop("_in_file", "_in_item")
    if category == "__uncategorized__":
        out = out.filter(uncategorized())
    elif category:
        out = out.filter(in_category("category", category))
    return out


def uncategorized() -> Column:
    return F.col("file_url").isNull() | blank("category") | blank("summary") | F.trim("category").rlike(r"^\(.*\)$")


def needs_catalog(version: str, include_errors: bool = False) -> Column:
    """On files left-joined with the catalog: new, changed, made by another version, or blank."""
    out = F.col("file_url").isNull() | F.col("file_sha256").isNull() | (F.col("file_sha256") != F.col("sha256")) | (F.coalesce("catalog_version", F.lit("")) != version) | blank("summary")
    return out | (F.col("status") == "error") if include_errors else out


def first_position(ordered: DataFrame, wanted: Column) -> DataFrame:
    """1-based place, by descending id, of the first row that is wanted; 0 if none is.

    Counts the rows above it instead of numbering all rows in one task.
    """
    top = ordered.filter(wanted).agg(F.max("id").alias("top"))
    above = ordered.join(F.broadcast(top), F.col("id") > F.col("top")).agg(F.count("*").alias("n_above"))
    return above.crossJoin(F.broadcast(top)).select(F.when(F.col("top").isNull(), 0).otherwise(F.col("n_above") + 1).cast("long").alias("first_position"))


def recent_files(files: DataFrame, start: Column, end: Column, limit: int = 5000) -> DataFrame:
    """Files first seen in [start, end), newest first."""
    n = max(1, min(5000, limit))
    return files.filter((F.col("first_seen") >= start) & (F.col("first_seen") < end)).orderBy(F.desc("first_seen"), "url").limit(n)


def by_urls(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Point lookups in the order asked for (``wanted`` has url, pos); unknown urls have null ids."""
    return wanted.join(files, "url", "left").orderBy("pos")


def pending_index(kb_files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Members never indexed, or whose Markdown is newer than their index."""
    joined = kb_files.join(catalog.filter(~blank("markdown_content")).select("file_url", "markdown_updated_at"), "file_url")
    return joined.filter(F.col("indexed_at").isNull() | (F.col("markdown_updated_at") > F.col("indexed_at")))


def without_chunks(catalog: DataFrame, sets: DataFrame, profile: str) -> DataFrame:
    return catalog.filter(~blank("markdown_content")).join(sets.filter(F.col("profile_id") == profile), "file_url", "left_anti")
