"""Versioned vector collections: rows are added and marked as deleted, never changed.

An entry lives from the version that added it up to, and without, the version that deleted
it, so each version can be searched as it was.  Updating a file adds its new vectors and
marks the old ones in the same version.  Compaction drops what no kept version can see, in
collections where the marked share passes a bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import merge, vectors
from docloom.sources.readers import stored

ENTRY = ("kb_id", "file_url", "chunk_id", "chunk_index", "content", "embedding", "embedding_hash", "added", "deleted")
COMPACT_ABOVE = 0.3
NO_MARKDOWN, NO_CHUNKS = "No markdown content found", "No chunks created"


@dataclass
class Indexed:
    store: DataFrame  # the entries
    members: DataFrame  # kb_id, file_url, indexed_at, chunk_count, with new times and counts
    outcomes: DataFrame  # kb_id, file_url, state (indexed, skipped or error), chunks, error
    versions: DataFrame  # a row a collection: kb_id, version, files, chunks, indexed, skipped, errors


def needs_index(force: bool = False) -> Column:
    """On members joined with the catalog: never indexed, or the Markdown is newer than the index."""
    return F.lit(force) | F.col("indexed_at").isNull() | F.coalesce(F.col("markdown_updated_at") > F.col("indexed_at"), F.lit(False))


def index(store: DataFrame, members: DataFrame, catalog: DataFrame, chunks: DataFrame, version: int, now: Column, dimension: int, force: bool = False) -> Indexed:
    """Bring all collections up to date in one version.

    ``catalog`` has file_url, markdown_content and markdown_updated_at; ``chunks`` has
    file_url, chunk_index, content and embedding.  A file without Markdown, without chunks or
    with vectors of another dimension is an error and keeps the vectors that it has.  Vectors
    of files that are no longer members are marked as deleted.
    """
    md = catalog.select("file_url", F.col("markdown_content").rlike(r"(?U)\S").alias("said"), "markdown_updated_at")
    sizes = chunks.groupBy("file_url").agg(F.count("*").alias("n"), F.count(F.when(F.size("embedding") != dimension, 1)).alias("odd"))
    due = members.join(md, "file_url", "left").join(sizes, "file_url", "left")
    error = F.when(~F.coalesce("said", F.lit(False)), NO_MARKDOWN).when(F.col("n").isNull(), NO_CHUNKS).when(F.col("odd") > 0, f"Vector dimension is not {dimension}")
    state = F.when(~needs_index(force), "skipped").when(error.isNotNull(), "error").otherwise("indexed")
    planned = due.select("kb_id", "file_url", state.alias("state"), F.when(state == "indexed", F.col("n")).otherwise(0).cast("long").alias("chunks"), F.when(state == "error", error).alias("error"))
    outcomes = stored(planned, "index-plan")
    fresh = outcomes.filter("state = 'indexed'").select("kb_id", "file_url")

    marks = outcomes.select("kb_id", "file_url", (F.col("state") == "indexed").alias("renewed"))
    old = store.join(marks, ["kb_id", "file_url"], "left")
    ends = F.col("deleted").isNull() & F.coalesce("renewed", F.lit(True))  # renewed, or no member any more
    kept = old.select(*[F.when(ends, version).otherwise(F.col(c)).cast("int").alias(c) if c == "deleted" else F.col(c) for c in ENTRY])
    digest = F.substring(F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",").cast("binary"), 256), 1, 16)
    named = F.concat_ws(":", "kb_id", "file_url", F.col("chunk_index").cast("string"), F.lit(str(version)))
    added = chunks.join(fresh, "file_url").withColumns({"chunk_id": named, "embedding_hash": digest, "added": F.lit(version), "deleted": F.lit(None).cast("int")})
    now_store = kept.unionByName(added.select(*ENTRY))

    done = outcomes.filter("state = 'indexed'").select("kb_id", "file_url", now.alias("indexed_at"), F.col("chunks").alias("chunk_count"))
    has = lambda s: F.count(F.when(F.col("state") == s, 1))
    counts = outcomes.groupBy("kb_id").agg(F.count("*").alias("files"), has("indexed").alias("indexed"), has("skipped").alias("skipped"), has("error").alias("errors"), F.sum("chunks").alias("chunks"))
    versions = counts.select("kb_id", F.lit(version).alias("version"), "files", "chunks", "indexed", "skipped", "errors")
    return Indexed(now_store, merge.upsert(members, done, ["kb_id", "file_url"]), outcomes, versions)


def alive(store: DataFrame, version: int | None = None) -> DataFrame:
    """The entries of a version, or of the newest."""
    if version is None:
        return store.filter("deleted IS NULL")
    return store.filter((F.col("added") <= version) & (F.col("deleted").isNull() | (F.col("deleted") > version)))


def search(store: DataFrame, query: list[float], k: int = 10, threshold: float | None = None, version: int | None = None, metric: str = "l2") -> DataFrame:
    """The nearest entries of a version; entries marked as deleted in it are not seen."""
    found = alive(store, version).withColumn("vec_id", F.col("chunk_id"))
    return vectors.search(found, query, k, threshold, metric).drop("vec_id")


def remove(store: DataFrame, files: DataFrame, version: int) -> DataFrame:
    """Marks the entries of (kb_id, file_url) as deleted; those marked before keep their version."""
    gone = files.select("kb_id", "file_url").distinct().withColumn("_gone", F.lit(True))
    marked = store.join(gone, ["kb_id", "file_url"], "left")
    return marked.select(*[F.when(F.col("deleted").isNull() & F.col("_gone"), version).otherwise(F.col(c)).cast("int").alias(c) if c == "deleted" else F.col(c) for c in ENTRY])


def shares(store: DataFrame) -> DataFrame:
    """By collection: total_vectors, active_vectors, deleted_vectors."""
    gone = F.count("deleted")
    return store.groupBy("kb_id").agg(F.count("*").alias("total_vectors"), (F.count("*") - gone).alias("active_vectors"), gone.alias("deleted_vectors"))


def compact(store: DataFrame, oldest_kept: int, above: float = COMPACT_ABOVE) -> DataFrame:
    """Without the entries that no version from ``oldest_kept`` on sees, where the marked share of a collection is above the bound."""
    full = shares(store).filter(F.col("deleted_vectors") > F.lit(above) * F.col("total_vectors")).select("kb_id", F.lit(True).alias("_full"))
    # a row a collection
    marked = store.join(full, "kb_id", "left")
    return marked.filter(~(F.coalesce("_full", F.lit(False)) & F.coalesce(F.col("deleted") <= oldest_kept, F.lit(False)))).select(*ENTRY)
