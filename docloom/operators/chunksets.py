"""Chunk sets derived from Markdown by content: a set is named by its file, profile and text.

A run plans first, on hashes only: which sets are there already and which have to be made.
Only the texts of the latter are read again and chunked.  Bindings that follow the latest set
of their file and profile move in the same run.  Nothing is overwritten: new snapshots of
sets, chunks and bindings come out, and a second run over them makes nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.canonical import canonical_text
from docloom.operators import chunking, merge
from docloom.sources.readers import stored

SET = ("chunk_set_id", "file_url", "profile_id", "markdown_hash", "status", "chunk_count", "created_at", "updated_at")
CHUNK = ("chunk_id", "chunk_set_id", "chunk_index", "content", "token_count", "section_hierarchy")
MODES = ("pin", "follow_latest")
SPLITTERS = ("semantic", "fixed")


@dataclass(frozen=True)
class Profile:
    """How to chunk; equal settings have one id, whatever the order of their metadata."""

    chunk_size: int = 800
    chunk_overlap: int = 100
    splitter: str = "semantic"
    tokenizer: str = "cl100k_base"
    version: str = "v1"
    metadata: dict[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if self.splitter not in SPLITTERS:
            raise ValueError(f"no splitter {self.splitter}")
        size = max(1, min(10_000, self.chunk_size))
        overlap = max(0, min(10_000, self.chunk_overlap))
        object.__setattr__(self, "chunk_size", size)
        object.__setattr__(self, "chunk_overlap", overlap if overlap < size else size - 1)

    @property
    def config_hash(self) -> str:
        names = ("chunk_size", "chunk_overlap", "splitter", "tokenizer", "version", "metadata")
        return hashlib.sha256(canonical_text({n: getattr(self, n) for n in names}).encode()).hexdigest()

    @property
    def profile_id(self) -> str:
        return f"cp_{self.config_hash[:32]}"


@dataclass
class Generated:
    outcomes: DataFrame  # file_url, chunk_set_id, state (reused, made or overwritten), chunk_count, synced_bindings
    sets: DataFrame
    chunks: DataFrame
    bindings: DataFrame


def set_id(file_url: Column, profile_id: str, markdown_hash: Column) -> Column:
    return F.concat(F.lit("cs_"), F.substring(F.sha2(F.concat_ws("|", file_url, F.lit(profile_id), markdown_hash), 256), 1, 32))


def plan(catalog: DataFrame, sets: DataFrame, profile: Profile, overwrite: bool = False) -> DataFrame:
    """(file_url, markdown_hash, chunk_set_id, state) of each file with Markdown."""
    said = F.col("markdown_content").rlike(r"(?U)\S")
    wanted = catalog.filter(said).select("file_url", F.sha2("markdown_content", 256).alias("markdown_hash"))
    mine = sets.filter(F.col("profile_id") == profile.profile_id)
    known = mine.groupBy("file_url", "markdown_hash").agg(F.min_by("chunk_set_id", F.struct("created_at", "chunk_set_id")).alias("known"))
    there = F.col("known").isNotNull()
    state = F.when(~there, "made").when(F.lit(overwrite), "overwritten").otherwise("reused")
    new = set_id(F.col("file_url"), profile.profile_id, F.col("markdown_hash"))
    return wanted.join(known, ["file_url", "markdown_hash"], "left").select("file_url", "markdown_hash", F.coalesce("known", new).alias("chunk_set_id"), state.alias("state"))


def chunked(texts: DataFrame, profile: Profile) -> DataFrame:
    """The chunks of (chunk_set_id, markdown_content)."""
    if profile.splitter == "fixed":
        cut = chunking.fixed_windows(texts, profile.chunk_size, profile.chunk_overlap, "chunk_set_id", "markdown_content")
    else:
        least = max(20, min(100, profile.chunk_size // 4))
        cut = chunking.chunk_documents(texts, profile.chunk_size, least, "chunk_set_id", "markdown_content")
    return cut.withColumn("chunk_id", F.concat_ws(":", "chunk_set_id", F.col("chunk_index").cast("string"))).select(*CHUNK)


def generate(catalog: DataFrame, sets: DataFrame, chunks: DataFrame, bindings: DataFrame, profile: Profile, now: Column, overwrite: bool = False) -> Generated:
    """Sets of all files of the catalog (a row a file) under one profile."""
    planned = stored(plan(catalog, sets, profile, overwrite), "chunk-plan")
    fresh = planned.filter("state <> 'reused'")
    texts = catalog.select("file_url", "markdown_content").join(fresh.select("file_url", "chunk_set_id"), "file_url")
    made = stored(chunked(texts.select("chunk_set_id", "markdown_content"), profile), "chunks")
    counts = made.groupBy("chunk_set_id").agg(F.count("*").cast("long").alias("chunk_count"))
    rows = fresh.join(counts, "chunk_set_id", "left").withColumns({"profile_id": F.lit(profile.profile_id), "status": F.lit("ready"), "chunk_count": F.coalesce("chunk_count", F.lit(0).cast("long")), "created_at": now, "updated_at": now})
    new_sets = merge.upsert(sets, rows.select(*SET), ["chunk_set_id"], keep=("created_at",))
    # by ids first: texts move only if some of them have to go
    gone = stored(chunks.select("chunk_set_id").distinct().join(fresh.select("chunk_set_id"), "chunk_set_id", "left_semi"), "chunks-gone")
    kept = chunks if gone.isEmpty() else merge.delete_rows(chunks, gone, ["chunk_set_id"]).select(*chunks.columns)
    new_chunks = kept.unionByName(made)
    moved = follow(bindings, fresh, profile)
    synced = moved.filter("synced").groupBy("file_url").agg(F.count("*").alias("synced_bindings"))
    sizes = new_sets.select("chunk_set_id", "chunk_count")
    outcomes = planned.join(sizes, "chunk_set_id", "left").join(synced, "file_url", "left").select("file_url", "chunk_set_id", "state", "chunk_count", F.coalesce("synced_bindings", F.lit(0).cast("long")).alias("synced_bindings"))
    return Generated(outcomes, new_sets, new_chunks, moved.drop("synced"))


def follow(bindings: DataFrame, fresh: DataFrame, profile: Profile) -> DataFrame:
    """The bindings, with those that follow this profile on the new sets of their files; ``synced`` marks those that moved."""
    to = fresh.select("file_url", F.col("chunk_set_id").alias("_to"))
    moves = F.col("_to").isNotNull() & (F.col("binding_mode") == "follow_latest") & (F.coalesce("target_profile_id", F.lit("")) == profile.profile_id) & (F.col("chunk_set_id") != F.col("_to"))
    joined = bindings.join(to, "file_url", "left").withColumn("synced", F.coalesce(moves, F.lit(False)))
    return joined.select(*[F.when(F.col("synced"), F.col("_to")).otherwise(F.col(c)).alias(c) if c == "chunk_set_id" else F.col(c) for c in bindings.columns], "synced")


def bind(bindings: DataFrame, outcomes: DataFrame, kb_id: str, profile: Profile, mode: str = "follow_latest") -> DataFrame:
    """The sets of a run bound to a collection, in place of what it had for their files."""
    if mode not in MODES:
        raise ValueError(f"binding_mode must be one of: {', '.join(MODES)}")
    new = outcomes.select(F.lit(kb_id).alias("kb_id"), "file_url", "chunk_set_id", F.lit(mode).alias("binding_mode"), F.lit(profile.profile_id).alias("target_profile_id"))
    return merge.upsert(bindings, new, ["kb_id", "file_url"])
