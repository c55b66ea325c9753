"""Queries over derived state: chunk sets by content, versioned vectors, canonical configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import canonical
from docloom.operators import chunksets, vectorstore
from docloom.plans import bindings as b
from docloom.plans.registry import _D2, _query_vector, query

# --- chunk sets ---------------------------------------------------------------------------
# Two runs: the first over the Markdown as it was, another text for every third file and none for every
# fifth; the second over all texts as they are.  Collections follow the sets of the first run.

_P = chunksets.Profile(chunk_size=500, chunk_overlap=50, splitter="fixed", metadata={"b": 1, "a": {"y": [1, 2], "x": "é"}})
_MD = "NOT regexp_matches({0}, '^[\\s]*$')"


def _two_runs(spark, d, overwrite: bool = False) -> chunksets.Generated:
    f = b.files(spark, d)
    i = F.col("id")
    before = f.select(F.col("url").alias("file_url"), F.when(i % 5 == 0, F.lit(None)).when(i % 3 == 0, F.concat("text", F.lit(" earlier"))).otherwise(F.col("text")).alias("markdown_content"))
    none = lambda s: spark.createDataFrame([], s)
    sets = none("chunk_set_id string, file_url string, profile_id string, markdown_hash string, status string, chunk_count long, created_at timestamp, updated_at timestamp")
    chunks = none("chunk_id string, chunk_set_id string, chunk_index int, content string, token_count int, section_hierarchy string")
    bound = none("kb_id string, file_url string, chunk_set_id string, binding_mode string, target_profile_id string")
    first = chunksets.generate(before, sets, chunks, bound, _P, F.lit("2024-03-01").cast("timestamp"))
    bound = chunksets.bind(chunksets.bind(bound, first.outcomes, "follows", _P), first.outcomes, "pinned", _P, "pin")
    after = f.select(F.col("url").alias("file_url"), F.col("text").alias("markdown_content"))
    return chunksets.generate(after, first.sets, first.chunks, bound, _P, F.lit("2024-03-08").cast("timestamp"), overwrite)


_SET_ID = f"'cs_' || substr(sha256(url || '|{_P.profile_id}|' || sha256({{0}})), 1, 32)"
_SETS = f"""WITH was AS (SELECT id, url, text, CASE WHEN id % 3 = 0 THEN text || ' earlier' ELSE text END AS old FROM files WHERE id % 5 <> 0 AND {_MD.format("CASE WHEN id % 3 = 0 THEN text || ' earlier' ELSE text END")}),
 made AS (SELECT url, id, old AS md, {_SET_ID.format('old')} AS sid, 1 AS run FROM was UNION ALL SELECT url, id, text, {_SET_ID.format('text')}, 2 FROM files WHERE {_MD.format('text')}),
 sets AS (SELECT url, sid, md, min(run) AS run FROM made GROUP BY url, sid, md)"""


@query("txt14_chunk_set_states", f"""{_SETS} SELECT url AS file_url, sid AS chunk_set_id, CASE WHEN run = 2 THEN 'made' ELSE 'reused' END AS state, CAST((greatest(length(md), 1) - 1) // 1800 + 1 AS BIGINT) AS chunk_count,
 CASE WHEN run = 2 AND url IN (SELECT url FROM was) THEN 1 ELSE 0 END AS synced_bindings FROM sets WHERE sid IN (SELECT sid FROM made WHERE run = 2)""")  # fmt: skip
def _states(spark, d):
    return _two_runs(spark, d).outcomes.withColumn("synced_bindings", F.col("synced_bindings").cast("int"))


@query("txt14_bound_chunks", f"""{_SETS}, ends AS (SELECT 'pinned' AS kb_id, url, sid FROM made WHERE run = 1 UNION ALL SELECT 'follows', url, CASE WHEN text = old OR NOT {_MD.format('text')} THEN {_SET_ID.format('old')} ELSE {_SET_ID.format('text')} END FROM was),
 w AS (SELECT sid, md, unnest(range(0, greatest(length(md), 1), 1800)) AS start FROM sets)
 SELECT kb_id, e.url AS file_url, w.sid || ':' || (start // 1800) AS chunk_id, CAST(start // 1800 AS INT) AS chunk_index, md5(substring(md, CAST(start + 1 AS BIGINT), 2000)) AS digest, CAST(greatest(1, length(substring(md, CAST(start + 1 AS BIGINT), 2000)) // 4) AS INT) AS token_count
 FROM ends e JOIN w ON w.sid = e.sid""")  # fmt: skip
def _bound(spark, d):
    got = _two_runs(spark, d)
    chunks = got.chunks.select("chunk_set_id", "chunk_id", "chunk_index", F.md5("content").alias("digest"), "token_count")  # texts need not meet the bindings
    return got.bindings.select("kb_id", "file_url", "chunk_set_id").join(chunks, "chunk_set_id").select("kb_id", "file_url", "chunk_id", "chunk_index", "digest", "token_count")


@query("txt14_sets_after_runs", f"{_SETS} SELECT url AS file_url, sid AS chunk_set_id, '{_P.profile_id}' AS profile_id, sha256(md) AS markdown_hash, CASE WHEN run = 1 THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-03-08' END AS created_at, CASE WHEN sid IN (SELECT sid FROM made WHERE run = 2) THEN TIMESTAMP '2024-03-08' ELSE TIMESTAMP '2024-03-01' END AS updated_at FROM sets")
def _sets_after(spark, d):
    return _two_runs(spark, d, overwrite=True).sets.select("file_url", "chunk_set_id", "profile_id", "markdown_hash", "created_at", "updated_at")


# --- versioned vectors --------------------------------------------------------------------
# Four vectors make a file, a label a collection.  Version 1 has the files of the time, version 2 renews
# those whose Markdown is newer, fails those without, and drops files that left their collection.

_DIM = "(SELECT max(len(embedding)) FROM embeddings)"
_ERR = "CASE WHEN f % 13 = 0 THEN 'No markdown content found' WHEN f % 11 = 0 THEN 'No chunks created' END"


def _vector_files(spark, d) -> DataFrame:
    v = b.raw(spark, d, "embeddings")
    f = F.floor(F.col("vec_id") / 4)
    return v.select("vec_id", "embedding", F.concat(F.lit("kb"), F.col("label").cast("string")).alias("kb_id"), f.alias("f"), F.concat(F.lit("v://"), f.cast("string")).alias("file_url"), (F.col("vec_id") % 4).cast("int").alias("chunk_index"))


def _vector_versions(spark, d) -> vectorstore.Indexed:
    rows = _vector_files(spark, d)
    dim = len(_query_vector(spark, d))
    f, day = F.col("f"), lambda n: F.lit(f"2024-03-{n:02d}").cast("timestamp")
    files = rows.select("kb_id", "file_url", "f").distinct()
    members = files.select("kb_id", "file_url", F.lit(None).cast("timestamp").alias("indexed_at"), F.lit(0).cast("long").alias("chunk_count"))
    texts = files.select("file_url", "f").distinct()
    catalog = texts.select("file_url", F.lit("text").alias("markdown_content"), day(1).alias("markdown_updated_at"))
    chunks = lambda scale: rows.withColumn("by", scale).select("file_url", "f", "chunk_index", F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("content"), F.transform("embedding", lambda x: (x.cast("double") * F.col("by"))).alias("embedding"))
    empty = spark.createDataFrame([], "kb_id string, file_url string, chunk_id string, chunk_index int, content string, embedding array<double>, embedding_hash string, added int, deleted int")
    one = vectorstore.index(empty, members, catalog, chunks(F.lit(1.0)).drop("f"), 1, day(2), dim)
    left = one.members.join(texts, "file_url").filter("f % 7 <> 3").drop("f")
    newer = texts.select("file_url", F.when(f % 13 == 0, "  ").otherwise("text").alias("markdown_content"), F.when((f % 3 == 0) | (f % 11 == 0) | (f % 13 == 0), day(5)).otherwise(day(1)).alias("markdown_updated_at"))
    return vectorstore.index(one.store, left, newer, chunks(F.lit(-1.0)).filter("f % 11 <> 0").drop("f"), 2, day(6), dim)


_V = f"""WITH v AS (SELECT vec_id, embedding, 'kb' || label AS kb_id, vec_id // 4 AS f, 'v://' || (vec_id // 4) AS file_url, CAST(vec_id % 4 AS INT) AS chunk_index FROM embeddings),
 m AS (SELECT DISTINCT kb_id, file_url, f, f % 7 = 3 AS gone, f % 3 = 0 OR f % 11 = 0 OR f % 13 = 0 AS due, {_ERR} AS err FROM v),
 n AS (SELECT f, count(*) AS n FROM v GROUP BY f),
 e AS (SELECT v.*, 1 AS added, CASE WHEN gone OR (due AND err IS NULL) THEN 2 END AS deleted, 1.0 AS way FROM v JOIN m USING (kb_id, file_url, f) UNION ALL
  SELECT c.vec_id, c.embedding, m.kb_id, m.f, m.file_url, c.chunk_index, 2, NULL, -1.0 FROM m JOIN v c ON c.f = m.f WHERE NOT gone AND due AND err IS NULL UNION ALL
  SELECT c.vec_id, c.embedding, m.kb_id, m.f, m.file_url, c.chunk_index, 1, CASE WHEN gone OR (due AND err IS NULL) THEN 2 END, 1.0 FROM m JOIN v c ON c.f = m.f AND c.kb_id <> m.kb_id)"""


@query("vec12_incremental_index", f"{_V} SELECT kb_id, file_url, CASE WHEN NOT due THEN 'skipped' WHEN err IS NOT NULL THEN 'error' ELSE 'indexed' END AS state, CASE WHEN due AND err IS NULL THEN n ELSE 0 END AS chunks, CASE WHEN due THEN err END AS error FROM m JOIN n USING (f) WHERE NOT gone")
def _index(spark, d):
    return _vector_versions(spark, d).outcomes


@query("vec12_store_after_versions", f"{_V} SELECT kb_id || ':' || file_url || ':' || chunk_index || ':' || added AS chunk_id, 'c' || vec_id AS content, added, deleted FROM e")
def _store(spark, d):
    return _vector_versions(spark, d).store.select("chunk_id", "content", "added", "deleted")


_NEAR = "list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda z: (CAST(z[1] AS DOUBLE) * way - z[2]) * (CAST(z[1] AS DOUBLE) * way - z[2])))"


def _version_search(version: int) -> str:
    return f"{_V} SELECT chunk_id, round(d, 5) AS distance FROM (SELECT kb_id || ':' || file_url || ':' || chunk_index || ':' || added AS chunk_id, {_NEAR} AS d FROM e WHERE added <= {version} AND (deleted IS NULL OR deleted > {version})) ORDER BY d, chunk_id LIMIT 15"


@query("vec12_search_first_version", _version_search(1))
def _search_first(spark, d):
    return vectorstore.search(_vector_versions(spark, d).store, _query_vector(spark, d), 15, version=1).select("chunk_id", F.round("distance", 5).alias("distance"))


@query("vec12_search_newest_version", _version_search(2))
def _search_newest(spark, d):
    return vectorstore.search(_vector_versions(spark, d).store, _query_vector(spark, d), 15).select("chunk_id", F.round("distance", 5).alias("distance"))


@query("vec04_compacted_store", f"{_V}, s AS (SELECT kb_id, count(deleted) > 0.25 * count(*) AS crowded FROM e GROUP BY kb_id) SELECT kb_id, count(*) AS total_vectors, count(*) - count(deleted) AS active_vectors, count(deleted) AS deleted_vectors FROM e JOIN s USING (kb_id) WHERE deleted IS NULL OR NOT crowded GROUP BY kb_id")
def _compacted(spark, d):
    return vectorstore.shares(vectorstore.compact(_vector_versions(spark, d).store, 2, 0.25))


@query("dml13_index_version_rows", f"{_V} SELECT kb_id, 2 AS version, count(*) AS files, CAST(sum(CASE WHEN due AND err IS NULL THEN n ELSE 0 END) AS BIGINT) AS chunks, count(*) FILTER (due AND err IS NULL) AS indexed, count(*) FILTER (NOT due) AS skipped, count(*) FILTER (due AND err IS NOT NULL) AS errors FROM m JOIN n USING (f) WHERE NOT gone GROUP BY kb_id")
def _version_rows(spark, d):
    return _vector_versions(spark, d).versions


# --- canonical configurations -------------------------------------------------------------


def _object(names: str, values: dict[str, str], gap: str) -> str:
    """SQL text of an object with its keys in this order."""
    return "'{" + gap + "' || " + f" || ',{gap}' || ".join(f"'\"{n}\"{gap}:' || {values[n]}" for n in names) + f" || '{gap}}}'"


def _config(outer: str, inner: str, deep: str, gap: str = "") -> str:
    """A configuration with keys in the given orders at three levels."""
    own = {"x": "'\"' || lang || '\"'", "y": "'null'", "z": "'1.50'"}
    listed = f"'[1, ' || {_object(deep, own, gap)} || ']'"
    return _object(outer, {"a": "n_chars", "b": _object(inner, {**own, "z": listed}, gap), "c": "'2.0'"}, gap)


_CANON = """'{"a":' || n_chars || ',"b":{"x":"' || lang || '","y":null,"z":[1,{"x":"' || lang || '","y":null}]},"c":2}'"""


@query("jsn05_canonical_json", f"SELECT doc_id, {_CANON} AS config, sha256({_CANON}) AS config_hash FROM documents")
def _canonical(spark, d):
    docs = b.raw(spark, d, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.expr(_config("abc", "xyz", "xy"))).when(F.col("doc_id") % 3 == 1, F.expr(_config("cba", "zxy", "yx", " "))).otherwise(F.expr(_config("bca", "yzx", "yx")))
    return docs.select("doc_id", text.alias("j")).select("doc_id", canonical.canonical_json("j").alias("config"), canonical.config_hash("j").alias("config_hash"))
