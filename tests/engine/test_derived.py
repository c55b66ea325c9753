"""Chunk sets, versioned vectors and canonical texts against plain models of their rules."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import canonical
from docloom.operators import chunking, chunksets, vectorstore

SETS = "chunk_set_id string, file_url string, profile_id string, markdown_hash string, status string, chunk_count long, created_at timestamp, updated_at timestamp"
CHUNKS = "chunk_id string, chunk_set_id string, chunk_index int, content string, token_count int, section_hierarchy string"
BOUND = "kb_id string, file_url string, chunk_set_id string, binding_mode string, target_profile_id string"
STORE = "kb_id string, file_url string, chunk_id string, chunk_index int, content string, embedding array<float>, embedding_hash string, added int, deleted int"


def day(n):
    return F.lit(f"2024-01-{n:02d}").cast("timestamp")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_generation_reuses_makes_and_moves(spark):
    none = lambda s: spark.createDataFrame([], s)
    cat = lambda r: spark.createDataFrame(r, "file_url string, markdown_content string")
    p, other = chunksets.Profile(chunk_size=60), chunksets.Profile(chunk_size=61)
    text = "# One\n" + "Words of the first part. " * 40 + "\n# Two\n" + "And more of them here. " * 60
    first = chunksets.generate(cat([("a", text), ("b", "short"), ("c", " \n"), ("d", None)]), none(SETS), none(CHUNKS), none(BOUND), p, day(1))
    got = {r.file_url: r for r in first.outcomes.collect()}
    assert {u: r.state for u, r in got.items()} == {"a": "made", "b": "made"}
    made = [r for r in first.chunks.orderBy("chunk_index").collect() if r.chunk_set_id == got["a"].chunk_set_id]
    assert [(r.content, r.section_hierarchy) for r in made] == [(c, h) for h, c in chunking.chunk(text, 60, 20)] and len(made) > 3
    assert [r.chunk_id for r in made] == [f"{got['a'].chunk_set_id}:{i}" for i in range(len(made))] and got["a"].chunk_count == len(made)
    bound = chunksets.bind(chunksets.bind(none(BOUND), first.outcomes, "k1", p), first.outcomes, "k2", p, "pin")
    bound = bound.unionByName(spark.createDataFrame([("k3", "a", "x", "follow_latest", other.profile_id), ("k4", "a", "x", "follow_latest", None)], BOUND))

    again = chunksets.generate(cat([("a", text), ("b", "short")]), first.sets, first.chunks, bound, p, day(2))
    assert {r.state for r in again.outcomes.collect()} == {"reused"}
    assert (rows(again.sets), rows(again.chunks), rows(again.bindings)) == (rows(first.sets), rows(first.chunks), rows(bound))

    moved = chunksets.generate(cat([("a", text + "new"), ("b", "short")]), first.sets, first.chunks, bound, p, day(3))
    now = {r.file_url: r for r in moved.outcomes.collect()}
    assert (now["a"].state, now["a"].synced_bindings, now["b"].state, now["b"].synced_bindings) == ("made", 1, "reused", 0)
    to = {(r.kb_id, r.file_url): r.chunk_set_id for r in moved.bindings.collect()}
    assert to == {("k1", "a"): now["a"].chunk_set_id, ("k1", "b"): got["b"].chunk_set_id, ("k2", "a"): got["a"].chunk_set_id, ("k2", "b"): got["b"].chunk_set_id, ("k3", "a"): "x", ("k4", "a"): "x"}
    assert moved.sets.count() == 3

    over = chunksets.generate(cat([("b", "short")]), first.sets, first.chunks, bound, p, day(4), overwrite=True)
    assert [(r.state, r.chunk_set_id) for r in over.outcomes.collect()] == [("overwritten", got["b"].chunk_set_id)]
    assert rows(over.chunks) == rows(first.chunks)
    times = {r.file_url: (r.created_at.day, r.updated_at.day) for r in over.sets.collect()}
    assert times == {"a": (1, 1), "b": (1, 4)}
    with pytest.raises(ValueError):
        chunksets.bind(bound, first.outcomes, "k", p, "loose")


def test_profiles():
    a = chunksets.Profile(metadata={"x": {"b": 1, "a": [2]}, "y": "é"})
    b = chunksets.Profile(metadata={"y": "é", "x": {"a": [2], "b": 1}})
    assert a.profile_id == b.profile_id != chunksets.Profile().profile_id
    assert (chunksets.Profile(0, 50).chunk_size, chunksets.Profile(0, 50).chunk_overlap, chunksets.Profile(20_000, -1).chunk_size, chunksets.Profile(100, 100).chunk_overlap) == (1, 0, 10_000, 99)
    text = '{"chunk_overlap":100,"chunk_size":800,"metadata":{},"splitter":"semantic","tokenizer":"cl100k_base","version":"v1"}'
    assert chunksets.Profile().config_hash == hashlib.sha256(text.encode()).hexdigest()
    with pytest.raises(ValueError):
        chunksets.Profile(splitter="other")


def test_fixed_windows(spark):
    docs = spark.createDataFrame([("a", "x" * 100), ("b", ""), ("c", "abcdefgh"), ("d", "é" * 41)], "k string, t string")
    got = {}
    for r in chunking.fixed_windows(docs, 10, 2, "k", "t").orderBy("chunk_index").collect():
        got.setdefault(r.k, []).append((r.content, r.token_count))
    assert got == {k: [(t[i : i + 40], max(1, len(t[i : i + 40]) // 4) if t else 0) for i in range(0, max(len(t), 1), 32)] for k, t in (("a", "x" * 100), ("b", ""), ("c", "abcdefgh"), ("d", "é" * 41))}


def test_versions_against_a_plain_model(spark):
    """Random files come, change, lose their Markdown and leave; every version is searched as it was."""
    rng = random.Random(9)
    store, members = spark.createDataFrame([], STORE), None
    plain: list[dict] = []
    indexed: dict[tuple, int] = {}
    seen: dict[int, list] = {}
    vector = {(f, i, s): [rng.uniform(-1, 1) for _ in range(3)] for f in range(8) for i in range(3) for s in range(6)}
    for v in range(1, 6):
        now = [(k, f"f{f}") for k in ("a", "b") for f in range(8) if rng.random() < 0.8]
        md = {f"f{f}": (rng.choice(["text", "text", "text", " ", None]), rng.choice([v, v, 1])) for f in range(8)}
        gone = {f"f{f}" for f in range(8) if rng.random() < 0.15}
        odd = f"f{rng.randrange(8)}"
        parts = [(f"f{f}", i, f"c{f}-{i}", vector[f, i, v] + ([0.5] if f"f{f}" == odd and i == 1 else [])) for f in range(8) if f"f{f}" not in gone for i in range(1 + f % 3)]
        rows_in = [(k, f, indexed.get((k, f))) for k, f in now]
        table = spark.createDataFrame(rows_in, "kb_id string, file_url string, day int").select("kb_id", "file_url", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(12), F.lit(0), F.lit(0)).alias("indexed_at"), F.lit(0).cast("long").alias("chunk_count"))
        catalog = spark.createDataFrame([(f, t, d) for f, (t, d) in md.items()], "file_url string, markdown_content string, day int").select("file_url", "markdown_content", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(13), F.lit(0), F.lit(0)).alias("markdown_updated_at"))
        chunks = spark.createDataFrame(parts, "file_url string, chunk_index int, content string, embedding array<float>")
        got = vectorstore.index(store, table, catalog, chunks, v, F.make_timestamp(F.lit(2024), F.lit(1), F.lit(v), F.lit(12), F.lit(0), F.lit(0)), 3)
        want = {}
        for k, f in now:
            day_ = indexed.get((k, f))
            if day_ is not None and md[f][1] < day_:
                want[k, f] = ("skipped", None)
            elif not (md[f][0] or "").strip():
                want[k, f] = ("error", vectorstore.NO_MARKDOWN)
            elif f in gone:
                want[k, f] = ("error", vectorstore.NO_CHUNKS)
            elif f == odd and any(len(p[3]) != 3 for p in parts if p[0] == f):
                want[k, f] = ("error", "Vector dimension is not 3")
            else:
                want[k, f] = ("indexed", None)
        assert {(r.kb_id, r.file_url): (r.state, r.error) for r in got.outcomes.collect()} == want
        for e in plain:
            if e["deleted"] is None and want.get((e["kb"], e["f"]), ("indexed",))[0] == "indexed":
                e["deleted"] = v
        for (k, f), (state, _) in want.items():
            if state == "indexed":
                indexed[k, f] = v
                plain += [{"kb": k, "f": f, "id": f"{k}:{f}:{i}:{v}", "v": x, "added": v, "deleted": None} for g, i, _, x in parts if g == f]
        indexed = {x: d for x, d in indexed.items() if x in set(now)}
        store = got.store.checkpoint() if spark.sparkContext.getCheckpointDir() else spark.createDataFrame(got.store.collect(), STORE)
        assert {(r.chunk_id, r.added, r.deleted) for r in store.collect()} == {(e["id"], e["added"], e["deleted"]) for e in plain}
        seen[v] = [e["id"] for e in plain if e["deleted"] is None]
        query = [0.3, -0.2, 0.5]
        for u in range(1, v + 1):
            near = sorted((sum((float(F32(a)) - b) ** 2 for a, b in zip(e["v"], query)), e["id"]) for e in plain if e["added"] <= u and (e["deleted"] is None or e["deleted"] > u))
            assert [r.chunk_id for r in vectorstore.search(store, query, 5, version=u).collect()] == [x for _, x in near[:5]]
    small = vectorstore.compact(store, 4, 0.0)
    assert {r.chunk_id for r in small.collect()} == {e["id"] for e in plain if e["deleted"] is None or e["deleted"] > 4}
    assert vectorstore.compact(store, 4, 1.0).count() == len(plain)
    assert sorted(r.chunk_id for r in vectorstore.alive(small, 5).collect()) == sorted(seen[5])
    removed = vectorstore.remove(store, spark.createDataFrame([("a", f"f{f}") for f in range(8)] * 2, "kb_id string, file_url string"), 6)
    assert {r.chunk_id for r in vectorstore.alive(removed).collect()} == {x for x in seen[5] if x.startswith("b")}


def F32(x):
    import numpy as np

    return np.float32(x)


def test_canonical_texts(spark):
    a = {"b": {"z": [1, {"q": None, "p": True}], "y": "é\n\"", "x": 1.5}, "a": -3, "é": {}}
    b = {"é": {}, "a": -3, "b": {"x": 1.5, "y": "é\n\"", "z": [1, {"p": True, "q": None}]}}
    texts = [json.dumps(a), json.dumps(b, indent=2, ensure_ascii=False), "nope", '{"a":1,"a":2}', None, "[2.0, 1.50, 1e2]", "3"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "j string").select(canonical.canonical_json("j")).collect()]
    assert got[0] == got[1] == canonical.canonical_text(a) == canonical.canonical_text(b)
    assert got[2:] == [None, None, None, "[2,1.5,100.0]", "3"]
