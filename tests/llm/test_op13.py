import hashlib
import random
import zlib

import pytest

from docloom.llm import merkle_manifest as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, steps string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, at):
    """(sibling or '', own slot) from the bottom."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append((level[other] if other < len(level) else "", at % 2))
        at //= 2
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    low = {g: tree([x[2] for x in groups[g]]) for g in names}
    high = tree([low[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, h, r) in enumerate(groups[g]):
            path = climb(low[g], i) + climb(high, k)
            now = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                now = leaf(*r[:4], r[4] + 1)
            for other, slot in path:
                now = sha(other + now) if slot else sha(now + other)
            out.append((r[0], h, low[g][-1][0], high[-1][0], sha("".join(o for o, _ in path)), now, now == high[-1][0]))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path, parts=5):
    d = tmp_path / "t"
    spark.createDataFrame([(*r[:5], 1, "x") for r in rows], SCHEMA).repartition(parts).write.parquet(str(d / "documents.parquet"))
    return sorted((tuple(r) for r in m.op13_merkle_manifest(spark, str(d)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [2], [3], [31, 32, 33], [64, 65, 1, 5], [1025, 1024, 33]])
def test_group_sizes(spark, tmp_path, sizes):
    rng = random.Random(sum(sizes))
    rows = [(k * 10_000 + i, f"text {i} é", f"l{k}", None if i % 5 == 0 else "src", None if i % 4 == 0 else rng.randrange(99)) for k, n in enumerate(sizes) for i in range(n)]
    got = run(spark, rows, tmp_path)
    assert got == brute(rows)
    assert {r[6] for r in got} <= {True, False}


def test_many_groups_nulls_and_repeated_rows(spark, tmp_path):
    names = [None, "", "é", "z", "日本", "A", "￿", "😀", *(f"g{i}" for i in range(60))]
    rows = [(i, None if i % 7 == 0 else f"t{i}", names[i % len(names)], "s", i) for i in range(400)]
    rows += [(None, "x", "en", None, None), (None, "x", "en", None, None), (None, "y", None, None, 5)] + [(7, "same", "en", "s", 4)] * 50 + [(1, "", "", "", 2**63 - 1)]
    got = run(spark, rows, tmp_path)
    assert got == brute(rows)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_long_text_and_empty_table(spark, tmp_path):
    rows = [(i, "word " * 1_000_000, "en", "s", 1) for i in range(3)]
    assert run(spark, rows, tmp_path / "a") == brute(rows)
    assert run(spark, [], tmp_path / "b") == []


def test_any_changed_field_breaks_the_proof(spark):
    rows = spark.createDataFrame([(g, i, sha(f"{g}{i}"), f"x{i}") for g in ("a", "b", None) for i in range(70)], "`group` string, id long, hash string, more string")
    proven = m.manifest(rows)
    assert proven.columns == ["group", "id", "hash", "more", "subroot", "root", "steps"]
    got = proven.select(m.folded(proven["steps"], proven["hash"]).alias("good"), m.folded(proven["steps"], m.sha(proven["hash"])).alias("bad"), "root").collect()
    assert len(got) == 210 and len({r.root for r in got}) == 1
    assert all(r.good == r.root != r.bad for r in got)
