"""Merkle manifest of a dataset with proofs kept as parent preimages.

Each row is a leaf, the hash of its fields.  The leaves of a group, in id order, are paired
level by level up to the group's root; the roots of the groups, in order of their names,
are paired in the same way up to the root of the dataset.  A parent is stored as its
preimage, the hashes of its children end to end.  What a leaf needs to prove itself are the
preimages of its ancestors: without its own 64 characters each holds the siblings, and with
another hash put in that place each gives the parent of a changed leaf.

At scale:

* Only ids, groups and hashes move; texts are hashed where they are read.
* Places in a group are counted within range partitions and shifted by the counts of the
  partitions before, so a group with most of the rows is spread over all tasks.
* ``BITS`` levels are built at a time from at most 2^BITS neighbours: one shuffle of a
  shrinking table for each five levels, whatever the number of rows.
* Ancestors come down the same way: each bundle of preimages joins the one above, and the
  leaves join only the lowest of them, by (group, place >> BITS), keys of at most 2^BITS rows.

Null fields hash as ``-``.  Null groups and ids come first in their order; rows of one id are
ordered by their hashes, and equal rows take neighbouring places.  Texts may have any length.
An empty table gives no rows.  Columns that are not fields are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.tables import crc32_of_id, table, written

BITS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<preimage:string,slot:int>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return sha(F.concat(*[field(c) for c in fields]))


def placed(rows: DataFrame, group: str, order: list[str], what: str) -> DataFrame:
    """Adds ``pos`` (0, 1, ... within the group in this order, nulls first) and ``n`` (rows of the group)."""
    by = [F.col(f"`{c}`").asc_nulls_first() for c in (group, *order)]
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows need not share a partition
    ranged = salted.repartitionByRange(*by, "salt").sortWithinPartitions(*by, "salt").drop("salt")
    # the number of a row in its sorted partition, held by writing it
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), what).withColumn("part", F.shiftright("at", 33))
    runs = ranged.groupBy(group, "part").agg(F.min("at").alias("run_first"), F.count("*").alias("run_n"))
    # a row for each group and partition that it reaches
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    shifts = runs.select(F.col(group).alias("of"), F.col("part").alias("in_part"), "run_first", F.coalesce(F.sum("run_n").over(earlier), F.lit(0)).alias("shift"), F.sum("run_n").over(whole).alias("n"))
    shifts = written(shifts, f"{what}-shifts")  # its size is known then: Spark broadcasts a small one
    both = ranged.join(shifts, ranged[group].eqNullSafe(shifts["of"]) & (ranged["part"] == shifts["in_part"]))
    return both.select(*rows.columns, (F.col("at") - F.col("run_first") + F.col("shift")).alias("pos"), "n")


def _levels(n: Column) -> Column:
    """Levels above n nodes in a bundle: all of them if the bundle is the only one."""
    height = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    return F.when(n > (1 << BITS), BITS).otherwise(height)


def _hashed(preimages: Column) -> Column:
    return F.transform(preimages, lambda p: sha(p))


def _pairs(nodes: Column) -> Column:
    """Every two neighbours end to end; a last single one stays alone."""
    at = F.sequence(F.lit(0), (F.size(nodes) - 1).cast("int"), F.lit(2))
    return F.transform(at, lambda i: F.array_join(F.slice(nodes, i + 1, 2), ""))


def _bundle(nodes: Column, levels: Column) -> Column:
    """struct(pre: the preimages of each level, top: the one node left, or the nodes left of a bundle)."""
    start = F.struct(F.array().cast("array<array<string>>").alias("pre"), nodes.alias("top"))

    def level(acc: Column, _: Column) -> Column:
        # a list of one binds the pairs to a name
        return F.transform(F.array(_pairs(acc["top"])), lambda p: F.struct(F.concat(acc["pre"], F.array(p)).alias("pre"), _hashed(p).alias("top")))[0]

    return F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(BITS)), F.lit(1), levels), start, level)


def bundles(nodes: DataFrame, what: str) -> list[DataFrame]:
    """Levels of the trees of all groups, ``BITS`` at a time, lowest first.

    ``nodes`` has group, pos, n and hash.  Each frame: group, at (place >> BITS), n (nodes of
    the group below), pre (preimages by level), top (the hash above them).
    """
    out: list[DataFrame] = []
    while True:
        gathered = nodes.groupBy("group", F.shiftright("pos", BITS).alias("at")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("kids"), F.first("n").alias("n"))
        built = gathered.select("group", "at", "n", _bundle(F.transform("kids", lambda k: k["hash"]), _levels(F.col("n"))).alias("b"))
        level = written(built.select("group", "at", "n", F.col("b.pre").alias("pre"), F.col("b.top")[0].alias("top")), f"{what}-{len(out)}")
        out.append(level)
        more = level.filter(F.col("n") > (1 << BITS))
        if more.isEmpty():
            return out
        nodes = more.select("group", F.col("at").alias("pos"), F.shiftright(F.col("n") + ((1 << BITS) - 1), BITS).alias("n"), F.col("top").alias("hash"))


def roots(levels: list[DataFrame]) -> DataFrame:
    """(group, hash): the root of each group."""
    tops = [x.filter(F.col("n") <= (1 << BITS)).select("group", F.col("top").alias("hash")) for x in levels]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out


def _steps(pre: Column, child: Column) -> Column:
    """The ancestors of a child within a bundle, lowest first, with its slot in each."""
    return F.transform(pre, lambda p, j: F.struct(F.get(p, _right(child, j + 1)).alias("preimage"), _right(child, j).bitwiseAND(F.lit(1)).cast("int").alias("slot")))


def _right(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value.cast("int"), by.cast("int"))


def ancestry(levels: list[DataFrame], above: DataFrame, what: str) -> DataFrame:
    """(group, at, pre, up) of the lowest bundles: their preimages, and the steps from their top on.

    ``above`` has group and up: the steps from each group's root on.
    """
    mine = F.pmod(F.col("at"), F.lit(1 << BITS))
    found: DataFrame | None = None
    for k, level in reversed(list(enumerate(levels))):
        ends = level.filter(F.col("n") <= (1 << BITS)).alias("l").join(above.alias("a"), F.col("l.group").eqNullSafe(F.col("a.group"))).select("l.group", "at", "pre", "up")
        if found is not None:
            higher = found.select(F.col("group").alias("of"), F.col("at").alias("over"), F.col("pre").alias("next_pre"), F.col("up").alias("next_up"))
            inner = level.filter(F.col("n") > (1 << BITS)).join(higher, F.col("group").eqNullSafe(F.col("of")) & (F.shiftright("at", BITS) == F.col("over")))
            ends = ends.union(inner.select("group", "at", "pre", F.concat(_steps(F.col("next_pre"), mine), F.col("next_up")).alias("up")))
        found = written(ends, f"{what}-up-{k}")
    return found


def with_steps(nodes: DataFrame, lowest: DataFrame) -> DataFrame:
    """Adds ``steps``: the ancestors of each node with its slot, lowest first, up to the dataset's root."""
    low = lowest.select(F.col("group").alias("of"), F.col("at").alias("over"), "pre", "up")
    joined = nodes.join(low, F.col("group").eqNullSafe(F.col("of")) & (F.shiftright("pos", BITS) == F.col("over")))
    return joined.withColumn("steps", F.concat(_steps(F.col("pre"), F.pmod(F.col("pos"), F.lit(1 << BITS))), F.col("up"))).drop("of", "over", "pre", "up")


def siblings(steps: Column) -> Column:
    """The hashes of all siblings end to end: each preimage without the own slot."""
    return F.array_join(F.transform(steps, lambda s: _spliced(s, F.lit(""))), "")


def _spliced(step: Column, instead: Column) -> Column:
    at = step["slot"] * 64
    return F.concat(F.substring(step["preimage"], F.lit(1), at), instead, F.substring(step["preimage"], at + 65, F.lit(64)))


def folded(steps: Column, leaf: Column) -> Column:
    """The root that this leaf gives with the siblings of its place."""
    return F.aggregate(steps, leaf, lambda acc, s: sha(_spliced(s, acc)))


def manifest(leaves: DataFrame, what: str = "manifest") -> DataFrame:
    """Adds subroot, root and ``steps`` to rows of group, id, hash and any others (not pos, n, subroot, root, steps)."""
    nodes = written(placed(written(leaves, f"{what}-leaves"), "group", ["id", "hash"], f"{what}-sorted"), f"{what}-placed")
    low = bundles(nodes, f"{what}-low")
    names = roots(low).select(F.lit(0).alias("all"), F.col("group").alias("name"), F.encode("group", "UTF-8").alias("bytes"), "hash")
    tops = placed(names, "all", ["bytes"], f"{what}-names").select(F.col("all").alias("group"), "name", "hash", "pos", "n")
    tops = written(tops, f"{what}-subroots")
    high = bundles(tops, f"{what}-high")
    root = roots(high).first()  # one row, or none
    end = roots(high).select("group", F.array().cast(_STEPS).alias("up"))
    above = with_steps(tops, ancestry(high, end, f"{what}-high")).select(F.col("name").alias("group"), F.col("steps").alias("up"))
    proven = with_steps(nodes, ancestry(low, written(above, f"{what}-above"), f"{what}-low"))
    subroots = roots(low).select(F.col("group").alias("of"), F.col("hash").alias("subroot"))
    joined = proven.join(written(subroots, f"{what}-roots"), F.col("group").eqNullSafe(F.col("of")))
    return joined.select(*leaves.columns, "subroot", F.lit(root.hash if root else None).cast("string").alias("root"), "steps")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = F.coalesce(crc32_of_id("doc_id") % 7 == 0, F.lit(False))
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    other = F.when(changed, leaf_hash([more.get(c, F.col(c)) for c in FIELDS]))
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf_hash([F.col(c) for c in FIELDS]).alias("hash"), other.alias("other"))
    proven = manifest(leaves)
    out = proven.select(F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", sha(siblings(F.col("steps"))).alias("proof_sha256"), folded(F.col("steps"), F.coalesce("other", "hash")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
