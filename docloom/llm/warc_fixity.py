"""WARC fixity audit with Merkle trees over records and ordered offset ranges.

A page is a WARC response record.  Records stand in id order in files of ``FANOUT`` squared
ids; their offsets are running sums within the file.  A record's leaf hashes its id,
length and SHA-256; the node above hashes its at most ``FANOUT`` children in offset order
together with the bytes they span, and so on up to one root for each replica.  Nodes are
named by id ranges (id div FANOUT^level), so a damaged record does not move its neighbours.

The audit compares the roots and descends, level by level, only below nodes that differ;
it never hashes or joins records of equal ranges again.

Null ids are put behind all others in ranges chosen by a hash of the record.  Records with
the same id share a leaf: it hashes all of them in the order of their digests, and all of
them are reported alike.  Null urls and contents are empty.  Two empty replicas are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.tables import table, written

FANOUT = 32
_BITS = 5


def record_bytes(id_col: Column, url: Column, body: Column) -> Column:
    """A WARC response record as binary."""
    content = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(id_col.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(head, content, F.lit("\r\n\r\n")), "UTF-8")


def manifest(records: DataFrame) -> DataFrame:
    """(page_id, slot, file, record_offset, record_bytes, record_sha256) of a table (page_id, record)."""
    sha = F.sha2("record", 256)
    spare = F.lit(1 << 44) + F.pmod(F.xxhash64("record"), F.lit(1 << 30))
    hashed = records.select("page_id", F.coalesce("page_id", spare).alias("slot"), F.octet_length("record").cast("long").alias("record_bytes"), sha.alias("record_sha256"))
    hashed = hashed.withColumn("file", F.shiftright("slot", 2 * _BITS))
    before = Window.partitionBy("file").orderBy("slot", "record_sha256").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.withColumn("record_offset", F.coalesce(F.sum("record_bytes").over(before), F.lit(0)))


def _leaves(m: DataFrame) -> DataFrame:
    """(node, hash, bytes) by slot."""
    one = F.concat_ws("|", F.col("record_bytes").cast("string"), "record_sha256")
    return m.groupBy("slot").agg(F.sha2(F.concat_ws("\n", F.col("slot").cast("string"), F.array_sort(F.collect_list(one))), 256).alias("hash"), F.sum("record_bytes").alias("bytes")).withColumnRenamed("slot", "node")


def _above(level: DataFrame) -> DataFrame:
    return level.groupBy(F.shiftright("node", _BITS).alias("parent")).agg(
        F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: c["hash"]), F.sum("bytes").cast("string")), 256).alias("hash"),
        F.sum("bytes").alias("bytes"),
    ).withColumnRenamed("parent", "node")


def tree(m: DataFrame, levels: int) -> list[DataFrame]:
    """Levels from the leaves to the root; each is written, being a 32nd of the one below."""
    out = [written(_leaves(m), "fixity-0")]
    for k in range(1, levels):
        out.append(written(_above(out[-1]), f"fixity-{k}"))
    return out


def levels_for(top_slot: int) -> int:
    return 1 + max(1, -(-max(1, top_slot).bit_length() // _BITS))


def differing_slots(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """Slots whose leaves differ, found by descending from the roots through differing nodes only."""
    below: DataFrame | None = None
    for left, right in zip(reversed(a), reversed(b)):
        if below is not None:
            inside = below.select(F.col("node").alias("up"))
            left, right = (x.join(inside, F.shiftright(x["node"], _BITS) == F.col("up"), "left_semi") for x in (left, right))
        both = left.select("node", F.col("hash").alias("h_a")).join(right.select("node", F.col("hash").alias("h_b")), "node", "full_outer")
        below = both.filter(~F.col("h_a").eqNullSafe(F.col("h_b"))).select("node")
    return below.withColumnRenamed("node", "slot")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row a record of either replica: page_id, file, record_offset, record_bytes, record_sha256 (of a, else b) and status.

    status: ok, corrupt (both have the id, the content differs), missing (not in b), extra (not in a).
    """
    ma, mb = written(manifest(a), "manifest-a"), written(manifest(b), "manifest-b")
    top = ma.select("slot").union(mb.select("slot")).agg(F.max("slot")).first()[0]
    levels = levels_for(top or 0)
    bad = written(differing_slots(tree(ma, levels), tree(mb, levels)), "differing")
    lost = bad.join(mb.select("slot").distinct(), "slot", "left_anti").withColumn("st", F.lit("missing"))
    new = bad.join(ma.select("slot").distinct(), "slot", "left_anti").withColumn("st", F.lit("extra"))
    changed = bad.join(lost, "slot", "left_anti").join(new, "slot", "left_anti").withColumn("st", F.lit("corrupt"))
    columns = ["page_id", "file", "record_offset", "record_bytes", "record_sha256"]
    old = ma.join(lost.union(changed), "slot", "left").select(*columns, F.coalesce("st", F.lit("ok")).alias("status"))
    return old.union(mb.join(new, "slot").select(*columns, F.col("st").alias("status")))


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica with faults at known ids: a flipped first character, a lost record."""
    mark = F.pmod(F.col("page_id") * F.lit(48271), F.lit(1009))
    body = F.when(mark == 7, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    return pages.filter(F.coalesce(mark != 11, F.lit(True))).withColumn("html", body)


def records(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def op5_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(records(pages), records(damaged(pages)))
