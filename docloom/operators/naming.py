"""Names of files that are free of conflicts, for a whole batch at once.

The first of equal new names keeps it if it is not taken; the others get the least free
numbers, in their order.  Numbers that names of the folder or of the batch already use are
passed over.  Places are counted in range partitions and shifted, so a name that most of the
batch has is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.readers import stored


def safe_name(c: Column) -> Column:
    """Without null characters and marks that paths use, white space as single blanks; ``file`` if nothing is left."""
    bare = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\u0000"), F.lit("")), r"(?U)^\s+|\s+$", "")
    flat = F.regexp_replace(F.regexp_replace(bare, r'[<>:"/\\|?*]+', "_"), r"(?U)\s+", " ")
    made = F.trim(flat)
    return F.when(made == "", "file").otherwise(made)


def stem_of(name: Column) -> Column:
    whole = F.regexp_extract(name, r"^(?s)(.*[^.].*)\.[^.]+$", 1)
    return F.when(whole == "", name).otherwise(whole)


def suffix_of(name: Column) -> Column:
    return F.substr(name, F.length(stem_of(name)) + 1, F.length(name))


def numbered(name: Column, number: Column) -> Column:
    return F.concat(stem_of(name), F.lit("_"), number, suffix_of(name))


def places(rows: DataFrame, keys: list[str], order: list[str], what: str) -> DataFrame:
    """Adds ``place``, from 1 in each key by the order; equal rows count on."""
    by = [F.col(f"`{c}`").asc_nulls_first() for c in (*keys, *order)]
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*by, "_salt").sortWithinPartitions(*by, "_salt").drop("_salt")
    held = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), what).withColumn("_part", F.shiftright("_at", 33))
    runs = held.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stored(runs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_in"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")), f"{what}-shifts")
    on = held["_part"] == shifts["_in"]
    for i, k in enumerate(keys):
        on = on & held[k].eqNullSafe(shifts[f"_k{i}"])
    return held.join(shifts, on).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_shift") + 1).alias("place"))


def without_conflicts(new: DataFrame, taken: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``free_name`` to rows of ``folder`` and ``name``; ``taken`` has folder and name of what is there.

    No two rows of a folder get the same name, and none gets one that is taken.  A null folder
    is the empty one; names are not null.
    """
    folder = F.coalesce("folder", F.lit("")).alias("folder")
    there = taken.select(folder, "name").distinct()
    rows = new.select(*[folder if c == "folder" else F.col(f"`{c}`") for c in new.columns])
    ranked = places(rows, ["folder", "name"], order, "names")
    marked = stored(ranked.join(there.withColumn("_there", F.lit(True)), ["folder", "name"], "left"), "marked-names")
    keeps = F.col("_there").isNull() & (F.col("place") == 1)
    waiting = marked.filter(~keeps).withColumn("nth", F.when(F.col("_there"), F.col("place")).otherwise(F.col("place") - 1))
    # numbers in use, under the name that they would be made from: of taken names and of those that are kept
    fixed = there.union(marked.filter(keeps).select("folder", "name"))
    number = F.regexp_extract("name", r"_([1-9][0-9]{0,8})(\.[^.]+)?$", 1)
    base = F.regexp_replace("name", r"_[1-9][0-9]{0,8}((?:\.[^.]+)?)$", "$1")
    numbers = fixed.filter(number != "").select("folder", base.alias("base"), number.alias("t"), "name").filter(numbered(F.col("base"), F.col("t")) == F.col("name"))
    used = numbers.select("folder", F.col("base").alias("name"), F.col("t").cast("long").alias("t")).join(waiting.select("folder", "name").distinct(), ["folder", "name"], "left_semi")
    # the j-th number in use has t - j free ones before it; those with t - j < n stand before the n-th free number
    none = F.lit(None).cast("long")
    before = places(used, ["folder", "name"], ["t"], "used-numbers").select("folder", "name", (F.col("t") - F.col("place")).alias("key"), F.lit(2).alias("kind"), none.alias("nth"))
    asking = waiting.select("folder", "name", F.col("nth").alias("key"), F.lit(1).alias("kind"), "nth")
    both = places(before.unionByName(asking), ["folder", "name"], ["key", "kind"], "merged-numbers")
    found = both.filter("nth IS NOT NULL").select("folder", "name", "nth", F.col("place").alias("number"))
    joined = waiting.drop("place").join(found, ["folder", "name", "nth"])
    shown = [F.col(f"`{c}`") for c in new.columns]
    made = joined.select(*shown, numbered(F.col("name"), F.col("number").cast("string")).alias("free_name"))
    return marked.filter(keeps).select(*shown, F.col("name").alias("free_name")).unionByName(made)
