"""Keyed changes to tables as pure functions: a new snapshot comes out, nothing is overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of new replace those of old with equal keys; columns in ``keep`` retain the old value.  Null keys equal no others."""
    a, b = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    on = None
    for k in keys:
        same = F.col(f"o.`{k}`") == F.col(f"n.`{k}`")
        on = same if on is None else on & same
    has_old, has_new = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
    out = []
    for c in old.columns:
        o = F.col(f"o.`{c}`")
        n = F.col(f"n.`{c}`") if c in new.columns else o
        value = F.when(has_old, o).otherwise(n) if c in keys else F.coalesce(o, n) if c in keep else F.when(has_new, n).otherwise(o)
        out.append(value.alias(c))
    return a.join(b, on, "full_outer").select(*out)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keeps what is there; adds rows whose keys are new."""
    return old.unionByName(new.join(old, keys, "left_anti").select(*old.columns))


def delete_rows(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone, keys, "left_anti")


def set_where(df: DataFrame, when: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(F.coalesce(when, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key, the greatest by these columns; partial maxima are taken before rows move."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def earliest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key, the least by these columns."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def latest_ready_sets(sets: DataFrame) -> DataFrame:
    return latest(sets.filter("status = 'ready'"), ["file_url", "profile_id"], "updated_at", "chunk_set_id")


def follow_latest(bindings: DataFrame, sets: DataFrame) -> DataFrame:
    """Bindings in follow_latest mode point to the newest ready set of their file."""
    new = latest_ready_sets(sets).select("file_url", F.col("chunk_set_id").alias("_new"))
    moved = bindings.join(new, "file_url", "left")
    target = F.when((F.col("binding_mode") == "follow_latest") & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("chunk_set_id"))
    return moved.select(*[target.alias(c) if c == "chunk_set_id" else F.col(c) for c in bindings.columns])


def orphan_sets(sets: DataFrame, bindings: DataFrame, limit: int, before: Column) -> DataFrame:
    """The oldest unbound sets; the age cut-off applies after the limit."""
    return sets.join(bindings, "chunk_set_id", "left_anti").orderBy("updated_at", "chunk_set_id").limit(limit).filter(F.col("updated_at") < before)


def changes(before: DataFrame, after: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, reason): added, removed or the changed columns."""
    a, b = before.alias("a"), after.alias("b")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in cols]))
    reason = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").otherwise(F.array_join(changed, ","))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), reason.alias("reason")).filter("reason <> ''")
