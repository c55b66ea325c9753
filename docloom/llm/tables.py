"""Reading the driver's tables, and tables that one run writes for itself."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set, as in tests."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(set_by_cluster)
        return set_by_cluster
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "docloom-checkpoints"))
    return str(spark.sparkContext.getCheckpointDir())


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BATCH_CONF, SPARKS_OWN, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB, as a batch is held in the JVM and twice in Python; a session's own setting stays."""
    if spark.conf.get(BATCH_CONF, SPARKS_OWN) == SPARKS_OWN:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def quoted(name: str) -> Column:
    """A column by its name, whatever signs that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """All columns as one struct."""
    return F.struct(*[quoted(c) for c in df.columns if c not in but])


def bounded_broadcast(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """Hint a broadcast only if the frame was counted to have at most ``rows`` rows; else leave the join to Catalyst."""
    n = df.limit(rows + 1).count()
    return (F.broadcast(df), True) if n <= rows else (df, False)


def crc32_of_id(c: str) -> Column:
    return F.crc32(F.col(c).cast("string").cast("binary"))
