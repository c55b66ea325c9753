"""Exact vector search.  score = 1 - d^2 / 2 with d the squared distance, as an L2 index reports it; or cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def scored(vectors: DataFrame, query: list[float], metric: str = "l2") -> DataFrame:
    """Adds distance and score; rows of another dimension are an error."""
    d = squared_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    score = 1 - F.col("distance") * F.col("distance") / 2 if metric == "l2" else 1 - F.col("distance") / 2
    return vectors.filter(F.size("embedding") == len(query)).withColumn("distance", d).withColumn("score", score)


def search(vectors: DataFrame, query: list[float], k: int = 10, threshold: float | None = None, metric: str = "l2") -> DataFrame:
    out = scored(vectors, query, metric)
    if threshold is not None:
        out = out.filter(F.col("score") >= threshold)
    return out.orderBy("distance", "vec_id").limit(k)


def search_collections(vectors: DataFrame, query: list[float], top_k: int = 10, min_each: int = 1) -> DataFrame:
    """Several collections (kb_id): enough of each, a bonus for rarely hit ones, a minimum of each, then the best."""
    n_kb = vectors.select("kb_id").distinct().count()
    per = max(top_k, 2 * n_kb)
    w = Window.partitionBy("kb_id").orderBy("distance", "vec_id")
    near = scored(vectors, query).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per)
    bonus = near.withColumn("adjusted", F.least(F.lit(1.0), F.col("score") + 0.3 / (1 + F.count("*").over(Window.partitionBy("kb_id")))))
    best = bonus.orderBy(F.desc("adjusted"), "vec_id").limit(top_k)
    least = bonus.withColumn("r", F.row_number().over(Window.partitionBy("kb_id").orderBy(F.desc("adjusted"), "vec_id"))).filter(F.col("r") <= min_each).drop("r")
    return best.union(least).dropDuplicates(["vec_id"]).orderBy(F.desc("adjusted"), "vec_id")
