"""Centroid assignment, inertia and silhouette."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.hashing import uniform


def squared_distance(columns: Sequence[str], centre: Sequence[float]) -> Column:
    parts = [
        (F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v)))
        for c, v in zip(columns, centre, strict=True)
    ]
    return reduce(lambda a, b: a + b, parts)


def assign_nearest(df: DataFrame, columns: Sequence[str], centres: Mapping[int, Sequence[float]]) -> DataFrame:
    """Add ``cluster`` and ``distance2`` of the nearest centre; the lower cluster wins a tie."""
    choices = [
        F.struct(squared_distance(columns, centre).alias("d"), F.lit(cluster).alias("c"))
        for cluster, centre in sorted(centres.items())
    ]
    nearest = F.least(*choices) if len(choices) > 1 else choices[0]
    return df.withColumn("_near", nearest).select(
        *df.columns, F.col("_near.c").alias("cluster"), F.col("_near.d").alias("distance2")
    )


def recentre(assigned: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Size, within-cluster sum of squares and mean per cluster: the next centres."""
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("distance2").alias("inertia"),
        *[F.avg(c).alias(c) for c in columns],
    )


def silhouette(df: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """Mean silhouette under squared Euclidean distance, from cluster moments in one pass."""
    evaluator = ClusteringEvaluator(
        featuresCol=features, predictionCol=cluster, distanceMeasure="squaredEuclidean"
    )
    return evaluator.evaluate(df)


def euclidean_silhouette(
    df: DataFrame, key: str, features: str, cluster: str = "cluster", block: int = 4_096
) -> DataFrame:
    """(key, silhouette) under Euclidean distance, exact.

    Every row is compared with every other, so the work is quadratic: a diagnostic for moderate
    tables, with ``silhouette`` for large ones. Rows are cut into blocks
    by key hash; a task compares two blocks and emits one sum per row and cluster.
    """
    blocks = max(1, -(-df.count() // block))
    rows = df.select(
        F.col(key).alias("key"),
        F.col(features).alias("x"),
        F.col(cluster).cast("int").alias("c"),
        F.floor(uniform(F.col(key), "silhouette") * blocks).cast("int").alias("_b"),
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.withColumn("i", F.col("_b")).withColumn("j", every).drop("_b")
    right = rows.withColumn("j", F.col("_b")).withColumn("i", every).drop("_b")

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(a) and len(b):
            xa, xb = (np.stack(p["x"].to_numpy()) for p in (a, b))
            cb = b["c"].to_numpy()
            d2 = np.zeros((len(xa), len(xb)))
            for j in range(xa.shape[1]):
                d2 += np.square(xa[:, j][:, None] - xb[:, j][None, :])
            d = np.sqrt(d2)
            for c in np.unique(cb):
                hit = cb == c
                parts.append(
                    pd.DataFrame(
                        {"key": a["key"], "c": a["c"], "other": c, "total": d[:, hit].sum(axis=1), "n": hit.sum()}
                    )
                )
        empty = pd.DataFrame({"key": [], "c": [], "other": [], "total": [], "n": []})
        return pd.concat(parts) if parts else empty

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(
        sums, "key bigint, c int, other int, total double, n bigint"
    )
    per = met.groupBy("key", "c", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("c") == F.col("other")
    sides = per.groupBy("key", "c").agg(
        F.max(F.when(own, F.col("n"))).alias("_n"),
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("_a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("_b"),
    )
    top = F.greatest("_a", "_b")
    score = F.when((F.col("_n") == 1) | (top == 0), 0.0).otherwise((F.col("_b") - F.col("_a")) / top)
    return sides.select(F.col("key").alias(key), score.alias("silhouette"))


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, covariance) for all pairs of columns, a <= b, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(
        *[
            F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    cells = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return one.select(F.expr(f"stack({len(pairs)}, {cells}) as (a, b, covariance)"))
