"""Similar accounts: up to k hash-drawn accounts within +-6 months and +-10 of the charge.

All pairs in range would be quadratic. Every account has one fixed hash priority, so the wanted
accounts are the k lowest priorities in a rectangle. Each grid cell keeps its lowest priorities
(a per-task top-n before the shuffle, whatever the cell holds); the 3x3 cells around an account
give its candidates as one short sorted array. A match is exact when it lies below the point where
some cell was cut. Accounts whose matches do not are answered by an exact grid join.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.functions.hashing import uniform

_OPEN = 2.0  # above every priority: the cell is listed whole


def _in_reach(c: Column, tenure_reach: int, charge_reach: float) -> Column:
    t, m = F.col("tenure"), F.col("MonthlyCharges")
    return c["tenure"].between(t - tenure_reach, t + tenure_reach) & c["charge"].between(
        m - charge_reach, m + charge_reach
    )


def _cells_around(rows: DataFrame) -> DataFrame:
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    wide = rows.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return wide.withColumns({"_x": F.col("_x") + F.col("_dx"), "_y": F.col("_y") + F.col("_dy")}).drop(
        "_dx", "_dy"
    )


def similar_accounts(
    df: DataFrame,
    key: str = S.KEY,
    k: int = 5,
    tenure_reach: int = 6,
    charge_reach: float = 10.0,
    listed: int = 16,
    salt: str = "similar",
) -> DataFrame:
    """(key, similar): the array holds (priority, key, tenure, charge, churned), lowest first.

    An account without tenure or charge is near no one: it keeps its row, with an empty array.
    """
    slack = 1 + 1e-9  # keeps the far edge of the reach inside the next cell despite rounding
    points = df.select(
        key,
        "tenure",
        "MonthlyCharges",
        F.floor(F.col("tenure") / (tenure_reach * slack)).alias("_x"),
        F.floor(F.col("MonthlyCharges") / (charge_reach * slack)).alias("_y"),
        F.struct(
            uniform(F.col(key), salt).alias("priority"),
            F.col(key).alias("key"),
            F.col("tenure").alias("tenure"),
            F.col("MonthlyCharges").alias("charge"),
            F.when(F.col("Churn") == "Yes", 1).otherwise(0).alias("churned"),
        ).alias("_me"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    cell = ["_x", "_y"]
    by_priority = Window.partitionBy(*cell).orderBy("_me.priority", "_me.key")
    lists = (
        points.select(*cell, "_me", F.row_number().over(by_priority).alias("_at"))
        .where(F.col("_at") <= listed)
        .groupBy(*cell)
        .agg(F.array_sort(F.collect_list("_me")).alias("_list"))
    )
    full = F.size("_list") == listed
    lists = lists.withColumn(
        "_horizon", F.when(full, F.element_at("_list", -1)["priority"]).otherwise(_OPEN)
    )
    around = (
        _cells_around(lists)
        .groupBy(*cell)
        .agg(
            F.array_sort(F.flatten(F.collect_list("_list"))).alias("_near"),
            F.min("_horizon").alias("_horizon"),
        )
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    # The optimizer broadcasts the cells under its byte limit. A row without a cell has no one near it.
    joined = points.join(around, cell, "left")
    mine = F.col(key)
    found = F.filter(
        F.coalesce("_near", F.array()), lambda c: _in_reach(c, tenure_reach, charge_reach) & (c["key"] != mine)
    )
    first = joined.withColumn("similar", F.slice(found, 1, k))
    first = first.withColumn("_horizon", F.coalesce("_horizon", F.lit(_OPEN)))
    enough = (F.size("similar") == k) & (F.element_at("similar", -1)["priority"] <= F.col("_horizon"))
    first = first.withColumn("_done", enough | (F.col("_horizon") == _OPEN))
    first = first.select(*points.columns, "similar", "_done").persist(StorageLevel.MEMORY_AND_DISK)
    done = first.where("_done").select(key, "similar")
    rest = first.where("not _done").drop("similar", "_done")
    if rest.isEmpty():
        return done
    return done.unionByName(_grid_join(rest, points, key, k, tenure_reach, charge_reach))


def _grid_join(
    rest: DataFrame, points: DataFrame, key: str, k: int, tenure_reach: int, charge_reach: float
) -> DataFrame:
    """Exact answer for any accounts. Accounts at one spot share their k+1 lowest priorities."""
    spot = ["tenure", "MonthlyCharges"]
    at_spot = Window.partitionBy(*spot).orderBy("_me.priority", "_me.key")
    kept = points.withColumn("_at", F.row_number().over(at_spot)).where(F.col("_at") <= k + 1)
    kept = kept.select("_x", "_y", F.col("_me").alias("_other"))
    spots = _cells_around(rest.select(*spot, "_x", "_y").distinct())
    pairs = spots.join(kept, ["_x", "_y"]).where(
        _in_reach(F.col("_other"), tenure_reach, charge_reach)
    )
    best = Window.partitionBy(*spot).orderBy("_other.priority", "_other.key")
    lists = (
        pairs.withColumn("_at", F.row_number().over(best))
        .where(F.col("_at") <= k + 1)
        .groupBy(*spot)
        .agg(F.array_sort(F.collect_list("_other")).alias("_near"))
    )
    joined = rest.join(lists, spot, "left")
    mine = F.col(key)
    near = F.coalesce("_near", F.array())
    others = F.filter(near, lambda c: c["key"] != mine)
    return joined.select(key, F.slice(others, 1, k).alias("similar"))


def similar_summary(similar: DataFrame, key: str = S.KEY) -> DataFrame:
    """How many similar accounts were found, which, and the share that churned."""
    churned = F.aggregate("similar", F.lit(0), lambda total, c: total + c["churned"])
    return similar.select(
        key,
        F.size("similar").alias("n_similar"),
        churned.alias("n_churned"),
        F.try_divide(churned.cast("double"), F.size("similar")).alias("churned_share"),
        F.array_join(F.transform("similar", lambda c: c["key"].cast("string")), ",").alias("similar_ids"),
    )
