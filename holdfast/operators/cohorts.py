"""Signup-quarter cohorts: heat map, trend and insight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.functions import business as B


def _dated(df: DataFrame) -> DataFrame:
    return df.where(F.col("signup_date").isNotNull()).withColumn(
        "signup_quarter", B.signup_quarter(F.col("signup_date"))
    )


def cohort_heatmap(df: DataFrame) -> DataFrame:
    """Churn percent by quarter and tenure group; an empty cell is null."""
    return (
        _dated(df)
        .groupBy("signup_quarter")
        .pivot("tenure_group", list(S.TENURE_GROUPS))
        .agg(F.avg("Churn_Numeric") * 100)
    )


def cohort_trend(df: DataFrame) -> DataFrame:
    """Churn percent per quarter, ordinal index, and the straight line through the quarters.

    Everything after the first aggregate works on one row per quarter.
    """
    quarters = _dated(df).groupBy("signup_quarter").agg(
        (F.avg("Churn_Numeric") * 100).alias("churn_rate_pct")
    )
    by_quarter = Window.orderBy("signup_quarter")
    indexed = quarters.withColumn("time_idx", (F.row_number().over(by_quarter) - 1).cast("int"))
    whole = Window.partitionBy()
    y, x = F.col("churn_rate_pct"), F.col("time_idx").cast("double")
    slope = F.coalesce(F.regr_slope(y, x).over(whole), F.lit(0.0))
    fitted = indexed.withColumns(
        {"slope": slope, "_y": F.avg("churn_rate_pct").over(whole), "_x": F.avg("time_idx").over(whole)}
    )
    level = F.col("_y") - F.col("slope") * F.col("_x")
    return fitted.select(
        "signup_quarter",
        "time_idx",
        "churn_rate_pct",
        "slope",
        (level + F.col("slope") * F.col("time_idx")).alias("trend"),
    )


def cohort_insight(trend: DataFrame) -> DataFrame:
    """Best and worst quarter and the direction; the earlier quarter wins a tie."""
    rate, quarter = F.col("churn_rate_pct"), F.col("signup_quarter")
    # Negated rates let one minimum pick the largest rate and the first quarter.
    worst = F.min(F.struct((-rate).alias("r"), quarter.alias("q")))
    best = F.min(F.struct(rate.alias("r"), quarter.alias("q")))
    return trend.agg(worst.alias("w"), best.alias("b"), F.max("slope").alias("slope")).select(
        F.col("w.q").alias("worst_quarter"),
        (-F.col("w.r")).alias("worst_rate_pct"),
        F.col("b.q").alias("best_quarter"),
        F.col("b.r").alias("best_rate_pct"),
        "slope",
        F.when(F.col("slope") > 0, "deteriorating").otherwise("improving").alias("direction"),
    )
