"""Kaplan-Meier survival over months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96


def survival_curve(df: DataFrame, duration: str = "tenure", event: str = "Churn_Numeric") -> DataFrame:
    """Survival, its Greenwood variance sum and a log-log 95 % band per distinct duration.

    Rows are counted per duration first; the windows run over those counts (months).
    """
    per_time = (
        df.where(F.col(duration).isNotNull())
        .groupBy(F.col(duration).alias("time"))
        .agg(
            F.count(F.lit(1)).alias("removed"),
            F.sum(F.when(F.col(event) == 1, 1).otherwise(0)).alias("events"),
        )
    )
    onward = Window.orderBy("time").rowsBetween(0, Window.unboundedFollowing)
    upto = Window.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    table = per_time.withColumn("at_risk", F.sum("removed").over(onward))
    n, d = F.col("at_risk"), F.col("events")
    table = table.withColumns(
        {
            "_log": F.when(d < n, F.ln(1.0 - d / n)).otherwise(0.0),
            "_var": F.when(d < n, d / (n.cast("double") * (n - d))).otherwise(0.0),
            "_gone": F.max(F.when(d == n, 1).otherwise(0)).over(upto),
        }
    )
    table = table.withColumns(
        {
            "survival": F.when(F.col("_gone") == 1, 0.0).otherwise(F.exp(F.sum("_log").over(upto))),
            "variance_sum": F.sum("_var").over(upto),
        }
    )
    s = F.col("survival")
    reach = F.lit(Z95) * F.sqrt("variance_sum") / F.ln(s)
    bounded = (s > 0) & (s < 1)
    return table.select(
        "time",
        "at_risk",
        "events",
        "survival",
        "variance_sum",
        F.when(bounded, F.pow(s, F.exp(-reach))).otherwise(s).alias("lower"),
        F.when(bounded, F.pow(s, F.exp(reach))).otherwise(s).alias("upper"),
    )


def survival_at(curve: DataFrame, time: float) -> DataFrame:
    """Survival at the last duration not after ``time``; 1 before the first."""
    last = F.max_by("survival", "time")
    return curve.where(F.col("time") <= time).agg(F.coalesce(last, F.lit(1.0)).alias("survival"))
