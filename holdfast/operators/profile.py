"""Column profile and box-plot statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.ordered import exact_quantiles, long_values, quantile_columns

QUARTILES = {0.25: "q1", 0.5: "median", 0.75: "q3"}


def dtypes(df: DataFrame) -> DataFrame:
    """Column name and type, one row per column."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, data_type string")


def profile(
    df: DataFrame, numeric: Sequence[str], text: Sequence[str], digits: int | None = None
) -> DataFrame:
    """One row per column: count, and moments with quartiles for numbers or top value for text."""

    def tidy(column):
        return column if digits is None else F.round(column, digits)

    moments = long_values(df, [], numeric).groupBy("metric").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = quantile_columns(exact_quantiles(df, [], numeric, list(QUARTILES)), [], QUARTILES)
    numbers = moments.join(quartiles, "metric", "left").select(
        F.col("metric").alias("column_name"),
        "n",
        F.lit(None).cast("bigint").alias("n_unique"),
        F.lit(None).cast("string").alias("top"),
        F.lit(None).cast("bigint").alias("freq"),
        *[tidy(F.col(c)).alias(c) for c in ("mean", "std")],
        "min",
        *[tidy(F.col(c)).alias(c) for c in QUARTILES.values()],
        "max",
    )
    pairs = ", ".join(f"'{name}', cast(`{name}` as string)" for name in text)
    levels = (
        df.select(F.expr(f"stack({len(text)}, {pairs}) as (column_name, level)"))
        .where(F.col("level").isNotNull())
        .groupBy("column_name", "level")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    words = levels.groupBy("column_name").agg(
        F.sum("k").alias("n"),
        F.count(F.lit(1)).alias("n_unique"),
        F.min(F.struct((-F.col("k")).alias("k"), "level")).alias("_top"),
    )
    empty = [F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max")]
    words = words.select(
        "column_name",
        "n",
        "n_unique",
        F.col("_top.level").alias("top"),
        (-F.col("_top.k")).alias("freq"),
        *empty,
    )
    return numbers.unionByName(words)


def box_stats(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per group and metric."""
    quartiles = quantile_columns(
        exact_quantiles(df, [group], values, list(QUARTILES)), [group], QUARTILES
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    rows = long_values(df.where(F.col(group).isNotNull()), [group], values)
    # One row per group and metric.
    return (
        rows.join(F.broadcast(quartiles), [group, "metric"])
        .groupBy(group, "metric", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"),
        )
    )
