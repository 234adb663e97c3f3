"""Segment profiles, cluster naming, value at risk and the aggregates over scored accounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.operators.ordered import median_of


def is_churn(column: str = "Churn") -> Column:
    return F.when(F.col(column) == "Yes", 1.0).otherwise(0.0)


def churn_rate(df: DataFrame) -> DataFrame:
    """Share of churned rows in percent."""
    return df.agg((F.avg(is_churn()) * 100).alias("churn_rate_pct"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows and share per value. The window runs over the counts only."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def churn_by(df: DataFrame, dimension: str) -> DataFrame:
    """Churn percent per level of a column."""
    return df.groupBy(dimension).agg(
        (F.avg(is_churn()) * 100).alias("churn_rate_pct"), F.count(F.lit(1)).alias("n")
    )


def first_by(df: DataFrame, value: str, label: str, largest: bool = True) -> DataFrame:
    """The row with the largest (or smallest) value; the first label wins a tie."""
    order = F.desc_nulls_last(value) if largest else F.asc_nulls_last(value)
    return df.orderBy(order, F.asc(label)).limit(1)


def cluster_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster").agg(
        F.avg("tenure").alias("avg_tenure"),
        F.avg("MonthlyCharges").alias("avg_monthly"),
        F.avg("complaints_count").alias("avg_complaints"),
        F.avg("Churn_Numeric").alias("churn_rate"),
    )


def name_clusters(profile: DataFrame) -> DataFrame:
    """(cluster, customer_segment): youngest, oldest, and the middle two by monthly charge.

    ``profile`` has one row per cluster, four in all, so one task ranks them.
    """
    by_age = Window.orderBy("avg_tenure", "cluster")
    placed = profile.withColumns(
        {
            "_age": F.row_number().over(by_age),
            "_last": F.count(F.lit(1)).over(Window.partitionBy()),
        }
    )
    middle = (F.col("_age") > 1) & (F.col("_age") < F.col("_last"))
    by_charge = Window.partitionBy(middle).orderBy(F.desc("avg_monthly"), "cluster")
    placed = placed.withColumn("_charge", F.row_number().over(by_charge))
    name = (
        F.when(F.col("_age") == 1, S.NEW)
        .when(F.col("_age") == F.col("_last"), S.VETERAN)
        .when(F.col("_charge") == 1, S.AT_RISK)
        .otherwise(S.MID_TIER)
    )
    return placed.select("cluster", name.alias("customer_segment"))


def attach_segments(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Add the segment name of each row's cluster; the names are one row per cluster."""
    if names is None:
        names = name_clusters(cluster_profile(df))
    rest = [c for c in df.columns if c != "customer_segment"]
    return df.select(*rest).join(F.broadcast(names), "cluster", "left")


def segment_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("customer_segment").agg(
        F.count("customer_segment").alias("size"),
        F.avg("tenure").alias("avg_tenure"),
        F.avg("MonthlyCharges").alias("avg_monthly"),
        F.avg("complaints_count").alias("avg_complaints"),
        F.avg("engagement_score").alias("avg_engagement"),
        (F.avg("Churn_Numeric") * 100).alias("churn_rate_pct"),
    )


def at_risk() -> Column:
    return F.col("churn_prob") > 0.5


def segment_value(df: DataFrame) -> DataFrame:
    """Value per segment; a segment without an at-risk row has null at risk, not zero."""
    return df.groupBy("customer_segment").agg(
        F.count("customer_segment").alias("n"),
        F.avg("CLV").alias("avg_clv"),
        F.avg("churn_prob").alias("avg_prob"),
        F.sum(F.when(at_risk(), F.col("CLV"))).alias("clv_at_risk"),
    )


def segment_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("customer_segment").agg(
        F.count("customer_segment").alias("n"),
        F.avg("Churn_Numeric").alias("churn_rate"),
        F.avg("CLV").alias("avg_clv"),
        F.avg("churn_prob").alias("avg_prob"),
        (F.avg("churn_prob") * 100).alias("avg_churn_prob_pct"),
    )


def segment_balance(df: DataFrame, ratio: int = 3) -> DataFrame:
    """Largest and smallest segment, and whether they differ by more than ``ratio``."""
    counts = df.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.max("n").alias("largest"),
        F.min("n").alias("smallest"),
        (F.max("n") > ratio * F.min("n")).alias("unequal"),
    )


def revenue_at_risk(df: DataFrame, recovery: float = 0.10) -> DataFrame:
    """At-risk count and value, the recovered share, and the confidence bands, in one pass."""
    prob = F.col("churn_prob")
    value = F.sum(F.when(at_risk(), F.col("CLV")).otherwise(0.0))
    sure = F.when((prob < 0.15) | (prob > 0.85), 1.0).otherwise(0.0)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(at_risk(), 1)).alias("at_risk"),
        value.alias("clv_at_risk"),
        (value * recovery).alias("recoverable"),
        (F.avg(sure) * 100).alias("high_confidence_pct"),
        F.count(F.when(prob.between(0.4, 0.6), 1)).alias("borderline"),
    )


def batch_summary(df: DataFrame) -> DataFrame:
    """Totals of a scored batch; an empty batch has a null rate."""
    churners = F.count(F.when(at_risk(), 1))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        churners.alias("churners"),
        F.try_divide(churners * 100.0, F.count(F.lit(1))).alias("churn_rate_pct"),
        F.coalesce(F.sum(F.when(at_risk(), F.col("CLV"))), F.lit(0.0)).alias("total_clv_at_risk"),
    )


def value_grid(df: DataFrame, prob_step: float = 0.05, value_step: float = 500.0) -> DataFrame:
    """Binned points of the value-against-probability plane per segment, with mean charge.

    Charges are added up in whole cents, so the mean does not depend on the order of rows.
    """
    cents = F.sum(F.round(F.col("MonthlyCharges") * 100).cast("bigint"))
    n = F.count(F.lit(1))
    return df.groupBy(
        "customer_segment",
        F.floor(F.col("churn_prob") / prob_step).cast("int").alias("prob_bin"),
        F.floor(F.col("CLV") / value_step).cast("int").alias("clv_bin"),
    ).agg(n.alias("n"), (cents.cast("double") / (n.cast("double") * 100.0)).alias("avg_monthly"))


def scatter(df: DataFrame, x: str, y: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.col(x).alias("x"), F.col(y).alias("y"))


def top_rows(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k largest rows; a top-k per task, then a merge of those."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(k)


def vip_list(df: DataFrame, key: str = S.KEY, k: int = 200) -> DataFrame:
    """The k most valuable at-risk accounts above the median value."""
    valuable = df.where(at_risk() & (F.col("CLV") > median_of(df, "CLV")))
    return top_rows(valuable, "CLV", key, k)


def saved_revenue(vips: DataFrame, months: int = 12) -> DataFrame:
    return vips.agg(
        F.count(F.lit(1)).alias("vips"), (F.sum("MonthlyCharges") * months).alias("saved_revenue")
    )


def review_queue(df: DataFrame) -> DataFrame:
    """Accounts a person should look at."""
    return df.where((F.col("churn_prob") > 0.40) & (F.col("customer_segment") == S.AT_RISK))


def playbook(df: DataFrame, strongest: DataFrame | None = None, most: int = 2) -> DataFrame:
    """Retention play per named segment that occurs, with its churn rate and value.

    ``strongest`` has (customer_segment, feature, position) rows as ``attribution.segment_drivers`` gives them; its first
    ``most`` features are the drivers then, in words, in place of the fixed text.
    """
    plays = df.sparkSession.createDataFrame(
        list(S.PLAYBOOK),
        "position int, customer_segment string, drivers string, action string, urgency string",
    )
    if strongest is not None:
        words = F.initcap(F.regexp_replace(F.regexp_replace("feature", "([a-z])([A-Z])", "$1 $2"), "_", " "))
        first = strongest.where(F.col("position") <= most).groupBy("customer_segment").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", words.alias("w")))), lambda d: d["w"]), ", ").alias("drivers")
        )
        plays = plays.drop("drivers").join(first, "customer_segment", "left")
    return segment_stats(df).join(plays, "customer_segment").select(
        "position",
        "customer_segment",
        (F.col("churn_rate") * 100).alias("churn_rate_pct"),
        "avg_clv",
        "drivers",
        "action",
        "urgency",
    )


def metrics_rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One wide row of numbers to (metric, value) rows."""
    pairs = ", ".join(f"'{name}', cast(`{name}` as double)" for name in names)
    return df.select(F.expr(f"stack({len(names)}, {pairs}) as (metric, value)"))
