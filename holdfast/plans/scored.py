"""The scored account table: features, probability, segment, value and tier per account."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.functions import business as B
from holdfast.operators import features, scorecard
from holdfast.sources.accounts import accounts


def score_frame(df: DataFrame, floor: int = 0, card: scorecard.Scorecard = scorecard.DEFAULT_CARD) -> DataFrame:
    """Feature rows to scored rows; every added column is a plain expression."""
    scored = scorecard.add_value(card.score(df), floor)
    scored = scored.withColumn("cluster", scorecard.rule_cluster())
    scored = scored.withColumn("customer_segment", scorecard.rule_segment(F.col("cluster")))
    if "Churn" in df.columns:
        scored = scored.withColumn("Churn_Numeric", B.churn_flag(F.col("Churn")))
    return scored


def featured_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.serving_features(accounts(spark, sf_dir), engagement="keep")


def scored_accounts(spark: SparkSession, sf_dir: str, floor: int = 0) -> DataFrame:
    """Scored account view. A job that reads it often writes it once, partitioned by quarter."""
    return score_frame(featured_accounts(spark, sf_dir), floor)


def with_quarter(df: DataFrame) -> DataFrame:
    return df.withColumn("signup_quarter", B.signup_quarter(F.col("signup_date")))


def scored_columns() -> list[str]:
    return [S.KEY, "churn_prob", "churn_risk_tier", "CLV", "customer_segment"]
