"""Additive logistic scorecard: a fixed linear form over feature columns.

It scores in plain column expressions, needs no fitted model and has exact additive drivers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.functions import business as B


def term_expressions() -> dict[str, Column]:
    """Feature name to its numeric column."""

    def is_level(column: str, level: str) -> Column:
        return F.when(F.col(column) == level, 1).otherwise(0)

    return {
        "tenure": F.col("tenure"),
        "MonthlyCharges": F.col("MonthlyCharges"),
        "engagement_score": F.col("engagement_score"),
        "complaints_count": F.col("complaints_count"),
        "customer_support_calls": F.col("customer_support_calls"),
        "late_payments": F.col("late_payments"),
        "HasMultiServices": F.col("HasMultiServices"),
        "IsSeniorWithPartner": F.col("IsSeniorWithPartner"),
        "Contract_Month-to-month": is_level("Contract", "Month-to-month"),
        "Contract_Two year": is_level("Contract", "Two year"),
        "InternetService_Fiber optic": is_level("InternetService", "Fiber optic"),
    }


@dataclass(frozen=True)
class Scorecard:
    intercept: float
    weights: dict[str, float]
    digits: int | None = 6

    def margin(self) -> Column:
        terms = term_expressions()
        total = F.lit(self.intercept)
        for name, weight in self.weights.items():
            total = total + F.lit(weight) * terms[name]
        return total

    def probability(self) -> Column:
        prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))
        return prob if self.digits is None else F.round(prob, self.digits)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``churn_prob``."""
        return df.withColumn("churn_prob", self.probability())


# A demonstration card over the account view; a user brings fitted weights.
DEFAULT_CARD = Scorecard(
    intercept=-0.55031,
    weights={
        "tenure": -0.03,
        "MonthlyCharges": 0.015,
        "engagement_score": -0.03,
        "complaints_count": 0.4,
        "customer_support_calls": 0.2,
        "late_payments": 0.1,
        "HasMultiServices": -0.15,
        "IsSeniorWithPartner": 0.3,
        "Contract_Month-to-month": 0.9,
        "Contract_Two year": -0.7,
        "InternetService_Fiber optic": 0.4,
    },
)


def add_value(df: DataFrame, floor: int = 0) -> DataFrame:
    """Expected remaining tenure, lifetime value and risk tier from ``churn_prob``."""
    prob = F.col("churn_prob")
    return df.withColumns(
        {
            "expected_remaining_tenure": B.remaining_tenure(F.col("tenure"), floor),
            "CLV": B.lifetime_value(F.col("MonthlyCharges"), F.col("tenure"), prob, floor),
            "churn_risk_tier": B.risk_tier(prob),
        }
    )


def rule_cluster() -> Column:
    """Four clusters by rule: young, old, and the middle split by monthly charge."""
    return (
        F.when(F.col("tenure") <= 24, 0)
        .when(F.col("tenure") > 54, 3)
        .when(F.col("MonthlyCharges") > 70, 1)
        .otherwise(2)
    )


def rule_segment(cluster: Column) -> Column:
    """Names the rule clusters carry by construction; see ``segments.name_clusters`` for fitted ones."""
    return (
        F.when(cluster == 0, S.NEW)
        .when(cluster == 1, S.AT_RISK)
        .when(cluster == 2, S.MID_TIER)
        .when(cluster == 3, S.VETERAN)
    )
