"""Scored records and counterfactual scoring. A scorer is any function that adds ``churn_prob``."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.functions import business as B
from holdfast.operators.features import serving_features

Scorer = Callable[[DataFrame], DataFrame]


def score_records(df: DataFrame, scorer: Scorer, engagement: str = "keep") -> DataFrame:
    """Raw records to response columns: decision, rounded probability, tier, advice and value."""
    scored = scorer(serving_features(df, engagement))
    prob = F.col("churn_prob")
    value = B.lifetime_value(F.col("MonthlyCharges"), F.col("tenure"), prob, floor=1)
    return scored.withColumns(
        {
            "churn_prediction": prob > 0.5,
            "probability": F.round(prob, 4),
            "risk_tier": B.risk_tier(prob),
            "recommendation": B.recommendation(B.risk_tier(prob)),
            "clv_estimate": F.round(value, 2),
        }
    )


def _scenario_rows(df: DataFrame, scenarios: Mapping[str, Mapping[str, object]]) -> Column:
    """Literal array of (scenario, new value per touched column); untouched columns are null."""
    types = dict(df.dtypes)
    touched = [c for c in df.columns if any(c in changes for changes in scenarios.values())]
    rows = [
        F.struct(
            F.lit(name).alias("scenario"),
            *[F.lit(changes.get(c)).cast(types[c]).alias(c) for c in touched],
        )
        for name, changes in scenarios.items()
    ]
    return F.array(*rows)


def _apply(df: DataFrame, scenarios: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """One row per (row, scenario), changed columns overwritten; unknown columns are ignored.

    The scenarios are a literal array, so the product is a narrow step and joins nothing.
    """
    columns = df.columns
    touched = [c for c in columns if any(c in changes for changes in scenarios.values())]
    many = df.withColumn("_new", F.explode(_scenario_rows(df, scenarios)))
    changed = {c: F.coalesce(F.col(f"_new.{c}"), F.col(c)) for c in touched}
    picked = [changed.get(c, F.col(c)).alias(c) for c in columns]
    return many.select(*picked, F.col("_new.scenario").alias("scenario"))


def what_if(
    df: DataFrame,
    scenarios: Mapping[str, Mapping[str, object]],
    scorer: Scorer,
    mode: str = "rebuild",
    engagement: str = "keep",
    key: str = S.KEY,
) -> DataFrame:
    """Original and simulated probability, tier and value per (account, scenario).

    ``rebuild``: raw records; features are derived again after the change, the simulated value uses
    the new charge, and the remaining months floor at 1. ``frozen_features``: feature rows; features
    stay as given, the value uses the original charge, and the floor is 0.
    """
    if mode not in ("rebuild", "frozen_features"):
        raise ValueError(f"unknown mode {mode!r}")
    rebuild = mode == "rebuild"
    floor = 1 if rebuild else 0
    columns = df.columns
    before = df.withColumn("_row", F.struct(*columns))
    before = scorer(serving_features(before, engagement) if rebuild else before)
    before = before.select(
        "_row.*",
        F.col("churn_prob").alias("original_prob"),
        F.col("MonthlyCharges").alias("_charge"),
    )
    changed = _apply(before, scenarios)
    after = scorer(serving_features(changed, engagement) if rebuild else changed)
    old, new = F.col("original_prob"), F.col("churn_prob")
    new_charge = F.col("MonthlyCharges") if rebuild else F.col("_charge")
    old_value = B.lifetime_value(F.col("_charge"), F.col("tenure"), old, floor)
    new_value = B.lifetime_value(new_charge, F.col("tenure"), new, floor)
    old_tier, new_tier = B.risk_tier(old), B.risk_tier(new)
    return after.select(
        key,
        "scenario",
        F.struct(
            old.alias("probability"), old_tier.alias("risk_tier"), old_value.alias("clv_estimate")
        ).alias("original"),
        F.struct(
            new.alias("probability"), new_tier.alias("risk_tier"), new_value.alias("clv_estimate")
        ).alias("simulated"),
        F.struct(
            (new - old).alias("probability_change"),
            (new_value - old_value).alias("clv_change"),
            F.concat_ws(" -> ", old_tier, new_tier).alias("risk_tier_change"),
        ).alias("delta"),
    )


# The interventions the interactive simulator offers.
DEFAULT_SCENARIOS: dict[str, dict[str, object]] = {
    "one_year": {"Contract": "One year"},
    "two_year": {"Contract": "Two year"},
    "discount": {"MonthlyCharges": 45.0},
    "support": {"TechSupport": "Yes"},
    "bundle": {"Contract": "Two year", "MonthlyCharges": 60.0, "TechSupport": "Yes"},
}
