"""Derived account columns, in the serving and in the training variant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.functions import business as B
from holdfast.operators import cleaning as C


def multi_services(df: DataFrame) -> Column:
    """How many of the four add-on services the account has; absent columns count as none."""
    held = [F.when(F.col(s) == "Yes", 1).otherwise(0) for s in S.MULTI_SERVICES if s in df.columns]
    return reduce(lambda a, b: a + b, held) if held else F.lit(0)


def senior_with_partner() -> Column:
    return F.when((F.col("SeniorCitizen") == 1) & (F.col("Partner") == "Yes"), 1).otherwise(0)


def derived_engagement() -> Column:
    score = F.col("avg_monthly_usage") / 5 + F.col("number_of_logins") * 2 - F.col("last_active_days")
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score.cast("double")))


def serving_features(df: DataFrame, engagement: str = "auto") -> DataFrame:
    """Features as the scoring path computes them.

    ``engagement``: ``keep`` the given column, ``derive`` it, or ``auto`` – derive it only when
    the column is absent or null in every row (one aggregate over that column).
    """
    if engagement not in ("auto", "keep", "derive"):
        raise ValueError(f"unknown engagement mode {engagement!r}")
    present = "engagement_score" in df.columns
    known = None
    if engagement == "auto" and present:
        known = df.agg(F.count("engagement_score")).scalar()
    df = C.fill_charges(C.fill_defaults(df))
    df = df.withColumn("SeniorCitizen", C.senior_flag())
    score = derived_engagement()
    if known is not None:
        score = F.when(known > 0, F.col("engagement_score")).otherwise(score)
    elif engagement == "keep" and present:
        score = F.col("engagement_score")
    return df.withColumns(
        {
            "charges_per_month": F.col("TotalCharges") / F.greatest(F.col("tenure"), F.lit(1)),
            "tenure_group": B.tenure_group(F.col("tenure")),
            "engagement_score": score,
            "HasMultiServices": multi_services(df),
            "IsSeniorWithPartner": senior_with_partner(),
        }
    )


def mean_charge(df: DataFrame) -> float:
    """Training mean of MonthlyCharges: fit it once and pass it to every later scoring run."""
    return df.agg(F.avg("MonthlyCharges")).first()[0]


def training_features(df: DataFrame, charge_mean: float | Column | None = None) -> DataFrame:
    """Features as the training path computes them.

    ``charge_mean`` is the fitted mean; without it the mean of ``df`` is taken as a subquery. The
    signup date becomes year and month; a missing year takes the median year.
    """
    if charge_mean is None:
        charge_mean = df.agg(F.avg("MonthlyCharges")).scalar()
    elif not isinstance(charge_mean, Column):
        charge_mean = F.lit(charge_mean)
    if "signup_date" in df.columns:
        # Few distinct years: the exact median keeps a small map per task.
        years = df.select(F.year(C.to_day("signup_date")).alias("y"))
        median_year = years.agg(F.median("y")).scalar()
        signup = C.to_day("signup_date")
        df = df.withColumns(
            {
                "signup_year": F.coalesce(F.year(signup).cast("double"), median_year),
                "signup_month": F.coalesce(F.month(signup), F.lit(0)),
            }
        ).drop("signup_date")
    ratio = F.try_divide(F.col("TotalCharges").cast("double"), F.col("tenure") + 1)
    finite = F.when(F.isnan(ratio) | (F.abs(ratio) == float("inf")), F.lit(None)).otherwise(ratio)
    return df.withColumns(
        {
            "charges_per_month": F.coalesce(finite, F.lit(0.0)),
            "tenure_group": B.tenure_group(F.col("tenure"), last_edge=72, missing=None),
            "HasMultiServices": multi_services(df),
            "IsSeniorWithPartner": senior_with_partner(),
            "ChargeToIncomeProxy": F.col("MonthlyCharges") / charge_mean,
        }
    )


def model_inputs(df: DataFrame, *keep: str) -> DataFrame:
    """The 28 model inputs after the columns to keep; fails when one is absent."""
    C.require_columns(df, S.MODEL_INPUTS)
    return df.select(*keep, *S.MODEL_INPUTS)
