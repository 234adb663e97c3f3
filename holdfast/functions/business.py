"""Risk tier, recommendation, lifetime value and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast import schema as S

# A probability above the edge belongs to the tier.
TIER_EDGES = (("Critical", 0.75), ("High", 0.50), ("Medium", 0.25))
HORIZON_MONTHS = 72


def risk_tier(prob: Column) -> Column:
    tier = F.when(prob.isNull(), F.lit(None).cast("string"))
    for name, edge in TIER_EDGES:
        tier = tier.when(prob > edge, name)
    return tier.otherwise("Low")


def recommendation(tier: Column) -> Column:
    text = None
    for name, advice in S.RECOMMENDATIONS.items():
        text = F.when(tier == name, advice) if text is None else text.when(tier == name, advice)
    return text


def remaining_tenure(tenure: Column, floor: int = 0) -> Column:
    """Months left of the horizon; batch scoring floors at 0, the scoring service at 1."""
    return F.greatest(F.lit(floor), F.lit(HORIZON_MONTHS) - tenure)


def lifetime_value(monthly: Column, tenure: Column, prob: Column, floor: int = 0) -> Column:
    return monthly * remaining_tenure(tenure, floor) * (F.lit(1.0) - prob)


def churn_flag(label: Column) -> Column:
    """1 for Yes, 0 for anything else."""
    return F.when(label == "Yes", 1).otherwise(0)


def churn_label(label: Column) -> Column:
    """1 for Yes, 0 for No after trimming, null for anything else."""
    clean = F.trim(label)
    return F.when(clean == "Yes", 1).when(clean == "No", 0)


def tenure_group(tenure: Column, last_edge: int | None = None, missing: str | None = "New") -> Column:
    """Right-closed bands (-1,12], (12,24], (24,48], (48,last]."""
    last_edge = 1000 if last_edge is None else last_edge
    band = F.when((tenure > -1) & (tenure <= 12), "New")
    band = band.when((tenure > 12) & (tenure <= 24), "Regular")
    band = band.when((tenure > 24) & (tenure <= 48), "Loyal")
    band = band.when((tenure > 48) & (tenure <= last_edge), "Veteran")
    return band.otherwise(F.lit(missing))


def signup_quarter(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))
