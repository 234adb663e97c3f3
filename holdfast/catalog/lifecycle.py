"""Cohort and survival queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.catalog.aggregates import rounded
from holdfast.catalog.registry import query
from holdfast.operators import cohorts, survival
from holdfast.plans.scored import scored_accounts

_QUARTER = "year(signup_date)::VARCHAR || 'Q' || quarter(signup_date)::VARCHAR"


@query(
    "cohort_heatmap",
    f"""
SELECT {_QUARTER} AS signup_quarter, """
    + ", ".join(
        f"round(avg(CASE WHEN tenure_group = '{g}' THEN \"Churn_Numeric\" END) * 100, 6) AS \"{g}\""
        for g in ("New", "Regular", "Loyal", "Veteran")
    )
    + " FROM scored GROUP BY 1",
)
def cohort_heatmap(spark, sf_dir):
    heat = cohorts.cohort_heatmap(scored_accounts(spark, sf_dir))
    return rounded(heat, 6, "New", "Regular", "Loyal", "Veteran")


_TREND = f""", quarters AS (
  SELECT {_QUARTER} AS signup_quarter, avg("Churn_Numeric") * 100 AS rate FROM scored GROUP BY 1),
indexed AS (
  SELECT *, CAST(row_number() OVER (ORDER BY signup_quarter) - 1 AS INTEGER) AS time_idx FROM quarters),
line AS (
  SELECT coalesce(regr_slope(rate, time_idx), 0.0::DOUBLE) AS slope, avg(rate) AS y, avg(time_idx) AS x
  FROM indexed)"""


@query(
    "cohort_trend",
    _TREND
    + """
SELECT signup_quarter, time_idx, round(rate, 6) AS churn_rate_pct, round(slope, 6) AS slope,
  round(y - slope * x + slope * time_idx, 6) AS trend FROM indexed CROSS JOIN line""",
)
def cohort_trend(spark, sf_dir):
    trend = cohorts.cohort_trend(scored_accounts(spark, sf_dir))
    return rounded(trend, 6, "churn_rate_pct", "slope", "trend")


@query(
    "cohort_insight",
    _TREND
    + """
SELECT (SELECT signup_quarter FROM indexed ORDER BY rate DESC, signup_quarter LIMIT 1) AS worst_quarter,
  round((SELECT max(rate) FROM indexed), 6) AS worst_rate_pct,
  (SELECT signup_quarter FROM indexed ORDER BY rate, signup_quarter LIMIT 1) AS best_quarter,
  round((SELECT min(rate) FROM indexed), 6) AS best_rate_pct, round(slope, 6) AS slope,
  CASE WHEN slope > 0 THEN 'deteriorating' ELSE 'improving' END AS direction FROM line""",
)
def cohort_insight(spark, sf_dir):
    found = cohorts.cohort_insight(cohorts.cohort_trend(scored_accounts(spark, sf_dir)))
    return rounded(found, 6, "worst_rate_pct", "best_rate_pct", "slope")


_KM = """, times AS (
  SELECT tenure AS t, count(*) AS removed, CAST(sum("Churn_Numeric") AS BIGINT) AS d FROM scored GROUP BY 1),
risk AS (
  SELECT t, d, CAST(sum(removed) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS n
  FROM times),
logs AS (
  SELECT *, CASE WHEN d < n THEN ln(1.0::DOUBLE - CAST(d AS DOUBLE) / n) ELSE 0.0::DOUBLE END AS lg,
    CASE WHEN d < n THEN d / (CAST(n AS DOUBLE) * (n - d)) ELSE 0.0::DOUBLE END AS vr FROM risk),
curve AS (
  SELECT t, n, d, CASE WHEN max(CASE WHEN d = n THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0::DOUBLE
      ELSE exp(sum(lg) OVER w) END AS s, sum(vr) OVER w AS v
  FROM logs WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    "survival_curve",
    _KM
    + """
SELECT t AS time, n AS at_risk, d AS events, round(s, 8) AS survival, round(v, 10) AS variance_sum,
  round(CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(-(1.96::DOUBLE * sqrt(v) / ln(s)))) ELSE s END, 8) AS lower,
  round(CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(1.96::DOUBLE * sqrt(v) / ln(s))) ELSE s END, 8) AS upper
FROM curve""",
)
def survival_curve(spark, sf_dir):
    curve = survival.survival_curve(scored_accounts(spark, sf_dir))
    return rounded(rounded(curve, 8, "survival", "lower", "upper"), 10, "variance_sum")


@query(
    "survival_12m",
    _KM + "SELECT round(s * 100, 6) AS survival_pct FROM curve WHERE t <= 12 ORDER BY t DESC LIMIT 1",
)
def survival_12m(spark, sf_dir):
    curve = survival.survival_curve(scored_accounts(spark, sf_dir))
    return survival.survival_at(curve, 12).select(F.round(F.col("survival") * 100, 6).alias("survival_pct"))
