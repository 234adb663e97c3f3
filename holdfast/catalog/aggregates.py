"""Aggregates over raw and scored accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.catalog.registry import query
from holdfast.functions import business as B
from holdfast.operators import ordered, profile, segments
from holdfast.plans.scored import scored_accounts
from holdfast.sources.accounts import accounts


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "overall_churn",
    """
SELECT round(avg(CASE WHEN "Churn" = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6) AS churn_rate_pct
FROM accounts""",
)
def overall_churn(spark, sf_dir):
    return rounded(segments.churn_rate(accounts(spark, sf_dir)), 6, "churn_rate_pct")


@query(
    "value_counts_share",
    """
SELECT customer_segment, churn_risk_tier, count(*) AS n,
  round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
FROM scored GROUP BY 1, 2""",
)
def value_counts_share(spark, sf_dir):
    counts = segments.value_counts(scored_accounts(spark, sf_dir), "customer_segment", "churn_risk_tier")
    return rounded(counts, 6, "share")


@query(
    "group_medians",
    """
SELECT "Churn",
  round(quantile_cont(CAST(number_of_logins AS DOUBLE), 0.5), 4) AS number_of_logins,
  round(quantile_cont(CAST(complaints_count AS DOUBLE), 0.5), 4) AS complaints_count,
  round(quantile_cont(engagement_score, 0.5), 4) AS engagement_score,
  round(quantile_cont("MonthlyCharges", 0.5), 4) AS "MonthlyCharges",
  round(quantile_cont(charges_per_month, 0.5), 4) AS charges_per_month
FROM featured GROUP BY 1""",
)
def group_medians(spark, sf_dir):
    names = ["number_of_logins", "complaints_count", "engagement_score", "MonthlyCharges", "charges_per_month"]
    medians = ordered.exact_quantiles(scored_accounts(spark, sf_dir), ["Churn"], names, [0.5])
    wide = medians.groupBy("Churn").pivot("metric", names).agg(F.max("quantile"))
    return rounded(wide, 4, *names)


_BOXED = ("number_of_logins", "complaints_count", "engagement_score", "MonthlyCharges", "CLV")


@query(
    "boxplot_stats",
    ", long AS ("
    + " UNION ALL ".join(
        f"SELECT \"Churn\", '{m}' AS metric, CAST(\"{m}\" AS DOUBLE) AS v FROM scored" for m in _BOXED
    )
    + """), quart AS (
  SELECT "Churn", metric, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
    quantile_cont(v, 0.75) AS q3 FROM long GROUP BY 1, 2)
SELECT "Churn", metric, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  round(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END), 4) AS whisker_low,
  round(max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END), 4) AS whisker_high,
  CAST(sum(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS outliers
FROM long JOIN quart USING ("Churn", metric) GROUP BY "Churn", metric, q1, median, q3""",
)
def boxplot_stats(spark, sf_dir):
    stats = profile.box_stats(scored_accounts(spark, sf_dir), "Churn", _BOXED)
    return rounded(stats, 4, "q1", "median", "q3", "whisker_low", "whisker_high")


_RATE = "avg(CASE WHEN \"Churn\" = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100"


@query(
    "churn_by_contract",
    f"""
SELECT "Contract", round({_RATE}, 6) AS churn_rate_pct, count(*) AS n FROM accounts GROUP BY 1""",
)
def churn_by_contract(spark, sf_dir):
    return rounded(segments.churn_by(accounts(spark, sf_dir), "Contract"), 6, "churn_rate_pct")


@query(
    "top_churn_contract",
    f"""
SELECT "Contract", round({_RATE}, 6) AS churn_rate_pct, count(*) AS n FROM accounts GROUP BY 1
ORDER BY {_RATE} DESC, 1 LIMIT 1""",
)
def top_churn_contract(spark, sf_dir):
    rates = segments.churn_by(accounts(spark, sf_dir), "Contract")
    return rounded(segments.first_by(rates, "churn_rate_pct", "Contract"), 6, "churn_rate_pct")


@query(
    "segment_profile",
    """
SELECT customer_segment, count(*) AS size, round(avg(tenure), 6) AS avg_tenure,
  round(avg("MonthlyCharges"), 6) AS avg_monthly, round(avg(complaints_count), 6) AS avg_complaints,
  round(avg(engagement_score), 6) AS avg_engagement, round(avg("Churn_Numeric") * 100, 6) AS churn_rate_pct
FROM scored GROUP BY 1""",
)
def segment_profile(spark, sf_dir):
    found = segments.segment_profile(scored_accounts(spark, sf_dir))
    return rounded(
        found, 6, "avg_tenure", "avg_monthly", "avg_complaints", "avg_engagement", "churn_rate_pct"
    )


@query(
    "segment_clv",
    """
SELECT customer_segment, count(*) AS n, round(avg("CLV"), 4) AS avg_clv, round(avg(churn_prob), 6) AS avg_prob,
  round(sum(CASE WHEN churn_prob > 0.5 THEN "CLV" END), 2) AS clv_at_risk FROM scored GROUP BY 1""",
)
def segment_clv(spark, sf_dir):
    found = rounded(segments.segment_value(scored_accounts(spark, sf_dir)), 4, "avg_clv")
    return rounded(rounded(found, 6, "avg_prob"), 2, "clv_at_risk")


@query(
    "tenure_group_value",
    """
SELECT tenure_group, churn_risk_tier, count(*) AS n, round(avg("CLV"), 4) AS avg_clv,
  round(avg(churn_prob), 6) AS avg_prob, round(avg("Churn_Numeric"), 6) AS churn_rate
FROM scored GROUP BY 1, 2""",
)
def tenure_group_value(spark, sf_dir):
    found = (
        scored_accounts(spark, sf_dir)
        .groupBy("tenure_group", "churn_risk_tier")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("CLV").alias("avg_clv"),
            F.avg("churn_prob").alias("avg_prob"),
            F.avg("Churn_Numeric").alias("churn_rate"),
        )
    )
    return rounded(rounded(found, 4, "avg_clv"), 6, "avg_prob", "churn_rate")


@query(
    "segment_stats_bi",
    """
SELECT customer_segment, count(*) AS n, round(avg("Churn_Numeric"), 6) AS churn_rate,
  round(avg("CLV"), 4) AS avg_clv, round(avg(churn_prob), 6) AS avg_prob,
  round(avg(churn_prob) * 100, 4) AS avg_churn_prob_pct FROM scored GROUP BY 1""",
)
def segment_stats_bi(spark, sf_dir):
    found = segments.segment_stats(scored_accounts(spark, sf_dir))
    return rounded(rounded(found, 4, "avg_clv", "avg_churn_prob_pct"), 6, "churn_rate", "avg_prob")


@query(
    "worst_segment",
    """
SELECT customer_segment, round(avg("Churn_Numeric"), 6) AS churn_rate FROM scored GROUP BY 1
ORDER BY avg("Churn_Numeric") DESC, 1 LIMIT 1""",
)
def worst_segment(spark, sf_dir):
    found = segments.segment_stats(scored_accounts(spark, sf_dir)).select("customer_segment", "churn_rate")
    return rounded(segments.first_by(found, "churn_rate", "customer_segment"), 6, "churn_rate")


_AT_RISK = 'sum(CASE WHEN churn_prob > 0.5 THEN "CLV" ELSE 0.0::DOUBLE END)'


@query(
    "revenue_at_risk",
    f"""
SELECT count(*) AS total, count(CASE WHEN churn_prob > 0.5 THEN 1 END) AS at_risk,
  round({_AT_RISK}, 2) AS clv_at_risk, round({_AT_RISK} * 0.1::DOUBLE, 2) AS recoverable,
  round(avg(CASE WHEN churn_prob < 0.15 OR churn_prob > 0.85 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6)
    AS high_confidence_pct,
  count(CASE WHEN churn_prob BETWEEN 0.4 AND 0.6 THEN 1 END) AS borderline FROM scored""",
)
def revenue_at_risk(spark, sf_dir):
    found = segments.revenue_at_risk(scored_accounts(spark, sf_dir))
    return rounded(rounded(found, 2, "clv_at_risk", "recoverable"), 6, "high_confidence_pct")


@query(
    "batch_summary",
    """
SELECT count(*) AS total, count(CASE WHEN churn_prob > 0.5 THEN 1 END) AS churners,
  round(count(CASE WHEN churn_prob > 0.5 THEN 1 END) * 100.0::DOUBLE / count(*), 1) AS churn_rate_pct,
  round(coalesce(sum(CASE WHEN churn_prob > 0.5 THEN "MonthlyCharges" * greatest(1, 72 - tenure)
    * (1.0::DOUBLE - churn_prob) END), 0.0::DOUBLE), 2) AS total_clv_at_risk FROM scored""",
)
def batch_summary(spark, sf_dir):
    found = segments.batch_summary(scored_accounts(spark, sf_dir, floor=1))
    return rounded(rounded(found, 1, "churn_rate_pct"), 2, "total_clv_at_risk")


@query(
    "segment_balance",
    """, counts AS (SELECT customer_segment, count(*) AS n FROM scored GROUP BY 1)
SELECT max(n) AS largest, min(n) AS smallest, max(n) > 3 * min(n) AS unequal FROM counts""",
)
def segment_balance(spark, sf_dir):
    return segments.segment_balance(scored_accounts(spark, sf_dir))


@query(
    "clv_vs_prob_grid",
    """
SELECT customer_segment, CAST(floor(churn_prob / 0.05::DOUBLE) AS INTEGER) AS prob_bin,
  CAST(floor("CLV" / 500.0::DOUBLE) AS INTEGER) AS clv_bin, count(*) AS n,
  sum(CAST(round("MonthlyCharges" * 100) AS BIGINT))::DOUBLE / (count(*)::DOUBLE * 100.0::DOUBLE) AS avg_monthly
FROM scored GROUP BY 1, 2, 3""",
)
def clv_vs_prob_grid(spark, sf_dir):
    return segments.value_grid(scored_accounts(spark, sf_dir))


@query(
    "eda_metrics",
    f""", rates AS (
  SELECT "Contract", {_RATE} AS rate FROM accounts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
times AS (
  SELECT tenure AS t, count(*) AS removed, sum(CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END) AS d
  FROM accounts GROUP BY 1),
km AS (SELECT t, d, sum(removed) OVER (ORDER BY t DESC) AS n FROM times),
facts AS (
  SELECT count(*) AS rows, {_RATE} AS churn_rate_pct,
    quantile_cont(CASE WHEN "Churn" = 'Yes' THEN CAST(number_of_logins AS DOUBLE) END, 0.5) AS logins_yes,
    quantile_cont(CASE WHEN "Churn" = 'No' THEN CAST(number_of_logins AS DOUBLE) END, 0.5) AS logins_no,
    quantile_cont(CASE WHEN "Churn" = 'Yes' THEN CAST(complaints_count AS DOUBLE) END, 0.5) AS complaints_yes,
    quantile_cont(CASE WHEN "Churn" = 'No' THEN CAST(complaints_count AS DOUBLE) END, 0.5) AS complaints_no,
    quantile_cont(CASE WHEN "Churn" = 'Yes' THEN engagement_score END, 0.5) AS engagement_yes,
    quantile_cont(CASE WHEN "Churn" = 'No' THEN engagement_score END, 0.5) AS engagement_no
  FROM accounts)
SELECT 'rows' AS metric, CAST(rows AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS label FROM facts
UNION ALL SELECT 'churn_rate_pct', round(churn_rate_pct, 4), NULL FROM facts
UNION ALL SELECT 'number_of_logins_Yes', round(logins_yes, 4), NULL FROM facts
UNION ALL SELECT 'number_of_logins_No', round(logins_no, 4), NULL FROM facts
UNION ALL SELECT 'complaints_count_Yes', round(complaints_yes, 4), NULL FROM facts
UNION ALL SELECT 'complaints_count_No', round(complaints_no, 4), NULL FROM facts
UNION ALL SELECT 'engagement_score_Yes', round(engagement_yes, 4), NULL FROM facts
UNION ALL SELECT 'engagement_score_No', round(engagement_no, 4), NULL FROM facts
UNION ALL SELECT 'top_contract_churn_pct', round(rate, 4), "Contract" FROM rates
UNION ALL SELECT 'survival_12m_pct', round(100 * exp(sum(ln(1 - CAST(d AS DOUBLE) / n))), 4), NULL
  FROM km WHERE t <= 12""",
)
def eda_metrics(spark, sf_dir):
    from holdfast.plans.reports import eda_metrics as metrics

    return rounded(metrics(accounts(spark, sf_dir)), 4, "value")


@query(
    "bi_metrics",
    f""", seg AS (
  SELECT customer_segment, avg("Churn_Numeric") * 100 AS rate, avg("CLV") AS clv FROM scored GROUP BY 1),
facts AS (
  SELECT count(CASE WHEN churn_prob > 0.5 THEN 1 END) AS at_risk, {_AT_RISK} AS clv_at_risk,
    avg(CASE WHEN churn_prob < 0.15 OR churn_prob > 0.85 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS sure,
    count(CASE WHEN churn_prob BETWEEN 0.4 AND 0.6 THEN 1 END) AS borderline,
    count(CASE WHEN churn_prob > 0.4 AND customer_segment = 'At-risk Premium' THEN 1 END) AS review
  FROM scored)
SELECT 'C' AS section, 'at_risk' AS metric, CAST(NULL AS VARCHAR) AS label, CAST(at_risk AS DOUBLE) AS value FROM facts
UNION ALL SELECT 'C', 'clv_at_risk', NULL, round(clv_at_risk, 2) FROM facts
UNION ALL SELECT 'C', 'recoverable', NULL, round(clv_at_risk * 0.1::DOUBLE, 2) FROM facts
UNION ALL SELECT 'F', 'high_confidence_pct', NULL, round(sure, 2) FROM facts
UNION ALL SELECT 'F', 'borderline', NULL, CAST(borderline AS DOUBLE) FROM facts
UNION ALL SELECT 'F', 'human_review', NULL, CAST(review AS DOUBLE) FROM facts
UNION ALL (SELECT 'A', 'worst_segment_churn_pct', customer_segment, round(rate, 2) FROM seg
  ORDER BY rate DESC, customer_segment LIMIT 1)
UNION ALL SELECT 'B', 'churn_rate_pct', customer_segment, round(rate, 2) FROM seg
UNION ALL SELECT 'B', 'avg_clv', customer_segment, round(clv, 2) FROM seg""",
)
def bi_metrics(spark, sf_dir):
    from holdfast.plans.reports import bi_metrics as metrics

    return rounded(metrics(scored_accounts(spark, sf_dir)), 2, "value")


@query(
    "playbook",
    ", plays(position, customer_segment, drivers, action, urgency) AS (VALUES "
    + ", ".join(
        "(" + ", ".join([str(p[0]), *["'" + t.replace("'", "''") + "'" for t in p[1:]]]) + ")"
        for p in S.PLAYBOOK
    )
    + """)
SELECT position, customer_segment, round(avg("Churn_Numeric") * 100, 6) AS churn_rate_pct,
  round(avg("CLV"), 4) AS avg_clv, drivers, action, urgency
FROM scored JOIN plays USING (customer_segment) GROUP BY ALL""",
)
def playbook(spark, sf_dir):
    found = segments.playbook(scored_accounts(spark, sf_dir))
    return rounded(rounded(found, 4, "avg_clv"), 6, "churn_rate_pct")


@query(
    "review_queue",
    """
SELECT account_id, churn_prob, "CLV", customer_segment FROM scored
WHERE churn_prob > 0.4 AND customer_segment = 'At-risk Premium'""",
)
def review_queue(spark, sf_dir):
    queue = segments.review_queue(scored_accounts(spark, sf_dir))
    return queue.select(S.KEY, "churn_prob", "CLV", "customer_segment")


@query(
    "vip_list",
    """
SELECT account_id, customer_segment, tenure, "MonthlyCharges", churn_prob, "CLV" FROM scored
WHERE churn_prob > 0.5 AND "CLV" > (SELECT quantile_cont("CLV", 0.5) FROM scored)
ORDER BY "CLV" DESC, account_id LIMIT 200""",
)
def vip_list(spark, sf_dir):
    vips = segments.vip_list(scored_accounts(spark, sf_dir))
    return vips.select(
        S.KEY, "customer_segment", "tenure", "MonthlyCharges", "churn_prob", "CLV"
    )


@query(
    "vip_saved_revenue",
    """, vips AS (
  SELECT "MonthlyCharges" FROM scored
  WHERE churn_prob > 0.5 AND "CLV" > (SELECT quantile_cont("CLV", 0.5) FROM scored)
  ORDER BY "CLV" DESC, account_id LIMIT 200)
SELECT count(*) AS vips, round(sum("MonthlyCharges") * 12, 2) AS saved_revenue FROM vips""",
)
def vip_saved_revenue(spark, sf_dir):
    found = segments.saved_revenue(segments.vip_list(scored_accounts(spark, sf_dir)))
    return rounded(found, 2, "saved_revenue")


@query(
    "top_risk",
    """
SELECT account_id, churn_prob, churn_risk_tier, customer_segment FROM scored
ORDER BY churn_prob DESC, account_id LIMIT 20""",
)
def top_risk(spark, sf_dir):
    top = segments.top_rows(scored_accounts(spark, sf_dir), "churn_prob", S.KEY, 20)
    return top.select(S.KEY, "churn_prob", "churn_risk_tier", "customer_segment")


@query(
    "tier_recommendation",
    """
SELECT account_id, churn_prob, churn_risk_tier, churn_prob > 0.5 AS churn, CASE churn_risk_tier
  """
    + " ".join(f"WHEN '{t}' THEN '{r}'" for t, r in S.RECOMMENDATIONS.items())
    + """ END AS recommendation FROM scored""",
)
def tier_recommendation(spark, sf_dir):
    return scored_accounts(spark, sf_dir).select(
        S.KEY,
        "churn_prob",
        "churn_risk_tier",
        (F.col("churn_prob") > 0.5).alias("churn"),
        B.recommendation(F.col("churn_risk_tier")).alias("recommendation"),
    )
