"""Scoring, what-if, similar-account and audit queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.catalog.registry import (
    MULTI_SQL,
    TERM_SQL,
    number,
    query,
    raw_probability_sql,
    tier_sql,
    uniform,
)
from holdfast.functions import business as B
from holdfast.operators import audit, scoring, similar
from holdfast.operators.scorecard import DEFAULT_CARD
from holdfast.plans.scored import featured_accounts, scored_accounts
from holdfast.sources.accounts import accounts

# Unrounded, so that the rounded response never sits on a tie.
RAW_CARD = replace(DEFAULT_CARD, digits=None)


@query(
    "clv_variants",
    """
SELECT account_id, round("MonthlyCharges" * greatest(0, 72 - tenure) * (1.0::DOUBLE - raw_prob), 4) AS clv_batch,
  round("MonthlyCharges" * greatest(1, 72 - tenure) * (1.0::DOUBLE - raw_prob), 4) AS clv_service,
  greatest(0, 72 - tenure) AS months_batch, greatest(1, 72 - tenure) AS months_service FROM scored""",
)
def clv_variants(spark, sf_dir):
    df = RAW_CARD.score(featured_accounts(spark, sf_dir))
    args = (F.col("MonthlyCharges"), F.col("tenure"), F.col("churn_prob"))
    return df.select(
        S.KEY,
        F.round(B.lifetime_value(*args, floor=0), 4).alias("clv_batch"),
        F.round(B.lifetime_value(*args, floor=1), 4).alias("clv_service"),
        B.remaining_tenure(F.col("tenure"), 0).alias("months_batch"),
        B.remaining_tenure(F.col("tenure"), 1).alias("months_service"),
    )


_RESPONSE = (
    "raw_prob > 0.5 AS churn_prediction, round(raw_prob, 4) AS probability, "
    f"{tier_sql('raw_prob')} AS risk_tier, "
    'round("MonthlyCharges" * greatest(1, 72 - tenure) * (1.0::DOUBLE - raw_prob), 2) AS clv_estimate'
)


@query("score_accounts", f"SELECT account_id, {_RESPONSE} FROM scored")
def score_accounts(spark, sf_dir):
    scored = scoring.score_records(accounts(spark, sf_dir), RAW_CARD.score)
    return scored.select(S.KEY, "churn_prediction", "probability", "risk_tier", "clv_estimate")


def _what_if_sql(rebuild: bool) -> str:
    def text(value):
        return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else number(value)

    rows = ", ".join(
        f"('{name}', {text(c.get('Contract'))}, {text(c.get('MonthlyCharges'))}, {text(c.get('TechSupport'))})"
        for name, c in scoring.DEFAULT_SCENARIOS.items()
    )
    multi = f"{MULTI_SQL}" if rebuild else '"HasMultiServices"'
    # The given charges survive the change; only a missing total follows the new monthly charge.
    terms = dict(TERM_SQL)
    margin = " + ".join(
        [number(DEFAULT_CARD.intercept)]
        + [f"{number(w)} * ({terms[n]})" for n, w in DEFAULT_CARD.weights.items()]
    )
    months = f"greatest({1 if rebuild else 0}, 72 - tenure)"
    new_charge = '"MonthlyCharges"' if rebuild else "old_charge"
    return f""", cases(scenario, contract_new, charge_new, support_new) AS (VALUES {rows}),
changed AS (
  SELECT f.* REPLACE (coalesce(contract_new, "Contract") AS "Contract",
      coalesce(charge_new, "MonthlyCharges") AS "MonthlyCharges",
      coalesce(support_new, "TechSupport") AS "TechSupport"),
    scenario, raw_prob AS p0, "MonthlyCharges" AS old_charge
  FROM scored f CROSS JOIN cases),
rebuilt AS (SELECT * REPLACE ({multi} AS "HasMultiServices") FROM changed),
after AS (SELECT *, {raw_probability_sql(margin)} AS p1 FROM rebuilt),
valued AS (
  SELECT *, old_charge * {months} * (1.0::DOUBLE - p0) AS v0,
    {new_charge} * {months} * (1.0::DOUBLE - p1) AS v1 FROM after)
SELECT account_id, scenario, round(p0, 6) AS original_prob, round(p1, 6) AS new_prob,
  round(p1 - p0, 6) AS prob_change, round(v1 - v0, 4) AS clv_change,
  {tier_sql('p0')} || ' -> ' || {tier_sql('p1')} AS risk_tier_change FROM valued"""


def _flat(result):
    return result.select(
        S.KEY,
        "scenario",
        F.round("original.probability", 6).alias("original_prob"),
        F.round("simulated.probability", 6).alias("new_prob"),
        F.round("delta.probability_change", 6).alias("prob_change"),
        F.round("delta.clv_change", 4).alias("clv_change"),
        F.col("delta.risk_tier_change").alias("risk_tier_change"),
    )


@query("what_if_rebuild", _what_if_sql(True))
def what_if_rebuild(spark, sf_dir):
    raw = accounts(spark, sf_dir)
    return _flat(scoring.what_if(raw, scoring.DEFAULT_SCENARIOS, RAW_CARD.score, mode="rebuild"))


@query("what_if_frozen", _what_if_sql(False))
def what_if_frozen(spark, sf_dir):
    rows = featured_accounts(spark, sf_dir)
    return _flat(scoring.what_if(rows, scoring.DEFAULT_SCENARIOS, RAW_CARD.score, mode="frozen_features"))


@query(
    "similar_accounts",
    f""", drawn AS (
  SELECT account_id, tenure, "MonthlyCharges" AS c, "Churn_Numeric" AS y, {uniform('account_id', 'similar')} AS u
  FROM scored),
pairs AS (
  SELECT a.account_id, b.account_id AS other, b.y,
    row_number() OVER (PARTITION BY a.account_id ORDER BY b.u, b.account_id) AS pos
  FROM drawn a JOIN drawn b ON b.tenure BETWEEN a.tenure - 6 AND a.tenure + 6
    AND b.c BETWEEN a.c - 10 AND a.c + 10 AND a.account_id <> b.account_id),
best AS (
  SELECT account_id, CAST(count(*) AS INTEGER) AS n_similar, CAST(sum(y) AS INTEGER) AS n_churned,
    string_agg(CAST(other AS VARCHAR), ',' ORDER BY pos) AS similar_ids FROM pairs WHERE pos <= 5 GROUP BY 1)
SELECT d.account_id, coalesce(n_similar, 0) AS n_similar, coalesce(n_churned, 0) AS n_churned,
  CASE WHEN n_similar > 0 THEN CAST(n_churned AS DOUBLE) / n_similar END AS churned_share,
  coalesce(similar_ids, '') AS similar_ids
FROM drawn d LEFT JOIN best USING (account_id)""",
)
def similar_accounts(spark, sf_dir):
    return similar.similar_summary(similar.similar_accounts(scored_accounts(spark, sf_dir)))


_LOG = f""", stamped AS (
  SELECT *, {_RESPONSE}, CAST(signup_date AS TIMESTAMP) + to_seconds(account_id % 86400) AS ts FROM scored),
log AS (
  SELECT *, 'pred_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || substr(sha256(
    concat_ws('-', CAST(account_id AS VARCHAR), strftime(ts, '%Y%m%d_%H%M%S'))), 1, 16) AS prediction_id
  FROM stamped)"""


def logged(spark, sf_dir, records=None):
    """One logged prediction per account (``records``, if a job keeps them), at a time within its signup day."""
    scored = scoring.score_records(accounts(spark, sf_dir) if records is None else records, RAW_CARD.score)
    at = F.timestamp_seconds(
        F.unix_date("signup_date").cast("bigint") * 86400 + F.col(S.KEY) % 86400
    )
    inputs = [S.KEY, *S.DOMAINS, "tenure", "MonthlyCharges", "TotalCharges"]
    return audit.audit_rows(scored, at, inputs)


def _clock(column: str = "timestamp"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@query(
    "audit_recent",
    _LOG
    + """
SELECT prediction_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at, account_id, tenure, probability, risk_tier,
  clv_estimate, churn_prediction AS churn_result
FROM log WHERE risk_tier = 'High' AND churn_prediction ORDER BY ts DESC, prediction_id LIMIT 100""",
)
def audit_recent(spark, sf_dir):
    newest = audit.recent(logged(spark, sf_dir), limit=100, risk_tier="High", churn_only=True)
    parsed = audit.parse_inputs(newest, "account_id bigint, tenure int")
    return parsed.select(
        "prediction_id",
        _clock().alias("logged_at"),
        F.col("input.account_id").alias("account_id"),
        F.col("input.tenure").alias("tenure"),
        "probability",
        "risk_tier",
        "clv_estimate",
        "churn_result",
    )


@query(
    "audit_stats",
    _LOG
    + """, tiers AS (SELECT risk_tier, count(*) AS n FROM log GROUP BY 1)
SELECT (SELECT count(*) FROM log) AS total_predictions,
  (SELECT CAST((2 * sum(CAST(round(probability * 10000) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE)
    / 10000.0::DOUBLE FROM log) AS average_probability,
  (SELECT string_agg(risk_tier || '=' || n, ';' ORDER BY risk_tier) FROM tiers) AS tier_breakdown""",
)
def audit_stats(spark, sf_dir):
    return audit.audit_stats(logged(spark, sf_dir))


@query(
    "history_kpis",
    _LOG
    + """
SELECT count(*) AS total,
  sum(CAST(round(probability * 10000) AS BIGINT))::DOUBLE / (count(*)::DOUBLE * 10000.0::DOUBLE) AS avg_prob,
  count(CASE WHEN risk_tier IN ('High', 'Critical') THEN 1 END) AS high_or_critical FROM log""",
)
def history_kpis(spark, sf_dir):
    return audit.history_kpis(logged(spark, sf_dir))


@query(
    "probability_trend",
    _LOG
    + """
SELECT strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') AS period, count(*) AS n,
  CAST(sum(CAST(round(probability * 10000) AS BIGINT)) AS BIGINT) AS prob_units,
  sum(CAST(round(probability * 10000) AS BIGINT))::DOUBLE / (count(*)::DOUBLE * 10000.0::DOUBLE) AS avg_prob
FROM log GROUP BY 1""",
)
def probability_trend(spark, sf_dir):
    trend = audit.probability_trend(logged(spark, sf_dir), "month")
    return trend.withColumn("period", _clock("period"))
