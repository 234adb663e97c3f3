"""Metrics, curves and threshold queries over scorecard probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.catalog.aggregates import rounded
from holdfast.catalog.registry import query
from holdfast.operators import evaluation
from holdfast.plans.scored import scored_accounts


def _scored(spark, sf_dir):
    df = scored_accounts(spark, sf_dir)
    return df.select("churn_prob", F.col("Churn_Numeric").alias("label"))


_CELLS = """, cells AS (
  SELECT y AS label, p AS prediction, (SELECT count(*) FROM scored
    WHERE "Churn_Numeric" = y AND CASE WHEN churn_prob > 0.5 THEN 1 ELSE 0 END = p) AS n
  FROM (VALUES (0), (1)) a(y) CROSS JOIN (VALUES (0), (1)) b(p))"""


@query("confusion", _CELLS + "SELECT label, prediction, n FROM cells")
def confusion(spark, sf_dir):
    return evaluation.confusion(_scored(spark, sf_dir))


_AUC = """, by_score AS (
  SELECT churn_prob AS s, CAST(sum("Churn_Numeric") AS BIGINT) AS pos,
    CAST(count(*) - sum("Churn_Numeric") AS BIGINT) AS neg FROM scored GROUP BY 1),
below AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS lower_neg FROM by_score),
auc AS (
  SELECT sum(pos * (lower_neg + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS roc_auc FROM below)"""


def _ratio(a, b):
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE {a} / CAST({b} AS DOUBLE) END"


@query(
    "metrics",
    _AUC
    + f""", c AS (
  SELECT sum(CASE WHEN y = 1 AND p THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN y = 1 AND NOT p THEN 1 ELSE 0 END) AS fn, count(*) AS n,
    sum(CASE WHEN y = 0 AND NOT p THEN 1 ELSE 0 END) AS tn
  FROM (SELECT "Churn_Numeric" AS y, churn_prob > 0.5 AS p FROM scored)),
r AS (SELECT {_ratio('(tp + tn)', 'n')} AS acc, {_ratio('tp', '(tp + fp)')} AS pr, {_ratio('tp', '(tp + fn)')} AS re FROM c)
SELECT round(acc, 8) AS accuracy, round(pr, 8) AS precision, round(re, 8) AS recall,
  round({_ratio('2 * pr * re', '(pr + re)')}, 8) AS f1, round(roc_auc, 8) AS roc_auc FROM r CROSS JOIN auc""",
)
def metrics(spark, sf_dir):
    found = evaluation.metrics(_scored(spark, sf_dir))
    return rounded(found, 8, "accuracy", "precision", "recall", "f1", "roc_auc")


@query(
    "classification_report",
    _CELLS
    + f""", k AS (
  SELECT v AS class, sum(CASE WHEN label = v AND prediction = v THEN n ELSE 0 END) AS hit,
    sum(CASE WHEN prediction = v THEN n ELSE 0 END) AS said, sum(CASE WHEN label = v THEN n ELSE 0 END) AS support
  FROM cells CROSS JOIN (VALUES (0), (1)) t(v) GROUP BY v),
pr AS (SELECT class, {_ratio('hit', 'said')} AS p, {_ratio('hit', 'support')} AS r, support FROM k),
rows AS (
  SELECT CAST(class AS VARCHAR) AS class, p, r, {_ratio('2 * p * r', '(p + r)')} AS f, CAST(support AS BIGINT) AS support
  FROM pr)
SELECT class, round(p, 8) AS precision, round(r, 8) AS recall, round(f, 8) AS f1, support FROM rows
UNION ALL SELECT 'macro avg', round(avg(p), 8), round(avg(r), 8), round(avg(f), 8), CAST(sum(support) AS BIGINT) FROM rows
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 8), round(sum(r * support) / sum(support), 8),
  round(sum(f * support) / sum(support), 8), CAST(sum(support) AS BIGINT) FROM rows""",
)
def classification_report(spark, sf_dir):
    report = evaluation.classification_report(evaluation.confusion(_scored(spark, sf_dir)))
    return rounded(report, 8, "precision", "recall", "f1")


_CUM = """, by_score AS (
  SELECT churn_prob AS s, sum("Churn_Numeric") AS pos, count(*) - sum("Churn_Numeric") AS neg FROM scored GROUP BY 1),
cum AS (SELECT s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM by_score
  WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
totals AS (SELECT sum(pos) AS p, sum(neg) AS n FROM by_score)"""


@query(
    "roc_points",
    _CUM
    + """
SELECT s AS threshold, round(fp / CAST(n AS DOUBLE), 8) AS fpr, round(tp / CAST(p AS DOUBLE), 8) AS tpr
FROM cum CROSS JOIN totals UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE""",
)
def roc_points(spark, sf_dir):
    return rounded(evaluation.roc_points(_scored(spark, sf_dir)), 8, "fpr", "tpr")


@query(
    "pr_points",
    _CUM
    + """
SELECT s AS threshold, round(tp / CAST(tp + fp AS DOUBLE), 8) AS precision, round(tp / CAST(p AS DOUBLE), 8) AS recall
FROM cum CROSS JOIN totals UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE""",
)
def pr_points(spark, sf_dir):
    return rounded(evaluation.pr_points(_scored(spark, sf_dir)), 8, "precision", "recall")


@query(
    "threshold_sweep",
    f""", trials AS (
  SELECT CAST(i AS INTEGER) AS idx, CAST(0.1 AS DOUBLE) + CAST(0.05 AS DOUBLE) * i AS t FROM range(16) r(i)),
c AS (
  SELECT idx, t, sum(CASE WHEN churn_prob >= t AND "Churn_Numeric" = 1 THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN churn_prob >= t THEN 1 ELSE 0 END) AS said, sum("Churn_Numeric") AS p
  FROM scored CROSS JOIN trials GROUP BY 1, 2),
r AS (SELECT idx, t, {_ratio('tp', 'said')} AS pr, {_ratio('tp', 'p')} AS re FROM c),
f AS (SELECT *, {_ratio('2 * pr * re', '(pr + re)')} AS f1 FROM r)
SELECT idx, t AS threshold, round(pr, 8) AS precision, round(re, 8) AS recall, round(f1, 8) AS f1,
  row_number() OVER (ORDER BY f1 DESC, idx) = 1 AS best FROM f""",
)
def threshold_sweep(spark, sf_dir):
    return rounded(evaluation.threshold_sweep(_scored(spark, sf_dir)), 8, "precision", "recall", "f1")
