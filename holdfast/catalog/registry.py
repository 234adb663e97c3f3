"""Query registry and the SQL views the oracles share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from holdfast import schema as S
from holdfast.operators.scorecard import DEFAULT_CARD
from holdfast.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` may start from the views of ``VIEWS`` by name."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # event times carry no zone
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = f"{VIEWS}\n{oracle.strip()}"
        return fn

    return register


def number(value: float) -> str:
    """A double literal; plain decimals would be DECIMAL in the oracle."""
    return f"CAST({value!r} AS DOUBLE)"


def uniform(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('-', CAST({key} AS VARCHAR), '{salt}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _service(name: str, condition: str) -> str:
    return (
        f"CASE WHEN coalesce(m.market, '') = 'HOUSEHOLD' THEN 'No internet service' "
        f"WHEN {condition} THEN 'Yes' ELSE 'No' END AS \"{name}\""
    )


_SERVICES = ",\n    ".join(
    [
        _service("OnlineSecurity", "o.o_orderkey % 3 = 0"),
        _service("OnlineBackup", "o.o_orderkey % 4 < 2"),
        _service("DeviceProtection", "o.o_orderkey % 5 < 2"),
        _service("TechSupport", "o.o_orderkey % 7 < 3"),
        _service("StreamingTV", "o.o_orderkey % 2 = 0"),
        _service("StreamingMovies", "o.o_orderkey % 11 < 5"),
    ]
)

TERM_SQL = {
    "tenure": "tenure",
    "MonthlyCharges": '"MonthlyCharges"',
    "engagement_score": "engagement_score",
    "complaints_count": "complaints_count",
    "customer_support_calls": "customer_support_calls",
    "late_payments": "late_payments",
    "HasMultiServices": '"HasMultiServices"',
    "IsSeniorWithPartner": '"IsSeniorWithPartner"',
    "Contract_Month-to-month": "CASE WHEN \"Contract\" = 'Month-to-month' THEN 1 ELSE 0 END",
    "Contract_Two year": "CASE WHEN \"Contract\" = 'Two year' THEN 1 ELSE 0 END",
    "InternetService_Fiber optic": "CASE WHEN \"InternetService\" = 'Fiber optic' THEN 1 ELSE 0 END",
}

MARGIN_SQL = " + ".join(
    [number(DEFAULT_CARD.intercept)]
    + [f"{number(w)} * ({TERM_SQL[n]})" for n, w in DEFAULT_CARD.weights.items()]
)


def raw_probability_sql(margin: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({margin}))))"


def probability_sql(margin: str) -> str:
    return f"round({raw_probability_sql(margin)}, 6)"


def tier_sql(prob: str) -> str:
    return (
        f"CASE WHEN {prob} > 0.75 THEN 'Critical' WHEN {prob} > 0.5 THEN 'High' "
        f"WHEN {prob} > 0.25 THEN 'Medium' ELSE 'Low' END"
    )


def tenure_group_sql(column: str = "tenure") -> str:
    return (
        f"CASE WHEN {column} <= 12 THEN 'New' WHEN {column} <= 24 THEN 'Regular' "
        f"WHEN {column} <= 48 THEN 'Loyal' ELSE 'Veteran' END"
    )


MULTI_SQL = " + ".join(f"CASE WHEN \"{s}\" = 'Yes' THEN 1 ELSE 0 END" for s in S.MULTI_SERVICES)

VIEWS = f"""
WITH day AS (SELECT max(CAST(o_orderdate AS DATE)) AS as_of FROM orders),
activity AS (
  SELECT l_orderkey, sum(l_quantity) AS usage, CAST(count(*) AS INTEGER) AS lines,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS returned,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS INTEGER) AS accepted,
    CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS INTEGER) AS open_lines
  FROM lineitem GROUP BY l_orderkey),
market AS (SELECT c_custkey, c_mktsegment AS market FROM customer),
order_base AS (
  SELECT o.*, CAST(o.o_orderdate AS DATE) AS signup,
    CAST(least(72, (day.as_of - CAST(o.o_orderdate AS DATE)) // 30) AS INTEGER) AS months,
    floor(1800 + 10200 * (o.o_totalprice / 500000.0::DOUBLE)) / 100.0::DOUBLE AS monthly
  FROM orders o CROSS JOIN day),
accounts AS (
  SELECT o.o_orderkey AS account_id,
    CASE WHEN o.o_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CASE WHEN o.o_custkey % 5 = 0 THEN 1 ELSE 0 END AS "SeniorCitizen",
    CASE WHEN o.o_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS "Partner",
    CASE WHEN o.o_custkey % 4 = 0 THEN 'Yes' ELSE 'No' END AS "Dependents",
    CASE WHEN o.o_orderkey % 10 = 0 THEN 'No' ELSE 'Yes' END AS "PhoneService",
    CASE WHEN o.o_orderkey % 10 = 0 THEN 'No phone service' WHEN o.o_orderkey % 2 = 0 THEN 'Yes'
      ELSE 'No' END AS "MultipleLines",
    CASE WHEN m.market IN ('AUTOMOBILE', 'BUILDING') THEN 'Fiber optic'
      WHEN m.market = 'HOUSEHOLD' THEN 'No' ELSE 'DSL' END AS "InternetService",
    {_SERVICES},
    CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Month-to-month'
      WHEN o.o_orderpriority = '5-LOW' THEN 'Two year' ELSE 'One year' END AS "Contract",
    CASE WHEN o.o_custkey % 7 < 4 THEN 'Yes' ELSE 'No' END AS "PaperlessBilling",
    CASE o.o_orderkey % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'
      WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS "PaymentMethod",
    o.months AS tenure, o.monthly AS "MonthlyCharges",
    CASE WHEN a.l_orderkey IS NOT NULL THEN o.monthly * o.months END AS "TotalCharges",
    CAST(o.o_orderkey % 20 AS INTEGER) AS last_active_days,
    coalesce(a.usage, 0.0::DOUBLE) AS avg_monthly_usage,
    coalesce(a.lines, 0) AS number_of_logins,
    coalesce(a.returned, 0) AS complaints_count,
    coalesce(a.accepted, 0) AS customer_support_calls,
    coalesce(a.open_lines, 0) AS late_payments,
    greatest(0.0::DOUBLE, least(100.0::DOUBLE, coalesce(a.usage, 0.0::DOUBLE) / 5
      + 2 * coalesce(a.lines, 0) - o.o_orderkey % 20)) AS engagement_score,
    o.signup AS signup_date,
    CASE WHEN o.o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS "Churn"
  FROM order_base o
  LEFT JOIN activity a ON a.l_orderkey = o.o_orderkey
  LEFT JOIN market m ON m.c_custkey = o.o_custkey),
featured AS (
  SELECT * REPLACE (coalesce("TotalCharges", "MonthlyCharges" * tenure) AS "TotalCharges"),
    coalesce("TotalCharges", "MonthlyCharges" * tenure) / greatest(tenure, 1) AS charges_per_month,
    {tenure_group_sql()} AS tenure_group,
    {MULTI_SQL} AS "HasMultiServices",
    CASE WHEN "SeniorCitizen" = 1 AND "Partner" = 'Yes' THEN 1 ELSE 0 END AS "IsSeniorWithPartner"
  FROM accounts),
probable AS (
  SELECT *, {probability_sql(MARGIN_SQL)} AS churn_prob, {raw_probability_sql(MARGIN_SQL)} AS raw_prob
  FROM featured),
scored AS (
  SELECT *, greatest(0, 72 - tenure) AS expected_remaining_tenure,
    "MonthlyCharges" * greatest(0, 72 - tenure) * (1.0::DOUBLE - churn_prob) AS "CLV",
    {tier_sql("churn_prob")} AS churn_risk_tier,
    CASE WHEN tenure <= 24 THEN 0 WHEN tenure > 54 THEN 3 WHEN "MonthlyCharges" > 70 THEN 1
      ELSE 2 END AS cluster,
    CASE WHEN tenure <= 24 THEN 'New & Unsettled' WHEN tenure > 54 THEN 'Veteran Champion'
      WHEN "MonthlyCharges" > 70 THEN 'At-risk Premium' ELSE 'Loyal Mid-tier' END AS customer_segment,
    CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END AS "Churn_Numeric"
  FROM probable)
"""


def extend(views: str) -> str:
    """Text that continues the shared views with further ones."""
    return f", {views.strip()}"
