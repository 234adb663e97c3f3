"""Readers, sinks and input checks: each query writes its input from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import schema as S
from holdfast.catalog.registry import query
from holdfast.operators import cleaning, features, validation
from holdfast.plans.scored import featured_accounts, scored_accounts
from holdfast.session import shared_folder
from holdfast.sources import tables
from holdfast.sources.accounts import accounts

_MONEY = (
    'CAST(round("MonthlyCharges" * 100) AS BIGINT) AS monthly_cents, '
    'CAST(round("TotalCharges" * 100) AS BIGINT) AS total_cents'
)


def _cents(name: str, alias: str):
    return F.round(F.col(name) * 100).cast("bigint").alias(alias)


@query(
    "csv_accounts",
    f"""
SELECT account_id, "Contract", tenure, {_MONEY}, strftime(signup_date, '%Y-%m-%d') AS signup FROM accounts""",
)
def csv_accounts(spark, sf_dir):
    """Accounts through a CSV file with header; money and dates come back as text and are coerced."""
    path = shared_folder(spark, "csv")
    tables.write_table(accounts(spark, sf_dir), path, "csv")
    rows = cleaning.coerce(tables.read_accounts_csv(spark, path))
    return rows.select(
        S.KEY,
        "Contract",
        "tenure",
        _cents("MonthlyCharges", "monthly_cents"),
        _cents("TotalCharges", "total_cents"),
        F.date_format("signup_date", "yyyy-MM-dd").alias("signup"),
    )


@query(
    "json_batches",
    f"""
SELECT account_id // 64 AS request, CAST(row_number() OVER (PARTITION BY account_id // 64 ORDER BY account_id) - 1
  AS INTEGER) AS index, account_id, tenure, {_MONEY} FROM accounts""",
)
def json_batches(spark, sf_dir):
    """Request texts of at most 64 customers, one JSON record per line, to one row per customer."""
    raw = accounts(spark, sf_dir)
    request = F.floor(F.col(S.KEY) / 64).alias("request")
    customers = F.array_sort(F.collect_list(F.struct(*raw.columns))).alias("customers")
    texts = raw.groupBy(request).agg(customers).select("request", F.to_json(F.struct("customers")).alias("body"))
    path = shared_folder(spark, "json")
    tables.write_table(texts, path, "json")
    lines = spark.read.schema("request bigint, body string").json(path)
    rows = tables.explode_batch(lines, "body")
    money = [_cents("MonthlyCharges", "monthly_cents"), _cents("TotalCharges", "total_cents")]
    return rows.select("request", "index", S.KEY, "tenure", *money)


@query(
    "sink_formats",
    """, formats(format) AS (VALUES ('parquet'), ('orc'), ('csv'), ('json'))
SELECT format, "Contract", count(*) AS n, CAST(sum(CAST(round("MonthlyCharges" * 100) AS BIGINT)) AS BIGINT) AS cents
FROM accounts CROSS JOIN formats GROUP BY 1, 2""",
)
def sink_formats(spark, sf_dir):
    """The same table through every sink, partitioned by contract."""
    raw = accounts(spark, sf_dir).select(S.KEY, "Contract", "MonthlyCharges")
    schema = T.StructType([f for f in raw.schema if f.name != "Contract"] + [raw.schema["Contract"]])
    out = None
    for kind in ("parquet", "orc", "csv", "json"):
        path = shared_folder(spark, kind)
        tables.write_table(raw, path, kind, partition_by=["Contract"])
        rows = spark.read.schema(schema).option("header", True).format(kind).load(path)
        rows = rows.groupBy(F.lit(kind).alias("format"), "Contract").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("MonthlyCharges") * 100).cast("bigint")).alias("cents")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "reject_all",
    """, given AS (SELECT count(*) AS n, count("TotalCharges") AS good FROM accounts)
SELECT 'dirty' AS input, 'scored' AS outcome, CASE WHEN n = good THEN n ELSE 0 END AS n FROM given
UNION ALL SELECT 'dirty', 'quarantined', n - good FROM given
UNION ALL SELECT 'clean', 'scored', good FROM given UNION ALL SELECT 'clean', 'quarantined', 0 FROM given""",
)
def reject_all(spark, sf_dir):
    """One bad record rejects the whole request; a request without one is scored."""
    raw = accounts(spark, sf_dir)
    out = None
    for name, rows in (("dirty", raw), ("clean", raw.where("TotalCharges is not null"))):
        good, bad = validation.split_valid(rows, mode="reject_all")
        for outcome, part in (("scored", good), ("quarantined", bad)):
            one = part.agg(
                F.lit(name).alias("input"), F.lit(outcome).alias("outcome"), F.count(F.lit(1)).alias("n")
            )
            out = one if out is None else out.unionByName(one)
    return out


@query(
    "required_columns",
    """
SELECT 'Contract' AS dropped, 'Dataset is missing required columns: Contract' AS message, count(*) AS n FROM accounts
UNION ALL SELECT '', '', count(*) FROM accounts""",
)
def required_columns(spark, sf_dir):
    """The table contract: a missing column is named, a whole table passes."""
    raw = accounts(spark, sf_dir)
    out = None
    for dropped in ("Contract", ""):
        rows, message = raw.drop(dropped), ""
        try:
            cleaning.require_columns(rows, S.account_schema().fieldNames())
        except ValueError as error:
            message = str(error)
        one = rows.agg(
            F.lit(dropped).alias("dropped"), F.lit(message).alias("message"), F.count(F.lit(1)).alias("n")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "model_input_rows",
    'SELECT account_id, CAST(28 AS INTEGER) AS width, "Contract", "MultipleLines", tenure FROM featured',
)
def model_input_rows(spark, sf_dir):
    """The projection to the 28 model inputs."""
    rows = features.model_inputs(featured_accounts(spark, sf_dir), S.KEY)
    width = F.lit(len(rows.columns) - 1).alias("width")
    return rows.select(S.KEY, width, "Contract", "MultipleLines", "tenure")


@query(
    "formatted_segments",
    """, sums AS (SELECT customer_segment, count(*) AS n, sum("Churn_Numeric") AS lost,
  CAST(sum(CAST(round("MonthlyCharges" * 100) AS BIGINT)) AS BIGINT) AS cents FROM scored GROUP BY 1)
SELECT customer_segment || ': ' || format('{:,}', n) || ' customers, ' ||
  CAST((lost * 1000 + n // 2) // n // 10 AS VARCHAR) || '.' || CAST((lost * 1000 + n // 2) // n % 10 AS VARCHAR) ||
  '% churn, $' || format('{:,}', cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ' monthly' AS line
FROM sums""",
)
def formatted_segments(spark, sf_dir):
    """Report lines with grouped thousands, per cent and money, from whole-number sums."""
    sums = scored_accounts(spark, sf_dir).groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("Churn_Numeric").alias("lost"),
        F.sum(F.round(F.col("MonthlyCharges") * 100).cast("bigint")).alias("cents"),
    )
    share = F.expr("cast((lost * 1000 + n div 2) div n as decimal(20, 0)) / 10").cast("decimal(20, 1)")
    return sums.select(
        F.concat(
            "customer_segment",
            F.lit(": "),
            F.format_number("n", 0),
            F.lit(" customers, "),
            share.cast("string"),
            F.lit("% churn, $"),
            F.format_number(F.expr("cast(cents as decimal(20, 0)) / 100"), 2),
            F.lit(" monthly"),
        ).alias("line")
    )


@query(
    "input_spellings",
    """, texts AS (SELECT account_id, tenure, "SeniorCitizen" AS s, "MonthlyCharges" AS m FROM accounts),
given AS (SELECT account_id, s,
    CAST(CASE account_id % 5 WHEN 4 THEN 0 WHEN 2 THEN 10 * tenure + 5 ELSE 10 * tenure END AS BIGINT) AS tenths,
    CASE WHEN account_id % 7 = 0 THEN 0 ELSE CAST(round(m * 100) AS BIGINT) END AS cents FROM texts)
SELECT account_id, tenths AS tenure_tenths, s AS senior_text, s AS senior_number, cents AS monthly_cents,
  tenths * cents AS total_mills, CASE WHEN account_id % 3 = 0 THEN NULL ELSE 4 END AS complaints FROM given""",
)
def input_spellings(spark, sf_dir):
    """Numbers as text with decimals, blanks or nonsense, NaN, and nulls that are no absent columns."""
    key = F.col(S.KEY)
    raw = accounts(spark, sf_dir).select(S.KEY, "tenure", "SeniorCitizen", "MonthlyCharges")
    text = F.col("tenure").cast("string")
    odd = raw.select(
        S.KEY,
        F.when(key % 5 == 0, F.concat(text, F.lit(".0")))
        .when(key % 5 == 1, F.concat(F.lit("  "), text, F.lit(" ")))
        .when(key % 5 == 2, F.concat(text, F.lit(".5")))
        .when(key % 5 == 4, F.lit("unknown"))
        .otherwise(text)
        .alias("tenure"),
        F.when(F.col("SeniorCitizen") == 1, F.when(key % 2 == 0, "Yes").otherwise(" 1 ")).otherwise("No").alias("as_text"),
        F.col("SeniorCitizen").cast("double").alias("as_number"),
        F.when(key % 7 == 0, F.lit(float("nan"))).otherwise(F.col("MonthlyCharges")).alias("MonthlyCharges"),
        F.lit(None).cast("double").alias("TotalCharges"),
        F.when(key % 3 != 0, 4).alias("complaints_count"),
    )
    rows = cleaning.fill_charges(cleaning.fill_defaults(odd))
    return rows.select(
        S.KEY,
        F.round(F.col("tenure") * 10).cast("bigint").alias("tenure_tenths"),
        cleaning.senior_flag("as_text").alias("senior_text"),
        cleaning.senior_flag("as_number").alias("senior_number"),
        _cents("MonthlyCharges", "monthly_cents"),
        F.round(F.col("TotalCharges") * 1000).cast("bigint").alias("total_mills"),
        F.col("complaints_count").alias("complaints"),
    )
