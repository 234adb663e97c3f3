"""Cleaning, validation, feature and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.catalog.registry import MULTI_SQL, extend, query, tenure_group_sql, uniform
from holdfast.functions import business as B
from holdfast.operators import cleaning, features, profile, sampling, validation
from holdfast.plans.scored import scored_accounts
from holdfast.sources.accounts import accounts, as_of_date
from holdfast.sources.tables import union_all


def _raw_text(spark, sf_dir) -> DataFrame:
    """Accounts as text: charges in cents with blanks, a bad date where activity is zero."""
    return accounts(spark, sf_dir).select(
        S.KEY,
        F.coalesce(
            F.round(F.col("TotalCharges") * 100).cast("bigint").cast("string"), F.lit(" ")
        ).alias("TotalCharges"),
        F.when(F.col("last_active_days") == 0, "unknown")
        .otherwise(F.col("signup_date").cast("string"))
        .alias("signup_date"),
        F.concat(F.lit(" "), F.col("Churn")).alias("Churn"),
        "Contract",
        "tenure",
        "PaymentMethod",
    )


_RAW = """raw AS (
  SELECT account_id,
    coalesce(CAST(CAST(round("TotalCharges" * 100) AS BIGINT) AS VARCHAR), ' ') AS "TotalCharges",
    CASE WHEN last_active_days = 0 THEN 'unknown' ELSE CAST(signup_date AS VARCHAR) END AS signup_date,
    ' ' || "Churn" AS "Churn", "Contract", tenure, "PaymentMethod"
  FROM accounts),
typed AS (
  SELECT account_id, TRY_CAST(trim("TotalCharges") AS DOUBLE) AS "TotalCharges",
    TRY_CAST(trim(signup_date) AS DATE) AS signup_date,
    CAST((SELECT as_of FROM day) - TRY_CAST(trim(signup_date) AS DATE) AS INTEGER) AS days_since_signup,
    "Churn", "Contract", tenure, "PaymentMethod"
  FROM raw)"""


@query(
    "clean_coerce_fill",
    extend(_RAW)
    + """
SELECT account_id, "TotalCharges", CAST(signup_date AS VARCHAR) AS signup_date, days_since_signup,
  coalesce("TotalCharges", CAST(tenure AS DOUBLE)) AS charges_filled,
  15 AS last_active_days, 50 AS avg_monthly_usage, 5 AS number_of_logins,
  0 AS complaints_count, 0 AS customer_support_calls, 0 AS late_payments
FROM typed""",
)
def clean_coerce_fill(spark, sf_dir):
    typed = cleaning.coerce(_raw_text(spark, sf_dir), as_of_date(spark, sf_dir))
    return cleaning.fill_defaults(typed).select(
        S.KEY,
        "TotalCharges",
        F.col("signup_date").cast("string").alias("signup_date"),
        "days_since_signup",
        F.coalesce("TotalCharges", F.col("tenure").cast("double")).alias("charges_filled"),
        *S.BEHAVIOUR_DEFAULTS,
    )


@query(
    "missing_cells",
    extend(_RAW)
    + """
SELECT CAST(count(*) - count("TotalCharges") + count(*) - count(signup_date)
  + count(*) - count(days_since_signup) AS BIGINT) AS missing_cells FROM typed""",
)
def missing_cells(spark, sf_dir):
    typed = cleaning.coerce(_raw_text(spark, sf_dir), as_of_date(spark, sf_dir))
    return cleaning.missing_cells(typed)


@query(
    "dropna_dedup",
    extend(_RAW)
    + """
SELECT DISTINCT CAST(signup_date AS VARCHAR) AS signup_date, days_since_signup, "Churn", "Contract",
  tenure, "PaymentMethod" FROM typed
WHERE signup_date IS NOT NULL""",
)
def dropna_dedup(spark, sf_dir):
    raw = _raw_text(spark, sf_dir).drop(S.KEY, "TotalCharges")
    kept = cleaning.clean(raw, as_of_date(spark, sf_dir))
    return kept.withColumn("signup_date", F.col("signup_date").cast("string"))


@query(
    "cleaning_report",
    extend(_RAW)
    + """, copies AS (
  SELECT "TotalCharges", signup_date, days_since_signup, "Churn", "Contract", tenure, "PaymentMethod",
    count(*) AS n,
    CASE WHEN "TotalCharges" IS NULL THEN 1 ELSE 0 END + CASE WHEN signup_date IS NULL THEN 2 ELSE 0 END AS nulls
  FROM typed GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows_in, CAST(sum(n * nulls) AS BIGINT) AS missing_before,
  CAST(0 AS BIGINT) AS missing_after,
  CAST(sum(CASE WHEN nulls = 0 THEN n - 1 ELSE 0 END) AS BIGINT) AS duplicate_rows,
  CAST(sum(CASE WHEN nulls = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows_kept FROM copies""",
)
def cleaning_report(spark, sf_dir):
    return cleaning.cleaning_report(_raw_text(spark, sf_dir).drop(S.KEY), as_of_date(spark, sf_dir))


@query(
    "label_domain",
    extend(_RAW)
    + """
SELECT trim("Churn") AS label, count(*) AS n, trim("Churn") IN ('Yes', 'No') AS allowed
FROM raw GROUP BY 1""",
)
def label_domain(spark, sf_dir):
    return cleaning.label_report(_raw_text(spark, sf_dir))


_REQUESTS = """requests AS (
  SELECT * REPLACE (
    tenure + number_of_logins AS tenure,
    "MonthlyCharges" * 1.1::DOUBLE AS "MonthlyCharges",
    CASE WHEN complaints_count > 1 THEN 'Yes' ELSE "MultipleLines" END AS "MultipleLines",
    CASE WHEN late_payments > 3 THEN 'Yes' ELSE "TechSupport" END AS "TechSupport",
    CASE WHEN last_active_days = 0 THEN 'Three year' ELSE "Contract" END AS "Contract")
  FROM accounts)"""


def _requests(spark, sf_dir) -> DataFrame:
    """Accounts as scoring requests, some of which break the row contract."""
    return accounts(spark, sf_dir).withColumns(
        {
            "tenure": F.col("tenure") + F.col("number_of_logins"),
            "MonthlyCharges": F.col("MonthlyCharges") * 1.1,
            "MultipleLines": F.when(F.col("complaints_count") > 1, "Yes").otherwise(F.col("MultipleLines")),
            "TechSupport": F.when(F.col("late_payments") > 3, "Yes").otherwise(F.col("TechSupport")),
            "Contract": F.when(F.col("last_active_days") == 0, "Three year").otherwise(F.col("Contract")),
        }
    )


def _rules_sql() -> list[tuple[str, str]]:
    found = []
    for name, allowed in S.DOMAINS.items():
        texts = ", ".join(f"'{a}'" for a in allowed)
        found.append((f"{name}:domain", f'"{name}" IS NULL OR "{name}" NOT IN ({texts})'))
    for name, (low, high) in S.RANGES.items():
        found.append((f"{name}:range", f'"{name}" IS NULL OR "{name}" < {low} OR "{name}" > {high}'))
    found.append(
        ("MultipleLines:needs_phone", "\"PhoneService\" = 'No' AND \"MultipleLines\" <> 'No phone service'")
    )
    any_other = " OR ".join(f"\"{s}\" <> 'No internet service'" for s in S.INTERNET_SERVICES)
    found.append(("InternetService:needs_internet", f"\"InternetService\" = 'No' AND ({any_other})"))
    return found


_CODES = ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in _rules_sql())


@query(
    "validate_rows",
    extend(_REQUESTS)
    + f"""
SELECT account_id, concat_ws(';', {_CODES}) AS errors FROM requests""",
)
def validate_rows(spark, sf_dir):
    checked = validation.with_errors(_requests(spark, sf_dir))
    return checked.select(S.KEY, F.array_join("errors", ";").alias("errors"))


@query(
    "validation_error_histogram",
    extend(_REQUESTS)
    + " UNION ALL ".join(
        f"SELECT '{code}' AS error, count(*) AS n FROM requests WHERE {bad} HAVING count(*) > 0"
        for code, bad in _rules_sql()
    ),
)
def validation_error_histogram(spark, sf_dir):
    return validation.error_histogram(_requests(spark, sf_dir))


@query(
    "quarantine_counts",
    extend(_REQUESTS)
    + f""", checked AS (SELECT concat_ws(';', {_CODES}) AS errors FROM requests)
SELECT CASE WHEN errors = '' THEN 'scored' ELSE 'quarantined' END AS outcome, count(*) AS n
FROM checked GROUP BY 1""",
)
def quarantine_counts(spark, sf_dir):
    good, bad = validation.split_valid(_requests(spark, sf_dir))
    good = good.agg(F.lit("scored").alias("outcome"), F.count(F.lit(1)).alias("n"))
    bad = bad.agg(F.lit("quarantined").alias("outcome"), F.count(F.lit(1)).alias("n"))
    return good.unionByName(bad).where("n > 0")


@query(
    "label_encode",
    """
SELECT account_id,
  CASE WHEN "Churn" = 'Yes' THEN 1 WHEN "Churn" = 'No' THEN 0 END AS label,
  CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END AS "Churn_Numeric",
  CASE WHEN "Partner" = 'Yes' THEN 1 ELSE 0 END AS senior_flag FROM accounts""",
)
def label_encode(spark, sf_dir):
    encoded = cleaning.encode_labels(accounts(spark, sf_dir))
    senior = cleaning.senior_flag("Partner").alias("senior_flag")
    return encoded.select(S.KEY, "label", "Churn_Numeric", senior)


@query(
    "filters_dynamic",
    """
SELECT account_id, tenure, "MonthlyCharges", "Contract", churn_prob FROM scored
WHERE "Churn" = 'Yes' AND "Contract" IN ('Month-to-month', 'One year') AND tenure BETWEEN 12 AND 48
  AND churn_prob > 0.25 AND "MonthlyCharges" < 100""",
)
def filters_dynamic(spark, sf_dir):
    kept = cleaning.filter_rows(
        scored_accounts(spark, sf_dir),
        equals={"Churn": "Yes", "gender": None},
        among={"Contract": ["Month-to-month", "One year"]},
        between={"tenure": (12, 48)},
        above={"churn_prob": 0.25},
        below={"MonthlyCharges": 100},
    )
    return kept.select(S.KEY, "tenure", "MonthlyCharges", "Contract", "churn_prob")


_NUMERIC = ("tenure", "MonthlyCharges", "TotalCharges", "number_of_logins", "engagement_score")
_TEXT = ("Contract", "InternetService", "PaymentMethod", "Churn")


def _numeric_profile_sql(name: str) -> str:
    c = f'CAST("{name}" AS DOUBLE)'
    quart = ", ".join(
        f"round(quantile_cont({c}, {p}), 4) AS {n}"
        for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    )
    return (
        f"SELECT '{name}' AS column_name, count({c}) AS n, CAST(NULL AS BIGINT) AS n_unique, "
        f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std, min({c}) AS min, {quart}, max({c}) AS max FROM accounts"
    )


def _text_profile_sql(name: str) -> str:
    empty = ", ".join(
        f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean", "std", "min", "q1", "median", "q3", "max")
    )
    return (
        f"SELECT '{name}' AS column_name, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_unique, "
        f"arg_min(v, (-k, v)) AS top, max(k) AS freq, {empty} "
        f'FROM (SELECT "{name}" AS v, count(*) AS k FROM accounts WHERE "{name}" IS NOT NULL GROUP BY 1)'
    )


@query(
    "profile_columns",
    "\nUNION ALL ".join(
        ["", *[_numeric_profile_sql(n) for n in _NUMERIC], *[_text_profile_sql(n) for n in _TEXT]]
    ).replace("\nUNION ALL ", "", 1),
)
def profile_columns(spark, sf_dir):
    return profile.profile(accounts(spark, sf_dir), numeric=_NUMERIC, text=_TEXT, digits=4)


@query(
    "features_serving",
    f"""
SELECT account_id, "TotalCharges", charges_per_month, tenure_group, engagement_score,
  "HasMultiServices", "IsSeniorWithPartner", "SeniorCitizen" FROM featured""",
)
def features_serving(spark, sf_dir):
    # Dropping the given score makes the operator derive it, which the account view defines alike.
    raw = accounts(spark, sf_dir).drop("engagement_score")
    return features.serving_features(raw).select(
        S.KEY,
        "TotalCharges",
        "charges_per_month",
        "tenure_group",
        "engagement_score",
        "HasMultiServices",
        "IsSeniorWithPartner",
        "SeniorCitizen",
    )


@query(
    "features_training",
    f"""
SELECT account_id, coalesce("TotalCharges" / (tenure + 1), 0.0::DOUBLE) AS charges_per_month,
  {tenure_group_sql()} AS tenure_group, {MULTI_SQL} AS "HasMultiServices",
  CASE WHEN "SeniorCitizen" = 1 AND "Partner" = 'Yes' THEN 1 ELSE 0 END AS "IsSeniorWithPartner",
  round("MonthlyCharges" / avg("MonthlyCharges") OVER (), 6) AS "ChargeToIncomeProxy",
  CAST(year(signup_date) AS DOUBLE) AS signup_year, CAST(month(signup_date) AS INTEGER) AS signup_month
FROM accounts""",
)
def features_training(spark, sf_dir):
    return features.training_features(accounts(spark, sf_dir)).select(
        S.KEY,
        "charges_per_month",
        "tenure_group",
        "HasMultiServices",
        "IsSeniorWithPartner",
        F.round("ChargeToIncomeProxy", 6).alias("ChargeToIncomeProxy"),
        "signup_year",
        "signup_month",
    )


@query(
    "split_stratified",
    f"""
SELECT account_id, "Churn",
  CASE WHEN row_number() OVER (PARTITION BY "Churn" ORDER BY {uniform('account_id', 'split')}, account_id)
    <= round(0.2 * count(*) OVER (PARTITION BY "Churn")) THEN 'test' ELSE 'train' END AS split
FROM accounts""",
)
def split_stratified(spark, sf_dir):
    split = sampling.stratified_split(accounts(spark, sf_dir), S.KEY, "Churn", test_size=0.2)
    return split.select(S.KEY, "Churn", "split")


@query(
    "folds",
    f"""
SELECT "Churn", CAST(floor({uniform('account_id', 'fold')} * 3) AS INTEGER) AS fold, count(*) AS n
FROM accounts GROUP BY 1, 2""",
)
def folds(spark, sf_dir):
    folded = sampling.assign_folds(accounts(spark, sf_dir), S.KEY, folds=3)
    return folded.groupBy("Churn", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "folds_stratified",
    f"""
SELECT account_id, "Churn", CAST(r > round(n * 1 / 3.0::DOUBLE) AS INTEGER) + CAST(r > round(n * 2 / 3.0::DOUBLE) AS INTEGER) AS fold
FROM (SELECT account_id, "Churn", count(*) OVER (PARTITION BY "Churn") AS n,
  row_number() OVER (PARTITION BY "Churn" ORDER BY {uniform('account_id', 'fold')}, account_id) AS r FROM accounts)""",
)
def folds_stratified(spark, sf_dir):
    """Folds with the same share of each class, as the search takes them."""
    return sampling.stratified_folds(accounts(spark, sf_dir), S.KEY, "Churn", folds=3).select(S.KEY, "Churn", "fold")


@query(
    "sample_hash",
    f"""
SELECT account_id, tenure, "MonthlyCharges", "Churn" FROM accounts
ORDER BY {uniform('account_id', 'sample')}, account_id LIMIT 500""",
)
def sample_hash(spark, sf_dir):
    drawn = sampling.hash_sample(accounts(spark, sf_dir), S.KEY, 500)
    return drawn.select(S.KEY, "tenure", "MonthlyCharges", "Churn")


@query(
    "train_test_union",
    """
SELECT "Contract", tenure_group, count(*) AS n, CAST(sum("Churn_Numeric") AS BIGINT) AS churned
FROM scored GROUP BY 1, 2""",
)
def train_test_union(spark, sf_dir):
    split = sampling.assign_split(scored_accounts(spark, sf_dir), S.KEY)
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test").drop("Churn_Numeric")
    whole = union_all(train, test)
    return whole.groupBy("Contract", "tenure_group").agg(
        F.count(F.lit(1)).alias("n"), F.sum(B.churn_flag(F.col("Churn"))).alias("churned")
    )


@query("distinct_values", """SELECT DISTINCT customer_segment, churn_risk_tier FROM scored""")
def distinct_values(spark, sf_dir):
    return scored_accounts(spark, sf_dir).select("customer_segment", "churn_risk_tier").distinct()
