import datetime

import pytest
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.functions import business as B
from holdfast.operators import cleaning, features, validation
from holdfast.sources import tables
from holdfast.sources.accounts import accounts


def test_dirty_csv_is_cleaned(spark, tmp_path):
    names = S.account_schema().fieldNames()
    good = dict.fromkeys(names, "1") | {
        "TotalCharges": "100.5", "signup_date": "2024-01-02", "Churn": "Yes", "gender": "Male"
    }
    rows = [
        good,
        good,
        good | {"account_id": "2", "TotalCharges": "abc"},
        good | {"account_id": "3", "signup_date": "soon"},
        good | {"account_id": "4", "tenure": ""},
    ]
    path = tmp_path / "raw.csv"
    lines = [",".join(names)] + [",".join(r[n] for n in names) for r in rows]
    path.write_text("\n".join(lines))
    raw = tables.read_accounts_csv(spark, str(path)).drop(tables.CORRUPT)
    as_of = F.lit(datetime.date(2024, 1, 12))
    report = cleaning.cleaning_report(raw, as_of).first()
    # The unreadable date also leaves days_since_signup empty.
    assert tuple(report) == (5, 4, 0, 1, 1)
    assert cleaning.missing_cells(cleaning.coerce(raw, as_of)).first()[0] == 4
    assert cleaning.duplicate_rows(raw).first()[0] == 1
    kept = cleaning.clean(raw, as_of).collect()
    assert [(r.account_id, r.TotalCharges, r.days_since_signup) for r in kept] == [(1, 100.5, 10)]


def test_labels(spark):
    ok = spark.createDataFrame([(" Yes",), ("No ",), (None,)], "Churn string")
    cleaning.validate_labels(ok)
    encoded = [tuple(r)[1:] for r in cleaning.encode_labels(ok).collect()]
    assert encoded == [(1, 0), (0, 0), (None, 0)]
    with pytest.raises(ValueError, match="Yes"):
        cleaning.validate_labels(spark.createDataFrame([("Maybe",)], "Churn string"))
    with pytest.raises(ValueError, match="a, b"):
        cleaning.require_columns(ok, ["b", "a"])


def test_defaults_fill_absent_columns_and_on_request_nulls(spark):
    df = spark.createDataFrame([(None,), (7,)], "number_of_logins int")
    rows = cleaning.fill_defaults(df, fill_nulls=True).collect()
    assert [r.number_of_logins for r in rows] == [5, 7]
    assert {r.last_active_days for r in rows} == {15}
    kept = cleaning.fill_defaults(df).collect()
    assert [r.number_of_logins for r in kept] == [None, 7]


def test_numbers_in_any_spelling(spark):
    texts = spark.createDataFrame([("12.0", "1.0"), (" 7 ", "Yes"), ("12.5", "No"), ("x", "0"), (None, None)], "tenure string, SeniorCitizen string")
    texts = texts.withColumn("MonthlyCharges", F.lit("NaN")).withColumn("TotalCharges", F.lit(float("nan")))
    rows = cleaning.fill_charges(texts).withColumn("senior", cleaning.senior_flag()).collect()
    assert [r.tenure for r in rows] == [12, 7, 12.5, 0, 0]
    assert [r.senior for r in rows] == [1, 1, 0, 0, 0]
    assert {(r.MonthlyCharges, r.TotalCharges) for r in rows} == {(0.0, 0.0)}
    typed = spark.createDataFrame([(1.0,), (0.0,), (None,)], "SeniorCitizen double")
    assert [r[0] for r in typed.select(cleaning.senior_flag()).collect()] == [1, 0, 0]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, None), (2.0, "b")], "x double, y string")
    assert cleaning.missing_cells(df).first()[0] == 2
    report = cleaning.cleaning_report(df).first()
    assert (report.rows_in, report.missing_before, report.rows_kept) == (3, 2, 1)
    assert cleaning.clean(df).count() == 1


@pytest.mark.parametrize(
    ("tenure", "serving", "training"),
    [(-2, "New", None), (0, "New", "New"), (12, "New", "New"), (13, "Regular", "Regular"), (24, "Regular", "Regular"),
     (25, "Loyal", "Loyal"), (48, "Loyal", "Loyal"), (49, "Veteran", "Veteran"), (72, "Veteran", "Veteran"),
     (73, "Veteran", None), (None, "New", None)],
)
def test_tenure_bands(spark, tenure, serving, training):
    df = spark.createDataFrame([(tenure,)], "t int")
    row = df.select(B.tenure_group(F.col("t")), B.tenure_group(F.col("t"), 72, None)).first()
    assert tuple(row) == (serving, training)


def test_risk_tier_edges(spark):
    probs = [(0.25,), (0.2500001,), (0.5,), (0.51,), (0.75,), (0.76,), (None,)]
    df = spark.createDataFrame(probs, "p double").select(B.risk_tier(F.col("p")).alias("t"))
    assert [r.t for r in df.collect()] == ["Low", "Medium", "Medium", "High", "High", "Critical", None]


def test_engagement_is_derived_only_when_wholly_missing(spark, sf_dir):
    raw = accounts(spark, sf_dir)
    empty = raw.withColumn("engagement_score", F.lit(None).cast("double"))
    derived = features.serving_features(empty).agg(F.sum("engagement_score")).first()[0]
    given = raw.agg(F.sum("engagement_score")).first()[0]
    assert derived == pytest.approx(given)
    partly = raw.withColumn("engagement_score", F.when(F.col("tenure") > 10, 3.0))
    kept = features.serving_features(partly).where("tenure <= 10").select("engagement_score").distinct().collect()
    assert [r[0] for r in kept] == [None]


def test_training_features_take_a_fitted_mean_and_median_year(spark):
    df = spark.createDataFrame(
        [("2020-05-01", 10.0, 100.0, 4, 0, "Yes"), ("bad", 30.0, None, 80, 1, "Yes"), ("2022-01-01", 20.0, 5.0, 0, 1, "No")],
        "signup_date string, MonthlyCharges double, TotalCharges double, tenure int, SeniorCitizen int, Partner string",
    )
    rows = features.training_features(df, charge_mean=40.0).collect()
    assert [r.signup_year for r in rows] == [2020.0, 2021.0, 2022.0]
    assert [r.signup_month for r in rows] == [5, 0, 1]
    assert [r.charges_per_month for r in rows] == [20.0, 0.0, 5.0]
    assert [r.ChargeToIncomeProxy for r in rows] == [0.25, 0.75, 0.5]
    assert [r.IsSeniorWithPartner for r in rows] == [0, 1, 0]
    assert [r.tenure_group for r in rows] == ["New", None, "New"]
    assert [r.HasMultiServices for r in rows] == [0, 0, 0]


def _record(**changes):
    record = {name: allowed[0] for name, allowed in S.DOMAINS.items()}
    record |= {"MultipleLines": "No", "SeniorCitizen": 0, "tenure": 5, "MonthlyCharges": 50.0, "TotalCharges": 250.0}
    return record | changes


@pytest.mark.parametrize(
    ("changes", "errors"),
    [
        ({}, []),
        ({"tenure": 0, "MonthlyCharges": 18.0, "TotalCharges": 0.0}, []),
        ({"tenure": 72, "MonthlyCharges": 120.0, "TotalCharges": 10000.0}, []),
        ({"tenure": 73}, ["tenure:range"]),
        ({"MonthlyCharges": 17.99}, ["MonthlyCharges:range"]),
        ({"TotalCharges": None}, ["TotalCharges:range"]),
        ({"SeniorCitizen": 2}, ["SeniorCitizen:range"]),
        ({"Contract": "Weekly"}, ["Contract:domain"]),
        ({"gender": None}, ["gender:domain"]),
        ({"PhoneService": "No"}, ["MultipleLines:needs_phone"]),
        ({"PhoneService": "No", "MultipleLines": "No phone service"}, []),
        ({"InternetService": "No"}, ["InternetService:needs_internet"]),
        ({"InternetService": "No", **dict.fromkeys(S.INTERNET_SERVICES, "No internet service")}, []),
    ],
)
def test_row_rules(spark, changes, errors):
    types = {"SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double", "TotalCharges": "double"}
    record = _record(**changes)
    ddl = ", ".join(f"{n} {types.get(n, 'string')}" for n in record)
    df = spark.createDataFrame([tuple(record.values())], ddl)
    assert validation.with_errors(df).first().errors == errors
    good, bad = validation.split_valid(df, mode="reject_all")
    assert good.count() == (0 if errors else 1)
    assert bad.count() == (1 if errors else 0)


def test_json_records_and_batches(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"account_id": 7, "tenure": 3}\n')
    assert tables.read_accounts_json(spark, str(tmp_path / "one.json")).first().tenure == 3
    text = '{"customers": [{"account_id": 1, "tenure": 4}, {"account_id": 2}]}'
    rows = tables.explode_batch(spark.createDataFrame([(9, text)], "batch int, body string"), "body").collect()
    assert [(r.batch, r["index"], r.account_id, r.tenure) for r in rows] == [(9, 0, 1, 4), (9, 1, 2, None)]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_sinks(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / fmt)
    tables.write_table(df, path, fmt)
    tables.write_table(df, path, fmt)
    reader = spark.read.schema("k int, v string").format(fmt)
    back = (reader.option("header", True) if fmt == "csv" else reader).load(path)
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]


def test_union_by_name_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2,)], "k int")
    assert sorted(map(tuple, tables.union_all(a, b).collect())) == [(1, "x"), (2, None)]
