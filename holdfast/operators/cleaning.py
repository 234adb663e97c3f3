"""Coercion, missing cells, duplicates, label checks, defaults and dynamic filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import schema as S
from holdfast.functions import business as B


def to_number(column: str | Column) -> Column:
    """Text that is no number becomes null instead of an error; so does NaN."""
    column = F.col(column) if isinstance(column, str) else column
    return _known(F.trim(column.cast("string")).try_cast("double"))


def _known(number: Column) -> Column:
    return F.when(~F.isnan(number), number)


_NUMBERS = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")


def number_of(df: DataFrame, name: str) -> Column:
    """The column as a number: a plain cast for numeric types, a tolerant parse for text."""
    if dict(df.dtypes)[name].split("(")[0] in _NUMBERS:
        return _known(F.col(name).cast("double"))
    return to_number(name)


def to_day(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.trim(column.cast("string")).try_cast("date")


def coerce(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """TotalCharges to number, signup_date to date, and whole days since signup up to ``as_of``."""
    if "TotalCharges" in df.columns:
        df = df.withColumn("TotalCharges", number_of(df, "TotalCharges"))
    if "signup_date" in df.columns:
        as_of = F.current_date() if as_of is None else as_of
        df = df.withColumn("signup_date", to_day("signup_date"))
        df = df.withColumn("days_since_signup", F.datediff(as_of, F.col("signup_date")))
    return df


def _missing(df: DataFrame) -> Column:
    """Cells of a row that ``na.drop`` takes for missing: nulls, and NaN in floating columns."""
    floating = {c for c, kind in df.dtypes if kind in ("double", "float")}
    cells = [(F.col(c).isNull() | F.isnan(c)) if c in floating else F.col(c).isNull() for c in df.columns]
    return reduce(lambda a, b: a + b, [cell.cast("int") for cell in cells])


def missing_cells(df: DataFrame) -> DataFrame:
    """Missing cells over all rows, in one pass."""
    per_row = _missing(df)
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias("missing_cells"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row. Copies collapse map-side, so a hot row ships one count."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))


def clean(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Coerce, drop every row with a null, then drop full-row duplicates."""
    return coerce(df, as_of).na.drop("any").dropDuplicates()


def cleaning_report(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Missing cells before and after, duplicates and rows kept, from one shuffle.

    Rows are first collapsed to distinct rows with their copies, so nulls and duplicates are read
    off the same aggregate.
    """
    typed = coerce(df, as_of)
    nulls = _missing(typed)
    copies = typed.groupBy(*typed.columns).agg(F.count(F.lit(1)).alias("_copies"))
    whole = F.col("_nulls") == 0
    return copies.withColumn("_nulls", nulls).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum(F.col("_nulls") * F.col("_copies")), F.lit(0)).alias("missing_before"),
        F.coalesce(F.sum(F.when(whole, F.col("_nulls")).otherwise(0)), F.lit(0)).alias("missing_after"),
        F.coalesce(F.sum(F.when(whole, F.col("_copies") - 1).otherwise(0)), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(whole, 1).otherwise(0)), F.lit(0)).alias("rows_kept"),
    )


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Dataset is missing required columns: {', '.join(missing)}")
    return df


def label_report(df: DataFrame, column: str = "Churn") -> DataFrame:
    """Trimmed label, its rows, and whether it is allowed."""
    label = F.trim(F.col(column).cast("string"))
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(label.alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("allowed", F.col("label").isin(*S.YES_NO))
    )


def validate_labels(df: DataFrame, column: str = "Churn") -> DataFrame:
    """Raise unless every trimmed label is Yes or No."""
    require_columns(df, [column])
    odd = label_report(df, column).where(~F.col("allowed")).limit(1).collect()
    if odd:
        raise ValueError(f"{column} column must contain only 'Yes' and 'No'")
    return df


def encode_labels(df: DataFrame, column: str = "Churn") -> DataFrame:
    """Both encodings: strict (unknown is null) and lenient (unknown is 0)."""
    return df.withColumns(
        {
            "label": B.churn_label(F.col(column)),
            "Churn_Numeric": B.churn_flag(F.col(column)),
        }
    )


def senior_flag(column: str = "SeniorCitizen") -> Column:
    """Yes or any spelling of the number 1 to 1, everything else to 0, whatever the column's type."""
    text = F.trim(F.col(column).cast("string"))
    return F.when((text == "Yes") | (text.try_cast("double") == 1), 1).otherwise(0)


def fill_defaults(df: DataFrame, fill_nulls: bool = False) -> DataFrame:
    """Add absent behavioural columns with their default; null cells stay unless asked for.

    ``fill_nulls`` is for JSON requests, where a null is a field left out.
    """
    for name, value in S.BEHAVIOUR_DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
        elif fill_nulls:
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return df


def fill_charges(df: DataFrame) -> DataFrame:
    """tenure and MonthlyCharges to 0 where unusable, TotalCharges to their product.

    A tenure that came as a whole-number column stays one; from text or decimals its fraction is kept.
    """
    total, tenure = number_of(df, "TotalCharges"), F.coalesce(number_of(df, "tenure"), F.lit(0.0))
    whole = isinstance(df.schema["tenure"].dataType, T.IntegralType)
    df = df.withColumns(
        {
            "tenure": tenure.cast("int") if whole else tenure,
            "MonthlyCharges": F.coalesce(number_of(df, "MonthlyCharges"), F.lit(0.0)),
        }
    )
    product = F.col("MonthlyCharges") * F.col("tenure")
    return df.withColumn("TotalCharges", F.coalesce(total, product))


def filter_rows(
    df: DataFrame,
    equals: Mapping[str, object] | None = None,
    among: Mapping[str, Iterable[object]] | None = None,
    between: Mapping[str, tuple[object, object]] | None = None,
    above: Mapping[str, object] | None = None,
    below: Mapping[str, object] | None = None,
) -> DataFrame:
    """Only the given predicates are added, each as its own filter.

    Filters on columns of a stored table reach its scan; filters on computed columns cannot.
    """
    for name, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(name) == value)
    for name, values in (among or {}).items():
        df = df.where(F.col(name).isin(*values))
    for name, (low, high) in (between or {}).items():
        df = df.where(F.col(name).between(low, high))
    for name, value in (above or {}).items():
        df = df.where(F.col(name) > value)
    for name, value in (below or {}).items():
        df = df.where(F.col(name) < value)
    return df
