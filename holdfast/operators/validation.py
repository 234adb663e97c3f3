"""Row contract: domains, ranges and cross-field rules as one array of error codes per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import schema as S


def rules() -> list[tuple[str, Column]]:
    """(code, condition that makes the row bad) in record order."""
    found: list[tuple[str, Column]] = []
    for name, allowed in S.DOMAINS.items():
        column = F.col(name)
        found.append((f"{name}:domain", column.isNull() | ~column.isin(*allowed)))
    for name, (low, high) in S.RANGES.items():
        column = F.col(name)
        found.append((f"{name}:range", column.isNull() | ~column.between(low, high)))
    found.append(
        (
            "MultipleLines:needs_phone",
            (F.col("PhoneService") == "No") & (F.col("MultipleLines") != "No phone service"),
        )
    )
    other = F.lit(False)
    for name in S.INTERNET_SERVICES:
        other = other | (F.col(name) != "No internet service")
    found.append(("InternetService:needs_internet", (F.col("InternetService") == "No") & other))
    return found


def with_errors(df: DataFrame) -> DataFrame:
    """Add ``errors``: codes of the rules the row breaks, empty for a good row."""
    codes = [F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules()]
    return df.withColumn("errors", F.array_compact(F.array(*codes)))


def split_valid(df: DataFrame, mode: str = "keep_good") -> tuple[DataFrame, DataFrame]:
    """(rows to score, quarantined rows).

    ``keep_good`` sets only the bad rows aside; ``reject_all`` scores nothing once one row is bad.
    """
    checked = with_errors(df)
    bad = checked.where(F.size("errors") > 0)
    good = checked.where(F.size("errors") == 0).drop("errors")
    if mode == "reject_all":
        n_bad = bad.agg(F.count(F.lit(1))).scalar()
        return good.where(n_bad == 0), bad
    if mode != "keep_good":
        raise ValueError(f"unknown mode {mode!r}")
    return good, bad


def error_histogram(df: DataFrame) -> DataFrame:
    """Rows per error code."""
    return (
        with_errors(df)
        .select(F.explode("errors").alias("error"))
        .groupBy("error")
        .agg(F.count(F.lit(1)).alias("n"))
    )
