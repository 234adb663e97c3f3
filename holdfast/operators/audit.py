"""Audit log of predictions: rows, append, queries and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import schema as S
from holdfast.functions.hashing import prediction_id, record_digest
from holdfast.session import folder_exists


def audit_rows(scored: DataFrame, at: Column, inputs: list[str], key: str = S.KEY) -> DataFrame:
    """Scored records to log rows, those without key or time among them."""
    rows = scored.withColumns({"timestamp": at, "input_json": F.to_json(F.struct(*inputs))})
    return rows.select(
        prediction_id(F.col(key), F.col("timestamp"), F.col("input_json")).alias("prediction_id"),
        "timestamp",
        "input_json",
        F.col("churn_prediction").alias("churn_result"),
        "probability",
        "risk_tier",
        "clv_estimate",
    )


BATCH = "batch_id"


RECORD = "record"
#: The month of records without a time.
UNTIMED = "none"


#: Rows of one month that a task writes at most, about, when a stream appends.
PIECE_ROWS = 2_000_000


def _recorded(rows: DataFrame) -> DataFrame:
    month = F.coalesce(F.date_format("timestamp", "yyyy-MM"), F.lit(UNTIMED))
    return rows.withColumns({"month": month, RECORD: record_digest(F.col("prediction_id"), F.col("input_json"))})


def _write(rows: DataFrame, path: str, batch: str) -> None:
    rows.write.mode("overwrite").partitionBy("month").parquet(f"{path}/{BATCH}={batch}")


def append_rows(rows: DataFrame, path: str, batch: str) -> None:
    """Append log rows once per record (id and input), whatever the time of the record; none is left out.

    Batch jobs and streams write the same layout: a folder per batch, months below it. A batch that runs again
    replaces its own folder, so a retry changes nothing; records that another batch holds for the same month are
    left out, and the month in the join keeps the look-up to the months at hand. Rows are rebalanced by month, so
    that a task writes few files and a large month is split.
    """
    rows = _recorded(rows).dropDuplicates(["month", RECORD])
    spark = rows.sparkSession
    if folder_exists(spark, path):
        known = spark.read.schema(f"{RECORD} string, {BATCH} string, month string").parquet(path)
        known = known.where(F.col(BATCH) != batch).select("month", RECORD)
        rows = rows.join(known, ["month", RECORD], "left_anti")
    _write(rows.hint("rebalance", "month"), path, batch)


def pieces(n: int) -> int:
    """In how many pieces the months of a batch of ``n`` rows are written."""
    return 1 + n // PIECE_ROWS


def append_new(rows: DataFrame, path: str, batch: str, pieces: int) -> None:
    """``append_rows`` for a stream, which knows from its own state which records are new: nothing is read.

    A stream runs without adaptive execution, which would leave out a rebalance: each task would write a file for
    each month. Rows go once to the piece of their month, where a record is kept once and the files are written.
    """
    rows = _recorded(rows).withColumn("_piece", F.pmod(F.xxhash64(RECORD), F.lit(pieces)))
    same = Window.partitionBy("month", "_piece", RECORD).orderBy("prediction_id")
    rows = rows.repartition("month", "_piece").withColumn("_copy", F.row_number().over(same))
    _write(rows.where("_copy = 1").drop("_piece", "_copy"), path, batch)


def append_audit(rows: DataFrame, path: str, batch: str) -> None:
    append_rows(rows, path, batch)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    partitions = [T.StructField(BATCH, T.StringType()), T.StructField("month", T.StringType())]
    return spark.read.schema(T.StructType([*S.AUDIT_SCHEMA.fields, *partitions])).parquet(path)


def recent(
    log: DataFrame, limit: int = 100, risk_tier: str | None = None, churn_only: bool = False
) -> DataFrame:
    """Newest rows first, with the optional filters pushed to the scan."""
    if risk_tier:
        log = log.where(F.col("risk_tier") == risk_tier)
    if churn_only:
        log = log.where(F.col("churn_result"))
    return log.orderBy(F.desc("timestamp"), F.asc("prediction_id")).limit(limit)


def parse_inputs(log: DataFrame, schema) -> DataFrame:
    """The logged input text back to a struct."""
    return log.withColumn("input", F.from_json("input_json", schema))


#: Logged probabilities have four digits, so they add up exactly as whole numbers of this unit.
UNITS = 10_000


def probability_units() -> Column:
    """Sum of the logged probabilities in ten-thousandths; no order of rows changes it."""
    return F.sum(F.round(F.col("probability") * UNITS).cast("bigint"))


def mean_probability(units: Column, n: Column) -> Column:
    """One division of whole numbers."""
    return F.try_divide(units.cast("double"), n.cast("double") * float(UNITS))


def audit_stats(log: DataFrame) -> DataFrame:
    """Predictions and mean probability, overall and per tier, from one aggregate per tier."""
    tiers = log.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("n"), probability_units().alias("_p"))
    # One row per tier.
    return tiers.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_predictions"),
        # rounded half up to the unit, in whole numbers
        F.coalesce(F.expr("(2 * sum(_p) + sum(n)) div (2 * sum(n))") / float(UNITS), F.lit(0.0)).alias(
            "average_probability"
        ),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("risk_tier", "n"))),
                lambda t: F.concat_ws("=", t["risk_tier"], t["n"].cast("string")),
            ),
            ";",
        ).alias("tier_breakdown"),
    )


def history_kpis(log: DataFrame, risk_tier: str | None = None) -> DataFrame:
    if risk_tier:
        log = log.where(F.col("risk_tier") == risk_tier)
    n = F.count(F.lit(1))
    return log.agg(
        n.alias("total"),
        mean_probability(probability_units(), n).alias("avg_prob"),
        F.count(F.when(F.col("risk_tier").isin("High", "Critical"), 1)).alias("high_or_critical"),
    )


def probability_trend(log: DataFrame, unit: str = "month") -> DataFrame:
    """Mean probability per calendar unit of the log time."""
    n, units = F.count(F.lit(1)), probability_units()
    return log.groupBy(F.date_trunc(unit, "timestamp").alias("period")).agg(
        n.alias("n"), units.alias("prob_units"), mean_probability(units, n).alias("avg_prob")
    )
