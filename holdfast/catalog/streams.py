"""Streaming queries: each runs to the end of its input and returns the written table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.catalog.aggregates import rounded
from holdfast.catalog.business import _LOG, RAW_CARD, logged
from holdfast.catalog.registry import query
from holdfast.operators import audit
from holdfast.operators.scoring import score_records
from holdfast.session import shared_folder
from holdfast.sources.accounts import accounts
from holdfast.sources.tables import table
from holdfast.streaming import jobs


def _account_stream(spark, sf_dir, folder=None):
    schema = table(spark, sf_dir, "orders").schema
    orders = jobs.read_files(spark, sf_dir, schema, glob="orders.parquet")
    if folder:
        orders = jobs.read_files(spark, f"{folder}/*", schema)
    return accounts(spark, sf_dir, orders=orders)


def _at():
    return F.timestamp_seconds(F.unix_date("signup_date").cast("bigint") * 86400 + F.col(S.KEY) % 86400)


def _clock(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@query(
    "stream_score_batch",
    _LOG
    + """, given AS (SELECT account_id, "TotalCharges" IS NULL AS missing FROM accounts)
SELECT prediction_id, CASE WHEN missing THEN 'quarantined' ELSE 'scored' END AS outcome,
  CASE WHEN NOT missing THEN probability END AS probability, CASE WHEN NOT missing THEN risk_tier END AS risk_tier,
  CASE WHEN NOT missing THEN clv_estimate END AS clv_estimate,
  CASE WHEN missing THEN 'TotalCharges:range' ELSE '' END AS errors
FROM log JOIN given USING (account_id)""",
)
def stream_score_batch(spark, sf_dir):
    log, aside = shared_folder(spark, "audit"), shared_folder(spark, "quarantine")
    progress = shared_folder(spark, "progress")
    # the newer half arrives first, then the older half, then part of the newer half once more
    orders, arrived = table(spark, sf_dir, "orders"), shared_folder(spark, "arrivals")
    middle = F.lit(orders.agg(F.percentile_approx(F.unix_date(F.to_date("o_orderdate")), 0.5)).first()[0])
    day = F.unix_date(F.to_date("o_orderdate"))
    parts = (orders.where(day >= middle), orders.where(day < middle), orders.where((day >= middle) & (F.col("o_orderkey") % 3 == 0)))
    for number, part in enumerate(parts):
        part.write.parquet(f"{arrived}/{number}")
        stream = _account_stream(spark, sf_dir, arrived)
        jobs.score_stream(stream, RAW_CARD.score, _at(), log, aside, progress).awaitTermination()
    scored = audit.read_audit(spark, log).select(
        "prediction_id", F.lit("scored").alias("outcome"), "probability", "risk_tier", "clv_estimate",
        F.lit("").alias("errors"),
    )
    bad = spark.read.schema("prediction_id string, errors array<string>").parquet(aside).select(
        "prediction_id",
        F.lit("quarantined").alias("outcome"),
        F.lit(None).cast("double").alias("probability"),
        F.lit(None).cast("string").alias("risk_tier"),
        F.lit(None).cast("double").alias("clv_estimate"),
        F.array_join("errors", ";").alias("errors"),
    )
    return scored.unionByName(bad)


def _updates(spark, aggregated, keys):
    path, progress = shared_folder(spark, "windows"), shared_folder(spark, "progress")
    jobs.write_updates(aggregated, path, progress, keys).awaitTermination()
    return jobs.latest(spark, path, aggregated.schema, keys)


def _window_sql(ts: str, seconds: int) -> str:
    return f"TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch({ts}) / {seconds}) AS BIGINT) * {seconds})"


@query(
    "stream_kpi_windows",
    _LOG
    + f"""
SELECT strftime({_window_sql('ts', 30 * 86400)}, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n,
  sum(CAST(round(probability * 10000) AS BIGINT))::DOUBLE / (count(*)::DOUBLE * 10000.0::DOUBLE) AS avg_prob, """
    + ", ".join(f"count(CASE WHEN risk_tier = '{t}' THEN 1 END) AS n_{t.lower()}" for t in S.RISK_TIERS)
    + " FROM log GROUP BY 1",
)
def stream_kpi_windows(spark, sf_dir):
    scored = score_records(_account_stream(spark, sf_dir), RAW_CARD.score)
    sums = jobs.kpi_windows(scored, _at(), jobs.time_window("at_time", "30 days"), late="365 days")
    rows = _updates(spark, sums, ["start"])
    return rows.withColumn("start", _clock("start")).drop("end")


@query(
    "stream_user_features",
    f""", timed AS (SELECT *, {_window_sql('ts', 7 * 86400)} AS start FROM events)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start,
  count(CASE WHEN event_type IN ('view', 'click') THEN 1 END) AS number_of_logins,
  count(CASE WHEN event_type = 'error' THEN 1 END) AS complaints_count,
  round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0::DOUBLE END), 4) AS usage_value,
  strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS last_active,
  CAST(CAST(start + to_seconds({7 * 86400}) AS DATE) - CAST(max(ts) AS DATE) AS INTEGER) AS last_active_days
FROM timed GROUP BY user_id, start""",
)
def stream_user_features(spark, sf_dir):
    events = jobs.read_files(spark, sf_dir, S.EVENT_SCHEMA, glob="events.parquet")
    sums = jobs.user_features(events, jobs.time_window("at_time", "7 days"), late="2 days")
    rows = _updates(spark, sums, ["user_id", "start"])
    clock = {"start": _clock("start"), "last_active": _clock("last_active")}
    return rounded(rows.withColumns(clock), 4, "usage_value")


@query(
    "audit_written_log",
    _LOG
    + f"""
SELECT risk_tier, count(*) AS n, CAST(sum(CAST(round(probability * 10000) AS BIGINT)) AS BIGINT) AS prob_units,
  count(CASE WHEN churn_prediction THEN 1 END) AS churners FROM log GROUP BY 1""",
)
def audit_written_log(spark, sf_dir):
    """A batch job and its retry, then a second batch that holds everything again: one row per id."""
    path = shared_folder(spark, "audit")
    # the three runs share the joins behind the records: short columns, not the texts of the log
    records = accounts(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    rows = logged(spark, sf_dir, records)
    first = F.xxhash64("prediction_id") % 2 == 0
    for batch, part in (("a", rows.where(first)), ("a", rows.where(first)), ("b", rows)):
        audit.append_audit(part, path, batch)
    records.unpersist()
    log = audit.read_audit(spark, path)
    churners = F.count(F.when(F.col("churn_result"), 1)).alias("churners")
    return log.groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("n"), audit.probability_units().alias("prob_units"), churners
    )
