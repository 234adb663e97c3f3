"""Streaming jobs: scoring with audit log and quarantine, key figures and user features per window.

Operators are the batch ones. Every sink writes one folder per micro-batch and overwrites it on a
retry, so a job restarted after a loss repeats its last batch without doubling rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from holdfast import schema as S
from holdfast.functions.hashing import prediction_id, record_digest
from holdfast.operators import audit, validation
from holdfast.operators.scoring import Scorer, score_records
from holdfast.session import folder_exists, list_folder

BATCH = "batch_id"


def read_files(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", glob: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """File stream with an explicit schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _start(df: DataFrame, sink, checkpoint: str, mode: str, once: bool, every: str) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def _write(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


def score_stream(
    records: DataFrame,
    scorer: Scorer,
    at: Column,
    audit_path: str,
    quarantine_path: str,
    checkpoint: str,
    key: str = S.KEY,
    once: bool = True,
    every: str = "1 minute",
) -> StreamingQuery:
    """Validate and score arriving records; good ones go to the audit log, bad ones aside.

    Every record ends up in one of the two, however late it is: there is no watermark, and records without key or
    time are set aside with a code of their own. Which records came before is keyed state of the query, a digest
    per record in the state store of ``remember``; a micro-batch reads neither log, and a retry finds the same state.
    """
    inputs = list(records.columns)
    whole = F.to_json(F.struct(*inputs))
    named = prediction_id(F.col(key), F.col("_at"), whole)
    # the text only makes the digest; where it is logged it is made again, instead of being shuffled and kept
    stamped = records.withColumn("_at", at)
    new = stamped.withColumn("_record", record_digest(named, whole)).dropDuplicates(["_record"])
    missing = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(f"{code}:missing")) for c, code in ((key, key), ("_at", "time"))])
    )

    def sink(batch: DataFrame, number: int) -> None:
        # one reading of the batch: what is put together from it twice is worked out again, with the state behind it
        checked = validation.with_errors(batch).withColumn("errors", F.concat(missing, "errors")).persist()
        pieces = audit.pieces(checked.count())
        scored = score_records(checked.where(F.size("errors") == 0).drop("errors"), scorer)
        name = f"stream-{number:012d}"
        audit.append_new(audit.audit_rows(scored, F.col("_at"), inputs, key), audit_path, name, pieces)
        aside = checked.where(F.size("errors") > 0).select(
            named.alias("prediction_id"), F.col("_at").alias("timestamp"), whole.alias("input_json"), "errors"
        )
        audit.append_new(aside, quarantine_path, name, pieces)
        checked.unpersist()

    remember(records.sparkSession)
    return _start(new, sink, checkpoint, "append", once, every)


def remember(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB: on disk, checkpointed with the query, not in the heap.

    The keys are not counted as they are put: that would look up each once more.
    """
    store = "spark.sql.streaming.stateStore"
    spark.conf.set(f"{store}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(f"{store}.rocksdb.trackTotalNumberOfRows", "false")


def time_window(column: str, size: str, slide: str | None = None, session: bool = False) -> Column:
    """Tumbling by default, sliding with ``slide``, or a session with gap ``size``."""
    if session:
        return F.session_window(column, size)
    return F.window(column, size, slide) if slide else F.window(column, size)


def kpi_windows(scored: DataFrame, at: Column, window: Column, late: str) -> DataFrame:
    """Count, mean probability and tier mix per window; the window reads the column ``at_time``."""
    timed = scored.withColumn("at_time", at).withWatermark("at_time", late)
    tiers = [
        F.count(F.when(F.col("risk_tier") == t, 1)).alias(f"n_{t.lower()}") for t in S.RISK_TIERS
    ]
    n = F.count(F.lit(1))
    sums = timed.groupBy(window.alias("w")).agg(
        n.alias("n"), audit.mean_probability(audit.probability_units(), n).alias("avg_prob"), *tiers
    )
    names = [f"n_{t.lower()}" for t in S.RISK_TIERS]
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "avg_prob", *names)


def user_features(events: DataFrame, window: Column, late: str) -> DataFrame:
    """Behaviour per user and window from the event stream; the window reads ``at_time``."""
    timed = events.withColumn("at_time", F.col("ts").cast("timestamp")).withWatermark("at_time", late)
    kind = F.col("event_type")
    sums = timed.groupBy("user_id", window.alias("w")).agg(
        F.count(F.when(kind.isin("view", "click"), 1)).alias("number_of_logins"),
        F.count(F.when(kind == "error", 1)).alias("complaints_count"),
        F.sum(F.when(kind == "purchase", F.col("value")).otherwise(0.0)).alias("usage_value"),
        F.max("at_time").alias("last_active"),
    )
    return sums.select(
        "user_id",
        F.col("w.start").alias("start"),
        "number_of_logins",
        "complaints_count",
        "usage_value",
        "last_active",
        F.datediff(F.col("w.end"), F.col("last_active")).alias("last_active_days"),
    )


SNAPSHOT, DELTA = "snapshot", "delta"


def write_updates(
    aggregated: DataFrame, path: str, checkpoint: str, keys: Sequence[str], once: bool = True, every: str = "1 minute",
    merge_after: int = 8,
) -> StreamingQuery:
    """Keep the current state of all groups: a snapshot, and the groups that each micro-batch since then changed.

    After ``merge_after`` micro-batches their rows and the snapshot become the next snapshot, so that ``latest``
    reads a bounded number of folders. Each is a folder of its own, complete once Spark has put its mark there, and
    a retried micro-batch writes the same folders again; older ones are left to whoever clears the store.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _write(batch, f"{path}/{DELTA}", number)
        if (number + 1) % merge_after == 0:
            state = _state(spark, path, aggregated.schema, keys, number)
            state.write.mode("overwrite").parquet(f"{path}/{SNAPSHOT}/{BATCH}={number}")

    return _start(aggregated, sink, checkpoint, "update", once, every)


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches below a folder that were written to the end."""
    found = list_folder(spark, folder)
    numbers = [int(name.split("=")[1]) for name in found if name.startswith(f"{BATCH}=")]
    return sorted(n for n in numbers if folder_exists(spark, f"{folder}/{BATCH}={n}/_SUCCESS"))


def _state(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], before: int | None = None) -> DataFrame:
    """Newest row of every group from the last snapshot (one before ``before``) and the micro-batches after it."""
    snapshots = [n for n in _complete(spark, f"{path}/{SNAPSHOT}") if before is None or n < before]
    last = snapshots[-1] if snapshots else -1
    deltas = [n for n in _complete(spark, f"{path}/{DELTA}") if n > last and (before is None or n <= before)]
    rows = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())]))
    parts = [(last, f"{path}/{SNAPSHOT}")] if snapshots else []
    for n, folder in [*parts, *[(n, f"{path}/{DELTA}") for n in deltas]]:
        one = spark.read.schema(schema).parquet(f"{folder}/{BATCH}={n}")
        rows = rows.unionByName(one.withColumn(BATCH, F.lit(n).cast("long")))
    newest = Window.partitionBy(*keys).orderBy(F.desc(BATCH))
    return rows.withColumn("_at", F.row_number().over(newest)).where("_at = 1").drop("_at", BATCH)


def latest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The newest row of every group: one snapshot and the few micro-batches since."""
    return _state(spark, path, schema, keys)


def closed_windows(aggregated: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append windows once the watermark has passed them."""
    return (
        aggregated.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
