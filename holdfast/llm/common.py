"""Helpers the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.session import shared_folder, ship_package

#: Word separators of the text contracts: blank, tab, line feed, vertical tab, form feed, return.
SPACE = " \t\n\x0b\x0c\r"

TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: the installed package, else ``TOKENIZERS``."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


#: Rows that go to a Python worker at once: whole texts, so a small number bounds both sides' memory.
ARROW_ROWS = "1000"


#: Whether files of a query's shuffles go when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors and set the size of Arrow batches; the queries run later."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write the rows to the shared folder and go on from there; every later reader sees the same rows.

    What the write shuffled is not needed again and is dropped with its end, not with the next run of the cleaner.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def written_place(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the place of each row in the order in which it was written.

    For rows of a Parquet table that is the number of the part file, then the number of the row in it; Spark
    names part files by the partition that wrote them. Other rows are in the order of their partitions.
    """
    try:
        file = df.metadataColumn("_metadata")
        kept = df.withColumn(name, file)
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id())
    at = F.col(name)
    part = F.regexp_extract(at["file_name"], r"^part-(\d+)", 1)
    nth = F.regexp_extract(at["file_name"], r"-c(\d+)\.", 1)  # a partition may write several files
    numbers = [F.when(x == "", 0).otherwise(x.cast("long")) for x in (part, nth)]
    return kept.withColumn(name, numbers[0] * (1 << 44) + numbers[1] * (1 << 32) + at["row_index"])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc32_of(column) -> F.Column:
    """crc32 of a column's decimal text; null for null."""
    return F.crc32(column.cast("string").cast("binary"))


def held_out(column, modulus: int, remainder: int) -> F.Column:
    """Whether a row belongs to the held-out fold; rows without an id are never learned from."""
    return F.coalesce(crc32_of(column) % modulus == remainder, F.lit(True))


def release() -> None:
    """Give freed memory back to the system; a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another allocator
        return


def tidy(kernel: Callable) -> Callable:
    """The kernel of a ``mapInArrow``; once it has ended, its memory is released."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        release()

    return run


def tidy_group(kernel: Callable) -> Callable:
    """The same for a group of ``applyInArrow``."""

    def run(table: pa.Table) -> pa.Table:
        out = kernel(table)
        release()
        return out

    return run


def small_batches(
    batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about ``most_bytes`` of text, so that memory follows the slice."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(False)
        ends = np.cumsum(lengths.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def drawn(df: DataFrame, lot: str, most: int) -> DataFrame:
    """The ``most`` rows of least ``lot``, a hash that tells rows apart; only lots are compared, not whole rows."""
    cut = df.select(lot).orderBy(lot).limit(most).agg(F.max(lot)).first()[0]
    return df.where(F.col(lot) <= F.lit(cut).cast(df.schema[lot].dataType))


def running_total(df: DataFrame, order: list[str], value: str, name: str, rows_per_part: int = 20_000) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each one, in the order of the given columns.

    The first column cuts the rows into parts at quantiles of it; sums of parts give each part its start,
    and windows run inside parts, so no task sees all rows. ``df`` must come from a written table.
    """
    df = df.withColumn("_part", range_part(df, order[0], df.count() // rows_per_part + 1))
    sums = df.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return df.join(starts, "_part").withColumn(name, total.cast("long")).drop("_part", "_start")


def range_part(df: DataFrame, by: str, parts: int) -> F.Column:
    """Number of the range of ``by`` that a row lies in, by quantiles from one pass over that column alone.

    Nulls are in -1, before all others. The number of cuts follows ``parts``, not the rows.
    """
    cuts: list = []
    if parts > 1:
        shares = [k / parts for k in range(1, parts)]
        cuts = df.agg(F.percentile_approx(by, shares, max(10_000, 20 * parts)).alias("cuts")).first().cuts or []
    return F.when(F.col(by).isNull(), -1).otherwise(_place(sorted(set(cuts)), by)).cast("int")


def _place(cuts: list, by: str) -> F.Column:
    """Number of cuts not above a value, by halving: a tree of comparisons of logarithmic depth."""
    if not cuts:
        return F.lit(0)

    def node(low: int, high: int) -> F.Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(by) >= cuts[middle], node(middle + 1, high)).otherwise(node(low, middle))

    return node(0, len(cuts))


def numbered(
    df: DataFrame, key: str, order: list[str], name: str, rows_per_part: int = 20_000, ranged: bool = False
) -> DataFrame:
    """``df`` with a gapless number from 0 for each row within its ``key``.

    Rows are dealt to parts by a hash of the order columns, so that a key holding most rows is numbered by
    many tasks: counts per key and part give each part its first number. With ``ranged`` the parts are ranges of
    the first order column, which should hardly repeat, and numbers follow its order. ``df`` must come from
    a written table, and ``key`` may not be null.
    """
    parts = max(df.count() // rows_per_part, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = range_part(df, order[0], parts) if ranged else F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")
    df = df.withColumn("_part", part)
    counts = df.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    number = F.col("_first") + F.row_number().over(inside) - 1
    return df.join(firsts, [key, "_part"]).withColumn(name, number.cast("long")).drop("_part", "_first")
