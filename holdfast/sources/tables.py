"""Readers and sinks. Every reader takes an explicit schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import schema as S

CORRUPT = "_corrupt_record"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_accounts_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV. Money and date stay text so that cleaning can null what does not parse."""
    schema = schema or S.account_schema(money=T.StringType(), date=T.StringType())
    if CORRUPT not in schema.fieldNames():
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def read_accounts_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON record per line."""
    return spark.read.schema(schema or S.account_schema()).json(path)


def explode_batch(df: DataFrame, column: str, schema: T.StructType | None = None) -> DataFrame:
    """Request texts ``{"customers": [...]}`` to one row per customer with its position."""
    schema = schema or S.account_schema()
    request = T.StructType([T.StructField("customers", T.ArrayType(schema))])
    parsed = df.withColumn("_request", F.from_json(column, request))
    rest = [name for name in df.columns if name != column]
    rows = parsed.select(*rest, F.posexplode("_request.customers").alias("index", "_customer"))
    return rows.select(*rest, "index", "_customer.*")


def union_all(first: DataFrame, second: DataFrame) -> DataFrame:
    """Stack by column name; a column one side lacks is null there."""
    return first.unionByName(second, allowMissingColumns=True)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    """Parquet, ORC, CSV with header, or JSON. Vectors and arrays need parquet, ORC or JSON."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
