"""Session settings for tests and the benchmark, and the checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "holdfast") -> SparkSession:
    """A local session; a cluster job brings its own session and settings."""
    partitions = str(cpus if str(cpus).isdigit() else os.cpu_count())
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("HOLDFAST_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own; a cluster session without the
    setting is an error, since a machine-local folder is lost with the machine.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="holdfast-shared-")
        context.setCheckpointDir(shared)
    return shared


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder, for a written table, a model or stream progress."""
    return f"{shared_root(spark).rstrip('/')}/holdfast/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows from files in the shared folder.

    What reads them has their scan for a plan. A kept table has the plan behind it, kept ones within kept ones more than
    once each, and the driver holds all that as text for every query that reads it.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, in whatever store the path names; none if it is not there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the Python kernels.

    A cluster job can pass it with ``--py-files`` instead; sending it again does no harm.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="holdfast-package-"))
    archive = shutil.make_archive(str(folder / "holdfast"), "zip", package.parent, package.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
