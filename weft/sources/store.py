"""Tables in the folder that the driver and all executors share, and Python code for executors."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where that is unset, a local folder, but only if driver and executors are one process."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:{tempfile.gettempdir()}/weft-{context.applicationId}"


def written(df: DataFrame, path: str, batch_rows: int | None = None, **options: str) -> DataFrame:
    """``df`` written as Parquet and read back. The shuffle files of the write go as soon as it is done. Python workers are sent ``batch_rows`` rows at once, if given."""
    spark = df.sparkSession
    cleanup, batch = spark.conf.get(_CLEANUP, "false"), spark.conf.get(_BATCH)
    spark.conf.set(_CLEANUP, "true")
    if batch_rows is not None:
        spark.conf.set(_BATCH, str(batch_rows))
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, cleanup)
        spark.conf.set(_BATCH, batch)
    return spark.read.schema(df.schema).parquet(path)


def materialized(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written once and read back: its lineage ends here, and lost executors lose nothing."""
    return written(df, f"{shared_folder(df.sparkSession)}/weft-graph/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}", **options)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark knows, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []


def drop_materialized(spark: SparkSession) -> None:
    """Delete every table that ``materialized`` wrote in this application. For when the results that read them are written."""
    delete_folder(spark, f"{shared_folder(spark)}/weft-graph/{spark.sparkContext.applicationId}")


def release_memory() -> None:
    """Give back what this process holds but doesn't use. Idle Python workers stay with an executor, and would keep what their last task took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a function of glibc
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` on executors that may not have this package installed: it is sent to them once an application."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp()) / "weft.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return df.mapInArrow(released, schema)
