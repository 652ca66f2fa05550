"""Tables written to the cluster's shared folder, to cut lineage and to compute costly steps once."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's scratch folder, below ``spark.checkpoint.dir``.

    Only where that setting is missing (tests, local mode) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="lectio-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lectio-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, label: str = "cut", hashes: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with the same schema.

    The files survive the loss of any executor. Unlike ``checkpoint()``, the plan runs only once. ``hashes`` tells
    that its values hardly repeat, so that no dictionaries are tried.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("parquet.enable.dictionary", "false") if hashes else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectio_path = path
    return out


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote, when nothing reads it any more."""
    _delete(spark, df._lectio_path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables that nothing reads any more, and let the cluster drop the shuffle files behind them.

    Spark drops a shuffle's files when the driver's collector finds its plan out of use; that may take half an
    hour if nobody asks.
    """
    for df in tables:
        drop(spark, df)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clean(spark: SparkSession) -> None:
    """Delete every scratch table of this application. Call it once all results are written."""
    _delete(spark, folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
