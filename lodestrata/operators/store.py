"""Intermediate tables in the shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset: in local mode (tests) a folder of this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; intermediate tables need a folder that all machines share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="lodestrata-"))
        found = _local[0]
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestrata/{spark.sparkContext.applicationId}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "stored_path", None):
            _delete(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all stored tables of this application; results that read them must have been written before."""
    _delete(spark, f"{shared_folder(spark)}/lodestrata/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
