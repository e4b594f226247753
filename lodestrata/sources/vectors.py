"""Ingest of vector tables: (id, vec) with checks, and derived deterministic test inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, vec as doubles; only the two columns are scanned."""
    return spark.read.parquet(path).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def checked(df: DataFrame) -> DataFrame:
    """Fails while running on null or non-finite vectors and null ids."""
    bad = F.col("vec").isNull() | F.col("id").isNull() | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.withColumn("vec", F.when(bad, F.raise_error(F.lit("null or non-finite vector"))).otherwise(F.col("vec")))


def blobs(spark: SparkSession, sf_dir: str, weight: float = 3.0) -> DataFrame:
    """id, vec, label: the embeddings moved apart along one axis for each label."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i == F.col("label"), weight).otherwise(0.0))
    return t.select(F.col("vec_id").alias("id"), moved.alias("vec"), "label")
