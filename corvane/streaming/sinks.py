"""A folder per trigger: writing one again, after a failure, replaces it as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.sources.files import glob_paths


def write_batch(rows: DataFrame, path: str, number: int, *by: str) -> None:
    """Write a trigger's rows below ``path``; they count once the folder is complete."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path.rstrip('/')}/batch={number}")


def batches_below(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all complete folders, with the number of their ``batch``."""
    root = path.rstrip("/")
    done = [p.rsplit("/", 1)[0] for p in glob_paths(spark, f"{root}/batch=*/_SUCCESS")]
    if not done:
        raise FileNotFoundError(f"no trigger has been written to {path}")
    rows = spark.read.option("basePath", root).parquet(*done)
    return rows.withColumn("batch", F.col("batch").cast("long"))
