"""Training logs as a metric table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators.telemetry import parse_log


def read_training_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(run, ts, level, step, metric, value)``; the run is the file's name."""
    lines = spark.read.text(paths).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("run"),
        F.col("value").alias("line"),
    )
    return parse_log(lines)
