"""Live metric table from growing training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators.telemetry import parse_log


def stream_log_lines(spark: SparkSession, directory: str) -> DataFrame:
    """``(run, line)`` of log files that arrive in a directory, a run per file name."""
    return spark.readStream.text(directory).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\..*$", "").alias("run"),
        F.col("value").alias("line"),
    )


def stream_metrics(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Metric rows of arriving log lines, each once.

    A line that a rotated log repeats is dropped while the watermark still
    covers it, which also bounds the state.
    """
    return (
        parse_log(lines)
        .withWatermark("ts", late)
        .dropDuplicatesWithinWatermark(["run", "ts", "step", "metric", "value"])
    )
