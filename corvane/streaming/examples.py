"""Continuous preparation of arriving line files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.records import render_record
from corvane.operators.examples import overlong, render, usable, validate
from corvane.operators.ingest import ingest, with_record
from corvane.operators.once import once
from corvane.streaming.sinks import batches_below, write_batch

COUNTS = "total_rows long, valid_rows long, skipped_rows long, empty_rows long"


def stream_lines(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of files that arrive in a directory; a trigger takes a bounded number."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .text(directory)
        .select(F.col("value").alias("line"))
    )


def stream_prepare(
    lines: DataFrame, max_length: int, answer_keys: Sequence[str] = ("output",), permissive: bool = False
) -> DataFrame:
    """Parse, render and validate; stateless, so any output mode and sink will do."""
    good = ingest(lines, permissive=permissive).good
    return validate(render(good, answer_keys=answer_keys), max_length)


def stream_ingest(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    max_length: int,
    answer_keys: Sequence[str] = ("output",),
    permissive: bool = False,
    **trigger,
) -> StreamingQuery:
    """Start preparing arriving lines into examples, rejects and counts below a folder.

    Every line ends as one row, an example or a reject with its ``reason``
    (``malformed``, ``no_known_shape``, or ``empty`` for a record whose text is
    blank), in the trigger's own folder. The counts are observed while that one
    write runs, so the lines are parsed once. A trigger that is played again after
    a failure replaces its folders and changes nothing. Read with ``examples``,
    ``rejects`` and ``counts``.
    """
    root = path.rstrip("/")

    def put(batch: DataFrame, number: int) -> None:
        tagged = with_record(batch.select("line"), permissive=permissive)
        text = F.when(F.col("reason").isNull(), render_record(F.col("record"), answer_keys))
        rows = once(tagged, text=text)
        skipped, blank = F.col("reason").isNotNull(), F.col("reason").isNull() & ~usable(F.col("text"))
        seen = Observation()
        rows = rows.observe(
            seen,
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if(~skipped).alias("valid_rows"),
            F.count_if(skipped).alias("skipped_rows"),
            F.count_if(blank).alias("empty_rows"),
        )
        good = ~skipped & ~blank
        out = rows.select(
            F.when(good, "example").otherwise("reject").alias("kind"),
            F.when(good, F.col("text")).alias("text"),
            F.when(good, overlong(F.col("text"), max_length)).alias("overlong"),
            F.when(~good, F.col("line")).alias("line"),
            F.when(blank, "empty").otherwise(F.col("reason")).alias("reason"),
        )
        write_batch(out, f"{root}/rows", number, "kind")
        found = seen.get
        counted = batch.sparkSession.createDataFrame([tuple(found[c.split()[0]] for c in COUNTS.split(", "))], COUNTS)
        write_batch(counted, f"{root}/counts", number)

    writer = lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def examples(spark: SparkSession, path: str) -> DataFrame:
    """``batch, text, overlong`` of all examples written so far."""
    rows = batches_below(spark, f"{path.rstrip('/')}/rows").filter("kind = 'example'")
    return rows.select("batch", "text", "overlong")


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """``batch, line, reason`` of all rejects written so far."""
    rows = batches_below(spark, f"{path.rstrip('/')}/rows").filter("kind = 'reject'")
    return rows.select("batch", "line", "reason")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many lines came, were kept, were skipped, and how many kept ones have a blank text."""
    rows = batches_below(spark, f"{path.rstrip('/')}/counts")
    return rows.agg(*[F.sum(c.split()[0]).alias(c.split()[0]) for c in COUNTS.split(", ")])
