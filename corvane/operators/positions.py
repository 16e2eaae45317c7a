"""Rows that belong together by nothing but their place.

Line readers give ``(file, block, seq)``: the file, the range of it, and a number
that grows along the range. The ranges' sizes, a small table, are summed up along
the files; with the sum before its range every row knows its place among all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corvane.session import staged

SPLITS = 1_000_000  # rows of the broadcast table of ranges


class LengthError(ValueError):
    """Two sets of lines that should pair off have different lengths."""


def range_sizes(rows: DataFrame) -> DataFrame:
    """``file, block, first, size, before, whole`` of every range that has rows (stored).

    ``before`` is the number of rows ahead of the range, ``whole`` whether its
    numbers have no gaps. The sum runs along each file and then along the files:
    no window holds more than one row per range of a file, or per file.
    """
    sizes = rows.groupBy("file", "block").agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("size")
    )
    sizes = staged(sizes, "range-sizes")
    files = sizes.groupBy("file").agg(F.sum("size").alias("file_size"))
    ahead = F.sum("file_size").over(Window.orderBy("file")) - F.col("file_size")
    files = files.select("file", ahead.alias("ahead"))
    inside = F.sum("size").over(Window.partitionBy("file").orderBy("block")) - F.col("size")
    placed = sizes.withColumn("inside", inside).join(files, "file")
    whole = F.col("last") - F.col("first") + 1 == F.col("size")
    return staged(
        placed.select("file", "block", "first", "size", (F.col("ahead") + F.col("inside")).alias("before"), whole.alias("whole")),
        "range-places",
    )


def with_position(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Add ``position``, from 0 and without gaps, in the order of ``file, block, seq``.

    Rows of a range from which some were filtered are counted anew within it; all
    others only add a number to their own.
    """
    sizes = range_sizes(rows) if sizes is None else sizes
    gaps = not sizes.filter(~F.col("whole")).isEmpty()
    known = sizes.select("file", "block", "first", "before", "whole")
    met = rows.join(F.broadcast(known) if sizes.count() <= SPLITS else known, ["file", "block"])
    extra = ["first", "before", "whole"]
    found = met.filter("whole").withColumn("position", F.col("before") + F.col("seq") - F.col("first")).drop(*extra)
    if not gaps:
        return found
    order = Window.partitionBy("file", "block").orderBy("seq")
    counted = met.filter(~F.col("whole")).withColumn("position", F.col("before") + F.row_number().over(order) - 1)
    return found.unionByName(counted.drop(*extra))


def attach_by_position(pairs: DataFrame, predictions: DataFrame, prediction: str = "line") -> DataFrame:
    """Every pair with the prediction at the same place; both sides have ``file, block, seq``.

    The files and ranges of the two sides need not agree in anything but the
    number of rows: another number of predictions than pairs is a ``LengthError``.
    Keeps the pairs' columns and adds ``position`` and ``prediction``.
    """
    sizes, others = range_sizes(pairs), range_sizes(predictions)
    count = lambda table: table.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if count(sizes) != count(others):
        raise LengthError(f"{count(others)} predictions for {count(sizes)} pairs")
    answers = with_position(predictions, others).select("position", F.col(prediction).alias("prediction"))
    return with_position(pairs, sizes).join(answers, "position")
