"""The most frequent rows of a count table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.session import staged

PARTS = 200  # ranges in which a large table is ranked
STEPS = 8  # histogram groups per doubling of the count
MANY = 4  # times as many rows as are wanted
AT_ONCE = 100_000  # rows that are sorted for the first ones whatever is wanted


def most_frequent(counts: DataFrame, n: int, count: str, *order: str | Column) -> DataFrame:
    """The ``n`` rows with the highest count; ``order`` decides between equal counts.

    Sorting for the first ``n`` makes every partition send ``n`` rows to one
    task. A histogram of the counts (some hundred groups) first gives a count
    that at least ``n`` rows reach, and only those rows are sorted: at once while
    they are not many more than ``n``, in ranges where very many rows share the
    lowest count that is needed. Runs a job for the histogram.
    """
    step = F.floor(F.log2(F.col(count)) * STEPS)
    histogram = counts.groupBy(step.alias("step")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(count).alias("lowest")
    )
    reached = F.sum("rows").over(Window.orderBy(F.desc("step")))
    enough = histogram.withColumn("reached", reached).filter(F.col("reached") >= n)
    found = enough.agg(F.max_by(F.struct("lowest", "reached"), "step").alias("found")).first()["found"]
    high = counts if found is None else counts.filter(F.col(count) >= found["lowest"])
    if found is None or found["reached"] <= max(MANY * n, AT_ONCE):
        return high.orderBy(F.desc(count), *order).limit(n)
    place = "_place"
    return ranked(high, place, F.desc(count), *order).filter(F.col(place) <= n).drop(place)


def ranked(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Add the 1-based rank in an order of all rows, without one task that sees them all.

    Rows are dealt into ranges of the order and stored so; a rank is the place in
    the range after the rows of earlier ranges, of which there are ``PARTS``.
    """
    dealt = df.repartitionByRange(PARTS, *order).withColumn("_part", F.spark_partition_id())
    dealt = staged(dealt, "ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(Window.orderBy("_part"))
    before = sizes.select("_part", (upto - F.col("_rows")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_before")
