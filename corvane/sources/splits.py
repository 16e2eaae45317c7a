"""Small splits of files, many to a task."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

TASK = 16 << 20  # bytes that are worth a task
EACH = 4  # tasks a slot at least
UNITS = "bkmgt"


def many_to_a_task(read: DataFrame) -> DataFrame:
    """Rows read from files, where splits far smaller than a task should be do not get one each.

    A split stays what it is and its rows stay together and in order; a task
    only goes through several. Splits of the usual size stay tasks of their own.
    """
    spark = read.sparkSession
    splits = read.rdd.getNumPartitions()
    number, unit = re.match(r"(\d+)\s*([a-z]?)", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    size = int(number) << 10 * max(UNITS.find(unit or "b"), 0)
    tasks = max(EACH * spark.sparkContext.defaultParallelism, -(-splits * size // TASK))
    return read.coalesce(tasks) if tasks < splits else read
