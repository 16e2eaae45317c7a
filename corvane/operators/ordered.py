"""Order-dependent operators over groups of any size.

A plain window puts a whole group into one task. Here the rows of a group are
cut into chunks, the windows run per (group, chunk), and what a chunk needs from
its neighbours is carried over a table with one small row per chunk.

Positions (turns of a conversation) are cut by value: ``size`` consecutive ones
make a chunk, which needs no look at the data. Other whole numbers (steps, time
stamps, ids) may lie far apart; ``sparse_chunks`` counts rows first and cuts by
their number. NULL keys are a group like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.operators.joins import join_same
from corvane.session import staged

CHUNK = 4096
CHUNK_COL = "_chunk"


def with_chunk(df: DataFrame, order: str, size: int = CHUNK) -> DataFrame:
    return df.withColumn(CHUNK_COL, F.floor(F.col(order) / size).cast("long"))


def sparse_chunks(df: DataFrame, keys: Sequence[str], order: str, size: int = CHUNK) -> DataFrame:
    """Stored rows in chunks of at most ``2 * size`` rows, however far apart the order values lie.

    A chunk with more rows (at first a whole group) is cut into spans as wide as
    ``size`` of its rows lie on average, until none is left: one round where
    values lie evenly, a few where they cluster. A round is one narrow count of
    keys and order; the rows themselves are written once. A chunk is named by
    its place in every round. Rows with the same order value stay together.
    """
    keys, value = list(keys), F.col(order)
    whole = F.array().cast("array<bigint>")
    tables: list[DataFrame] = []

    def cut(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(CHUNK_COL, whole)
        for table in tables:
            place = F.array(F.floor((value - F.col("_low")) / F.col("_width")).cast("long"))
            deeper = F.when(F.col("_width").isNull(), F.col(CHUNK_COL)).otherwise(F.concat(CHUNK_COL, place))
            joined = join_same(rows, table, [*keys, CHUNK_COL], "left")
            rows = joined.withColumn(CHUNK_COL, deeper).drop("_low", "_width")
        return rows

    while True:
        count, span = F.count(F.lit(1)), F.max(order) - F.min(order) + 1
        found = cut(df.select(*keys, order)).groupBy(*keys, CHUNK_COL).agg(
            F.min(order).alias("_low"), F.ceil(span.cast("double") * size / count).cast("long").alias("_width"),
            count.alias("_rows"), span.alias("_span"),
        )
        full = found.filter((F.col("_rows") > 2 * size) & (F.col("_span") > 1)).drop("_rows", "_span")
        full = staged(full, "full-chunks")
        if full.isEmpty():
            return staged(cut(df), "chunks")
        tables.append(full)


def chunk_window(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys, CHUNK_COL).orderBy(order)


def carry_window(keys: Sequence[str]):
    """Order of the chunks of a group; used on one row per chunk only."""
    return Window.partitionBy(*keys).orderBy(CHUNK_COL)


def next_row(
    df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], size: int = CHUNK
) -> DataFrame:
    """Add ``next`` (struct of ``cols`` of the following row of the group),
    the chunk number and ``_later`` (a later chunk exists).

    The order column counts from 0 upwards (a negative value is an error). Only
    chunks after the first can follow another one, so the extra read takes the
    rows from ``size`` on (a filter the scan can use): next to nothing unless
    groups are long.
    """
    keys = list(keys)
    negative = F.raise_error(F.lit(f"{order} counts from 0 upwards"))
    checked = F.when(F.col(order) < 0, negative.cast("long")).otherwise(F.floor(F.col(order) / size).cast("long"))
    chunked = df.withColumn(CHUNK_COL, checked)
    first = (
        chunked.filter(F.col(order) >= size)
        .groupBy(*keys, CHUNK_COL)
        .agg(F.min_by(F.struct(*cols), order).alias("_first"))
    )
    before = F.coalesce(F.lag(CHUNK_COL).over(carry_window(keys)), F.lit(0).cast("long"))
    carry = first.select(*keys, before.alias(CHUNK_COL), "_first")
    local = F.lead(F.struct(*cols)).over(chunk_window(keys, order))
    return (
        join_same(chunked.withColumn("next", local), carry, [*keys, CHUNK_COL], "left")
        .withColumn("next", F.coalesce("next", "_first"))
        .withColumn("_later", F.col("_first").isNotNull())
        .drop("_first")
    )


@dataclass(frozen=True)
class Running:
    """A running value: ``kind`` is ``sum``, ``min``, ``max``, ``first`` or ``last`` (non-null).

    ``before=True`` leaves the current row out.
    """

    kind: str
    value: Column
    before: bool = False


_TOTAL = {
    "sum": lambda v, order: F.sum(v),
    "min": lambda v, order: F.min(v),
    "max": lambda v, order: F.max(v),
    "first": lambda v, order: F.min_by(v, F.when(v.isNotNull(), F.col(order))),
    "last": lambda v, order: F.max_by(v, F.when(v.isNotNull(), F.col(order))),
}
_OVER = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "first": lambda v: F.first(v, ignorenulls=True),
    "last": lambda v: F.last(v, ignorenulls=True),
}
_JOIN = {
    "sum": lambda carry, local: F.coalesce(carry + local, carry, local),
    "min": lambda carry, local: F.least(carry, local),
    "max": lambda carry, local: F.greatest(carry, local),
    "first": lambda carry, local: F.coalesce(carry, local),
    "last": lambda carry, local: F.coalesce(local, carry),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Running],
    size: int = CHUNK,
) -> DataFrame:
    """Add one running value per entry, over the rows of a group in order.

    The data is shuffled once, by (group, chunk); totals per chunk are combined
    before their own shuffle and only the value columns are read for them. Rows
    that have chunks already (``sparse_chunks``) keep them.
    """
    keys = list(keys)
    has_chunks = CHUNK_COL in df.columns
    chunked = df if has_chunks else with_chunk(df, order, size)
    for name, spec in values.items():
        chunked = chunked.withColumn(f"_v_{name}", spec.value)

    totals = chunked.groupBy(*keys, CHUNK_COL).agg(
        *[_TOTAL[s.kind](F.col(f"_v_{n}"), order).alias(f"_t_{n}") for n, s in values.items()]
    )
    earlier = carry_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        CHUNK_COL,
        F.lag(CHUNK_COL).over(carry_window(keys)).alias("_prior"),
        *[_OVER[s.kind](F.col(f"_t_{n}")).over(earlier).alias(f"_c_{n}") for n, s in values.items()],
    )
    carry = carry.filter(F.col("_prior").isNotNull()).drop("_prior")

    local = chunk_window(keys, order)
    out = join_same(chunked, carry, [*keys, CHUNK_COL], "left")
    for name, spec in values.items():
        frame = local.rowsBetween(Window.unboundedPreceding, -1 if spec.before else 0)
        own = _OVER[spec.kind](F.col(f"_v_{name}")).over(frame)
        out = out.withColumn(name, _JOIN[spec.kind](F.col(f"_c_{name}"), own))
    used = [] if has_chunks else [CHUNK_COL]
    return out.drop(*used, *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])
