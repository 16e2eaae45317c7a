"""Columns that are computed one time per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions the optimizer must not copy.

    Filters and projections are otherwise merged by writing an expression out
    at each place that uses it: a parsed record or a token list would be
    computed for every use. As the output of a generator it is computed once.
    """
    added = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(added)))
