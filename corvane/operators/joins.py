"""Joins in which NULL keys meet NULL keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL; the left side's keys stay."""
    renamed = right.select(*[F.col(c).alias(f"_same_{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_same_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_same_{k}" for k in keys])
