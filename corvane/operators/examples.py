"""From records to training texts and evaluation pairs: narrow operators only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.records import eval_pair, render_record
from corvane.functions.text import strip
from corvane.operators.once import once


def render(
    df: DataFrame,
    *keep: str,
    record: str = "record",
    answer_keys: Sequence[str] = ("output",),
) -> DataFrame:
    """Keep the named columns and add ``text``; all other columns are dropped."""
    return once(df, text=render_record(F.col(record), answer_keys)).select(*keep, "text")


def usable(text: Column) -> Column:
    """True for a text that is not empty after a strip; never NULL."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def overlong(text: Column, max_length: int) -> Column:
    """True for a text far above the length in tokens, judged by its characters."""
    return F.length(text) > 10 * max_length


def validate(df: DataFrame, max_length: int, text: str = "text") -> DataFrame:
    """Drop unusable texts; flag, but keep, very long ones."""
    return df.filter(usable(F.col(text))).withColumn("overlong", overlong(F.col(text), max_length))


def eval_pairs(
    df: DataFrame, *keep: str, record: str = "record", prefer_instruction: bool = False
) -> DataFrame:
    """Keep the named columns and add ``prompt`` and ``reference``."""
    pair = eval_pair(F.col(record), prefer_instruction)
    return once(df, _pair=pair).select(*keep, "_pair.prompt", "_pair.reference")


def nonempty_pairs(df: DataFrame) -> DataFrame:
    """Rows whose prompt and reference are both present and not empty."""
    return df.filter((F.length("prompt") > 0) & (F.length("reference") > 0))


def min_chars(df: DataFrame, text: str, n: int = 5) -> DataFrame:
    """Rows whose stripped text has at least ``n`` characters."""
    return df.filter(F.length(strip(F.col(text))) >= n)
