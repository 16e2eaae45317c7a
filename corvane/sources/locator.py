"""One string that says where a dataset is.

=====================  ====================================================
``hf_files:dir:split``  shards ``split-*`` of JSON lines in a directory
``hf:dir:split``        columnar dataset (Arrow or Parquet), one sub-directory per split
``org/name``            catalog table ``org.name`` with a ``split`` column
anything else           glob over JSON line files
=====================  ====================================================

The split is ``train`` where none is named.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.sources import arrow
from corvane.sources.files import (
    data_files,
    glob_paths,
    read_jsonl,
    read_lines,
    read_split_files,
    split_files,
    subdirectories,
)

DEFAULT_SPLIT = "train"
#: Names parted by slashes; what has glob signs, a scheme or begins like a path is a path.
NAMED = re.compile(r"(?!\.{0,2}/)[^*:/]+(/[^*:/]+)+")


def read_columnar(
    spark: SparkSession, directory: str, split: str | None = None, strict: bool = True
) -> DataFrame:
    """Arrow dataset with a description, or Parquet: ``directory/split``, or the directory
    itself if it has no splits. A missing split is an error, or with ``strict=False`` all splits."""
    root = directory.rstrip("/")
    if glob_paths(spark, f"{root}/{{{arrow.SPLITS_FILE},{arrow.STATE_FILE}}}"):
        names = arrow.splits_of(root)
        if names is None or strict or split in names:
            return arrow.read_arrow(spark, root, split or DEFAULT_SPLIT)
        parts = [arrow.read_arrow(spark, root, name) for name in names]
        return reduce(DataFrame.unionByName, parts)
    if glob_paths(spark, f"{root}/*.parquet"):
        return spark.read.parquet(root)
    splits = subdirectories(spark, root)
    if not splits:
        raise FileNotFoundError(f"no columnar dataset in {directory}")
    if split in splits:
        return spark.read.parquet(f"{root}/{split}")
    if strict and split is not None:
        raise ValueError(f"{directory} has the splits {', '.join(splits)} and not {split}")
    return spark.read.parquet(*[f"{root}/{name}" for name in splits])


def read_named(
    spark: SparkSession, name: str, split: str | None = DEFAULT_SPLIT, config: str | None = None
) -> DataFrame:
    """Catalog table ``org.name`` (or ``org.name_config``), one split of it."""
    table = name.replace("/", ".")
    if config:
        table = f"{table}_{config}"
    df = spark.table(table)
    return df if split is None or "split" not in df.columns else df.filter(F.col("split") == split)


def read_dataset(
    spark: SparkSession, locator: str, split: str | None = None, config: str | None = None
) -> DataFrame:
    """Dataset named by a locator; lazy. Line files give ``(file, block, seq, line)``."""
    if locator.startswith(("hf_files:", "hf:")):
        kind, _, rest = locator.partition(":")
        directory, _, named = rest.rpartition(":") if _has_split(rest) else (rest, "", "")
        chosen = split or named or DEFAULT_SPLIT
        reader = read_split_files if kind == "hf_files" else read_columnar
        return reader(spark, directory, chosen)
    if NAMED.fullmatch(locator):
        return read_named(spark, locator, split or DEFAULT_SPLIT, config)
    return read_jsonl(spark, locator)


def _has_split(rest: str) -> bool:
    """Whether text after the last colon names a split (and not the rest of a URL)."""
    head, colon, tail = rest.rpartition(":")
    return bool(colon) and bool(head) and "/" not in tail


def read_evaluation(spark: SparkSession, directory: str, split: str | None = None) -> DataFrame:
    """Directory for evaluation: the split's shards, else a columnar dataset,
    else every data file in it. What is no path but reads like a name is a
    catalog table."""
    if NAMED.fullmatch(directory) and not glob_paths(spark, directory):
        return read_named(spark, directory, split)
    if split:
        shards = split_files(spark, directory, split)
        if shards:
            return read_lines(spark, shards)
    try:
        return read_columnar(spark, directory, split, strict=False)
    except (FileNotFoundError, AnalysisException):
        loose = data_files(spark, directory)
        if not loose:
            raise
        return read_lines(spark, loose)
