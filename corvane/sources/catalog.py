"""What datasets and splits a directory holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import fixed
from corvane.sources.files import data_files, glob_paths, subdirectories

SPLIT_INFO_TYPE = "map<string,struct<splits:map<string,struct<num_examples:bigint>>>>"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, modificationTime)`` of every file below a directory.

    The content is never read: only these columns of the scan are used.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
    )


def relative_path(path: str, root: str):
    """Part of a path after the directory, whatever scheme the listing adds."""
    plain = "/" + root.split("://")[-1].split(":", 1)[-1].strip("/") + "/"
    return F.substring_index(F.col(path), plain, -1)


def dataset_catalog(
    spark: SparkSession, root: str, suffixes: Sequence[str] = fixed.CATALOG_SUFFIXES
) -> DataFrame:
    """``(dataset, files)``: sub-directories that hold data files, at any depth."""
    below = list_files(spark, root).select(relative_path("path", root).alias("rest"))
    kinds = "|".join(s.replace(".", r"\.") for s in suffixes)
    inside = below.filter(F.col("rest").rlike(f"^[^./][^/]*/.*({kinds})$"))
    return inside.groupBy(F.substring_index("rest", "/", 1).alias("dataset")).agg(
        F.count(F.lit(1)).alias("files")
    )


def split_catalog(spark: SparkSession, directory: str) -> DataFrame:
    """``(split, rows)`` from the dataset's own description, else counted: by
    sub-directory of a columnar dataset, by shard name (before the first ``-``),
    or all under ``train``."""
    root = directory.rstrip("/")
    described = glob_paths(spark, f"{root}/{fixed.SPLIT_INFO_FILE}")
    if described:
        info = spark.read.text(described, wholetext=True).select(
            F.map_entries(F.from_json("value", SPLIT_INFO_TYPE))[0]["value"]["splits"].alias("splits")
        )
        entries = info.select(F.explode("splits").alias("split", "info"))
        return entries.select("split", F.coalesce("info.num_examples", F.lit(0).cast("long")).alias("rows"))
    if glob_paths(spark, f"{root}/*.parquet"):
        rows = spark.read.parquet(root)
        return rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("train").alias("split"), "rows")
    columnar = [n for n in subdirectories(spark, root) if glob_paths(spark, f"{root}/{n}/*.parquet")]
    if columnar:
        rows = spark.read.parquet(*[f"{root}/{n}" for n in columnar])
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return rows.groupBy(name.alias("split")).agg(F.count(F.lit(1)).alias("rows"))
    files = data_files(spark, root)
    if not files:
        return spark.createDataFrame([("train", 0)], "split string, rows bigint")
    sharded = [f for f in files if "-" in f.rsplit("/", 1)[-1]]
    name = F.substring_index(F.col("_metadata.file_name"), "-", 1) if sharded else F.lit("train")
    lines = spark.read.text(sharded or files).select(name.alias("split"))
    return lines.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
