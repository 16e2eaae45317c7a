"""Line sources: globs, split shards and directories of JSON lines.

Every reader returns ``(file, block, seq, line)``; ordering by the first three
is the order of the lines in the files. ``block`` and ``seq`` depend on how
Spark splits the files; ``number_lines`` adds what does not.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corvane.functions import fixed
from corvane.session import staged
from corvane.sources import json_lists
from corvane.sources.splits import many_to_a_task

SPLITS = 1_000_000  # rows of the broadcast table of splits


def glob_paths(spark: SparkSession, pattern: str, directories: bool | None = None) -> list[str]:
    """Existing paths that match, listed by the file system the path names.

    ``directories`` keeps only directories (True) or only files (False).
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(
        s.getPath().toString()
        for s in (found or [])
        if directories is None or s.isDirectory() == directories
    )


def files_below(spark: SparkSession, directory: str, pattern: str) -> list[str]:
    """Files at any depth below a directory whose path from there matches a glob."""
    root = directory.rstrip("/")
    below = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    inner = F.substr("path", F.lit(len(root) + 2))
    return sorted(r["path"] for r in below.filter(inner.rlike(f"^(.*/)?{glob_pattern(pattern)}$")).collect())


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``**/`` is any depth, ``*`` and ``?`` stay in a name."""
    out, at = "", 0
    while at < len(glob):
        rest = glob[at:]
        if rest.startswith("**/"):
            out, at = out + "(.*/)?", at + 3
        elif rest[0] == "[" and "]" in rest[2:]:
            end = rest.index("]", 2)
            inner = rest[1:end].replace("\\", "\\\\").replace("[", "\\[")
            out, at = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", at + end + 1
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(rest[0], re.escape(rest[0]))
            at += 1
    return out


def subdirectories(spark: SparkSession, directory: str) -> list[str]:
    """Names of the directories directly below one, hidden ones left out."""
    paths = glob_paths(spark, f"{directory.rstrip('/')}/*", directories=True)
    names = [p.rsplit("/", 1)[-1] for p in paths]
    return [n for n in names if not n.startswith(("_", "."))]


def spread(df: DataFrame) -> DataFrame:
    """Rows of files that cannot be split, over all slots of the cluster."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def read_lines(spark: SparkSession, paths: Sequence[str], tolerant: bool = False) -> DataFrame:
    """Lines of the given files; ``tolerant`` passes over unreadable ones.

    Gzip files cannot be split: lines that come from such files only are spread
    out once. A ``.json`` file may be one JSON list; it gives a line per element.
    """
    named = [p for p in paths if _is_json(p)]
    chunks = json_lists.chunks(spark, named, tolerant) if named else None
    where = json_lists.places(chunks) if named else None
    lists = _listed(where, named) if named else set()
    plain = [p for p in paths if p not in lists]
    found = [_plain_lines(spark, plain, tolerant)] if plain or not lists else []
    if lists:
        found.append(json_lists.elements(chunks, where))
    return reduce(DataFrame.unionByName, found)


def _plain_lines(spark: SparkSession, paths: Sequence[str], tolerant: bool) -> DataFrame:
    lines = _reader(spark, tolerant).text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )
    return spread(lines) if paths and all(p.endswith(".gz") for p in paths) else many_to_a_task(lines)


def _listed(where: DataFrame, paths: Sequence[str]) -> set[str]:
    """Those of the paths that are one JSON list (their names are on the driver as it is)."""
    found = {_plain(r["file"]) for r in where.filter("listed").select("file").distinct().collect()}
    return {p for p in paths if _plain(p) in found}


def _reader(spark: SparkSession, tolerant: bool):
    options = {"ignoreCorruptFiles": str(tolerant).lower(), "ignoreMissingFiles": str(tolerant).lower()}
    return spark.read.options(**options)


def _is_json(path: str) -> bool:
    return path.endswith((".json", ".json.gz"))


def _plain(path: str) -> str:
    """A path in one spelling: the metadata column writes it as a URI, listings do not."""
    named = path if re.match(r"[a-z][a-z0-9]*:", path) else f"file:{path}"
    return re.sub(r"^([a-z0-9]+):/*", r"\1:/", unquote(named))


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``number``: the place of a line in its file, from 1, however the file was split.

    Runs a job that counts the lines of every split; that table (a row per split
    of the input, 128 MB by default) is broadcast while it has at most
    ``SPLITS`` rows.
    """
    counted = lines.groupBy("file", "block").agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    counted = staged(counted, "line-counts")
    upto = F.sum("_lines").over(Window.partitionBy("file").orderBy("block"))
    before = counted.select("file", "block", "_first", (upto - F.col("_lines")).alias("_before"))
    if counted.count() <= SPLITS:
        before = F.broadcast(before)
    number = F.col("seq") - F.col("_first") + F.col("_before") + 1
    return lines.join(before, ["file", "block"]).withColumn("number", number).drop("_first", "_before")


def read_jsonl(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of all files that match a glob; ``**`` goes down all directories."""
    base, deep, rest = pattern.partition("**")
    paths = glob_paths(spark, base.rstrip("/") or "/" if deep else pattern)
    if deep:
        paths = [f for p in paths for f in files_below(spark, p, rest.strip("/") or "*")]
    if not paths:
        raise FileNotFoundError(f"nothing to read at {pattern}")
    return read_lines(spark, paths)


def split_files(spark: SparkSession, directory: str, split: str) -> list[str]:
    """Shards ``{split}-*`` of the known kinds, without repeats, sorted."""
    found: set[str] = set()
    for suffix in fixed.LINE_SUFFIXES:
        found.update(glob_paths(spark, f"{directory.rstrip('/')}/{split}-*{suffix}"))
    return sorted(found)


def data_files(spark: SparkSession, directory: str) -> list[str]:
    """All data files directly in a directory."""
    found: set[str] = set()
    for suffix in fixed.LINE_SUFFIXES:
        found.update(glob_paths(spark, f"{directory.rstrip('/')}/*{suffix}"))
    return sorted(found)


def read_split_files(spark: SparkSession, directory: str, split: str) -> DataFrame:
    """Lines of a split's shards, without those that cannot be read."""
    paths = split_files(spark, directory, split)
    if not paths:
        raise FileNotFoundError(f"{directory} has no shards of {split}")
    return read_lines(spark, paths, tolerant=True)
