"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python functions find their module there by name; a cluster where the
    package is installed, or given as ``--py-files``, has no need of it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corvane-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def build_session(
    name: str = "corvane",
    master: str | None = None,
    configs: dict[str, str] | None = None,
) -> SparkSession:
    """Session with adaptive execution on; cluster settings win where given."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in (configs or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="corvane-")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh directory below the cluster's shared checkpoint folder.

    The cluster names the shared folder in ``spark.checkpoint.dir``. A session
    on one machine (``local[...]``) may leave it out and gets a temporary
    folder for the process; anywhere else its absence is an error, because
    executors do not see each other's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_folder()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table below the shared folder and read it back.

    For results that later steps read several times: the work is done once, a
    lost executor costs no recomputation, and each later pass reads only the
    columns it needs.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
