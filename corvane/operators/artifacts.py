"""Reports over a listing of adapter directories (one row per file)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions import fixed


def parse_listing(listing: DataFrame, base: str = "", path: str = "path") -> DataFrame:
    """Add ``adapter``, ``checkpoint`` (NULL for the root), ``number`` and ``file``.

    Paths are ``base/adapter/file`` or ``base/adapter/checkpoint-N/file``. A
    file anywhere deeper shows that its directories exist but is none of
    theirs: ``file`` is NULL. Hidden adapters are left out.
    """
    relative = F.substr(F.col(path), F.lit(len(base) + 1))
    parts = F.split(F.ltrim(relative, F.lit("/")), "/")
    second = F.get(parts, F.lit(1))
    in_checkpoint = (F.size(parts) >= 3) & second.startswith(fixed.CHECKPOINT_PREFIX)
    depth = F.when(in_checkpoint, 3).otherwise(2)
    return (
        listing.withColumn("adapter", parts[0])
        .withColumn("checkpoint", F.when(in_checkpoint, second))
        .withColumn("number", F.expr("try_cast(split(checkpoint, '-')[1] AS BIGINT)"))
        .withColumn("file", F.when(F.size(parts) == depth, F.element_at(parts, -1)))
        .filter((F.size(parts) >= 2) & ~F.col("adapter").startswith("."))
    )


def _has(*names: str) -> Column:
    return F.coalesce(F.bool_or(F.col("file").isin(*names)), F.lit(False))


def artifact_validity(files: DataFrame) -> DataFrame:
    """Per adapter root and per checkpoint: config there, weights there, valid, why not."""
    grouped = files.groupBy("adapter", "checkpoint", "number").agg(
        _has(fixed.CONFIG_FILE).alias("has_config"),
        _has(*fixed.MODEL_FILES).alias("has_model"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
    )
    reason = F.when(~F.col("has_config"), "missing config").when(~F.col("has_model"), "missing model file")
    return grouped.withColumn("valid", F.col("has_config") & F.col("has_model")).withColumn("reason", reason)


def _per_adapter(validity: DataFrame) -> DataFrame:
    """One row per adapter: root facts, newest checkpoint, newest valid checkpoint.

    Checkpoint names without a number make the order, hence both picks, unknown.
    """
    root = F.col("checkpoint").isNull()
    newest = F.struct("checkpoint", "has_config", "valid")
    known = F.count_if(~root & F.col("number").isNull()) == 0
    return validity.groupBy("adapter").agg(
        F.coalesce(F.bool_or(root & F.col("has_config")), F.lit(False)).alias("root_config"),
        F.coalesce(F.bool_or(root & F.col("valid")), F.lit(False)).alias("root_valid"),
        F.count_if(~root).alias("checkpoints"),
        F.when(known, F.max_by(newest, F.when(~root, F.col("number")))).alias("latest"),
        F.when(
            known, F.max_by("checkpoint", F.when(~root & F.col("valid"), F.col("number")))
        ).alias("latest_valid"),
    )


def latest_checkpoint(validity: DataFrame) -> DataFrame:
    """``(adapter, source)``: the root if it has the config, else the newest
    checkpoint if that one has it, else NULL."""
    found = (
        F.when(F.col("root_config"), "root")
        .when(F.col("latest.has_config"), F.col("latest.checkpoint"))
    )
    return _per_adapter(validity).select("adapter", found.alias("source"))


def resolved_artifact(validity: DataFrame) -> DataFrame:
    """``(adapter, source)``: the root if complete, else the newest complete
    checkpoint, else NULL."""
    found = F.when(F.col("root_valid"), "root").otherwise(F.col("latest_valid"))
    return _per_adapter(validity).select("adapter", found.alias("source"))


def artifact_report(validity: DataFrame) -> DataFrame:
    """``(adapter, status, latest)``; status is valid, needs_fix or no_checkpoints."""
    status = (
        F.when(F.col("root_valid"), "valid")
        .when(F.col("checkpoints") > 0, "needs_fix")
        .otherwise("no_checkpoints")
    )
    return _per_adapter(validity).select(
        "adapter", status.alias("status"), F.col("latest.checkpoint").alias("latest")
    )


def repair_plan(files: DataFrame, validity: DataFrame) -> DataFrame:
    """Files a repair would copy from the newest checkpoint into the root.

    Only for roots that are incomplete and whose newest checkpoint is complete.
    The binary weights are copied only where the other form is missing.
    """
    needed = _per_adapter(validity).filter(~F.col("root_valid") & F.col("latest.valid"))
    source = needed.select("adapter", F.col("latest.checkpoint").alias("checkpoint"))
    names = [fixed.CONFIG_FILE, *fixed.MODEL_FILES, *fixed.OPTIONAL_FILES]
    wanted = files.filter(F.col("file").isin(*names)).join(source, ["adapter", "checkpoint"])
    per_file = wanted.groupBy("adapter", "checkpoint", "file").agg(F.max("length").alias("length"))
    # At most one row per known file name and checkpoint.
    group = Window.partitionBy("adapter", "checkpoint")
    first_form = F.max(F.col("file") == fixed.MODEL_FILES[0]).over(group)
    return (
        per_file.withColumn("_first_form", first_form)
        .filter((F.col("file") != fixed.MODEL_FILES[1]) | ~F.col("_first_form"))
        .drop("_first_form")
    )


def retained(validity: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` checkpoints of every adapter.

    A rank filter, which Spark already applies before the shuffle, so at most
    ``keep`` rows per adapter and input partition move.
    """
    order = Window.partitionBy("adapter").orderBy(F.desc("number"))
    ranked = validity.filter(F.col("number").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= keep).select("adapter", "checkpoint", "rank")
