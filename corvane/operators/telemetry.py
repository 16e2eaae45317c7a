"""Training metrics ``(run, step, metric, value)``: best step, early stop, loss gap.

``step`` is a whole number, unique per run and metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corvane.functions import fixed
from corvane.operators.ordered import CHUNK, Running, running, sparse_chunks


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """``(ts, level, step, metric, value)`` from log lines, a row per metric.

    Lines of other kinds and values that are not numbers give no row.
    """
    text = F.col(line)
    level = F.rtrim(F.substring_index(F.substr(text, F.lit(len(fixed.LOG_TIME) + 4)), " |", 1))
    steps = lines.filter(text.rlike(fixed.STEP_LINE)).select(
        *[c for c in lines.columns if c != line],
        F.to_timestamp(F.substring(text, 1, len(fixed.LOG_TIME)), fixed.LOG_TIME).alias("ts"),
        level.alias("level"),
        F.regexp_extract(text, fixed.STEP_LINE, 1).cast("long").alias("step"),
        F.explode(F.split(F.regexp_extract(text, fixed.STEP_LINE, 2), ", ")).alias("field"),
    )
    value = F.expr("try_cast(substring_index(field, ': ', -1) AS DOUBLE)")
    return (
        steps.withColumn("metric", F.substring_index("field", ": ", 1))
        .withColumn("value", value)
        .drop("field")
        .filter(F.col("value").isNotNull())
    )


def best_step(metrics: DataFrame, metric: str, lower: bool = True, by: Sequence[str] = ("run",)) -> DataFrame:
    """Step and value of the best evaluation; the earliest of equal ones."""
    sign = 1 if lower else -1
    rank = F.struct((F.col("value") * sign).alias("v"), F.col("step"))
    found = (
        metrics.filter(F.col("metric") == metric)
        .groupBy(*by)
        .agg(F.min_by(F.struct("step", "value"), rank).alias("best"))
    )
    return found.select(*by, F.col("best.step").alias("best_step"), F.col("best.value").alias("best_value"))


def early_stop(
    metrics: DataFrame,
    metric: str,
    patience: int = 3,
    threshold: float = 0.0,
    lower: bool = True,
    by: Sequence[str] = ("run",),
    size: int = CHUNK,
) -> DataFrame:
    """First step at which ``patience`` evaluations in a row brought no gain
    above ``threshold`` over the best value before them; NULL if none.

    Steps may be any distance apart and runs of any length. The metric's rows are
    stored in chunks first, so the metrics themselves are read twice.
    """
    sign = 1 if lower else -1
    rows = metrics.filter(F.col("metric") == metric).select(*by, "step", (F.col("value") * sign).alias("_v"))
    rows = running(
        sparse_chunks(rows, by, "step", size),
        by,
        "step",
        {
            "_best": Running("min", F.col("_v"), before=True),
            "_index": Running("sum", F.lit(1).cast("long")),
        },
        size,
    )
    gain = F.col("_best").isNull() | (
        (F.col("_v") < F.col("_best")) & (F.abs(F.col("_v") - F.col("_best")) > threshold)
    )
    rows = running(rows, by, "step", {"_last_gain": Running("max", F.when(gain, F.col("_index")))})
    waited = F.col("_index") - F.col("_last_gain")
    stop = F.min(F.when(waited >= patience, F.col("step")))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("evaluations"), stop.alias("stop_step"))


def loss_gap(
    metrics: DataFrame,
    limit: float = 0.5,
    train: str = "loss",
    evaluation: str = "eval_loss",
    by: Sequence[str] = ("run",),
    size: int = CHUNK,
) -> DataFrame:
    """Per evaluation: its loss minus the last training loss so far, and a flag."""
    both = metrics.filter(F.col("metric").isin(train, evaluation))
    rows = both.groupBy(*by, "step").agg(
        F.max(F.when(F.col("metric") == train, F.col("value"))).alias("_train"),
        F.max(F.when(F.col("metric") == evaluation, F.col("value"))).alias("eval_loss"),
    )
    rows = sparse_chunks(rows, by, "step", size)
    rows = running(rows, by, "step", {"train_loss": Running("last", F.col("_train"))})
    gap = F.col("eval_loss") - F.col("train_loss")
    return rows.filter(F.col("eval_loss").isNotNull()).select(
        *by, "step", "train_loss", "eval_loss", gap.alias("gap"), F.coalesce(gap > limit, F.lit(False)).alias("overfit")
    )
