"""Early stopping while training logs arrive."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.streaming.history import STORE
from corvane.streaming.sinks import batches_below, write_batch

STATE = "best double, best_step long, waited long, evaluations long, stop_step long, last_step long, late long"
OUTPUT = (
    "run string, evaluations long, stop_step long, best_step long, best_value double, last_step long, late long"
)


def below(value: float, other: float) -> bool:
    """Whether a value is less than another one, NaN being above all others."""
    return value < other or (math.isnan(other) and not math.isnan(value))


class Patience(StatefulProcessor):
    """Counts the evaluations of a run since the last gain; a state of fixed size per run."""

    def __init__(self, patience: int, threshold: float, lower: bool):
        self.patience, self.threshold, self.sign = patience, threshold, 1 if lower else -1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("patience", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best, best_step, waited, count, stop, last, late = (
            self.state.get() if self.state.exists() else (None, None, 0, 0, None, None, 0)
        )
        for step, value in sorted((r.step, r.value) for r in rows):
            if last is not None and step <= last:
                late += 1
                continue
            value, last, count = value * self.sign, step, count + 1
            gain = best is None or (below(value, best) and not abs(value - best) <= self.threshold)
            waited = 0 if gain else waited + 1
            if best is None or below(value, best):
                best, best_step = value, step
            if waited >= self.patience and stop is None:
                stop = step
        self.state.update((best, best_step, waited, count, stop, last, late))
        value = None if best is None else best * self.sign
        yield Row(
            run=key[0], evaluations=count, stop_step=stop, best_step=best_step, best_value=value, last_step=last, late=late
        )

    def close(self) -> None:
        pass


def stream_early_stop(
    metrics: DataFrame, metric: str, patience: int = 3, threshold: float = 0.0, lower: bool = True
) -> DataFrame:
    """``run, evaluations, stop_step, best_step, best_value, last_step, late`` of every run with news, in update mode.

    ``metrics`` has ``run, step, metric, value``. After every trigger the row of a
    run equals that of ``early_stop`` and ``best_step`` over all that has arrived,
    as long as a trigger brings no step at or below an earlier trigger's last one:
    such rows (a rotated log's repeats) change nothing but the count ``late``.
    Rows without a step or a value are left out. Only one trigger's rows of a run
    are held. Such state needs Spark's RocksDB store, which this sets for the session.
    """
    metrics.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = metrics.filter(F.col("metric") == metric).select(
        F.col("run").cast("string").alias("run"), F.col("step").cast("long").alias("step"), "value"
    )
    rows = rows.filter(F.col("step").isNotNull() & F.col("value").isNotNull())
    return rows.groupBy("run").transformWithState(Patience(patience, threshold, lower), OUTPUT, "update", "None")


def keep_current(changes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing changed rows below a folder, a folder per trigger; a replayed trigger replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        write_batch(batch, path, number)

    writer = changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def current(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """The table as it stands: every key's row of the latest trigger that changed it."""
    rows = batches_below(spark, path)
    names = [c for c in rows.columns if c not in (*key, "batch")]
    latest = F.max_by(F.struct(*names), "batch").alias("row")
    return rows.groupBy(*key).agg(latest).select(*key, "row.*")
