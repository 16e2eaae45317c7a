"""Adapter listings and training telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators.artifacts import (
    artifact_report as report,
    artifact_validity as validity_of,
    latest_checkpoint as latest,
    parse_listing,
    repair_plan as plan,
    resolved_artifact as resolved,
    retained,
)
from corvane.operators.telemetry import (
    best_step as best,
    early_stop as stop,
    loss_gap as gap,
    parse_log,
)
from suite.inputs import LISTING_SQL, LOG_SQL, METRICS_SQL, listing, log_lines, metric_rows
from suite.registry import query



def _files(spark, sf):
    return parse_listing(listing(spark, sf), "adapters")


def _validity(spark, sf):
    return validity_of(_files(spark, sf))


@query(f"WITH {LISTING_SQL} SELECT adapter, checkpoint, has_config, has_model, valid, bytes FROM v")
def artifact_validity(spark, sf):
    return _validity(spark, sf).drop("number", "reason")


@query(
    f"""WITH {LISTING_SQL} SELECT adapter, CASE WHEN root_config THEN 'root' WHEN latest_config THEN latest END AS source
    FROM per_adapter"""
)
def latest_checkpoint(spark, sf):
    return latest(_validity(spark, sf))


@query(
    f"""WITH {LISTING_SQL} SELECT adapter, CASE WHEN root_valid THEN 'root' ELSE latest_valid END AS source
    FROM per_adapter"""
)
def resolved_artifact(spark, sf):
    return resolved(_validity(spark, sf))


@query(
    f"""WITH {LISTING_SQL} SELECT adapter, CASE WHEN root_valid THEN 'valid' WHEN checkpoints > 0 THEN 'needs_fix'
      ELSE 'no_checkpoints' END AS status, latest FROM per_adapter"""
)
def artifact_report(spark, sf):
    return report(_validity(spark, sf))


@query(
    f"""WITH {LISTING_SQL}, source AS (SELECT adapter, latest AS checkpoint FROM per_adapter WHERE NOT root_valid AND latest_ok),
    named AS (SELECT f.adapter, s.checkpoint, f.file, MAX(f.length) AS length FROM files f
      JOIN source s ON f.adapter = s.adapter AND s.checkpoint = 'checkpoint-' || f.number GROUP BY ALL)
    SELECT adapter, checkpoint, file, length FROM named n WHERE file <> 'adapter_model.bin' OR NOT EXISTS (
      SELECT 1 FROM named m WHERE m.adapter = n.adapter AND m.file = 'adapter_model.safetensors')"""
)
def repair_plan(spark, sf):
    files = _files(spark, sf)
    return plan(files, validity_of(files))


@query(
    f"""WITH {LISTING_SQL}, r AS (SELECT adapter, checkpoint,
      CAST(row_number() OVER (PARTITION BY adapter ORDER BY number DESC) AS INTEGER) AS rank FROM v WHERE number IS NOT NULL)
    SELECT adapter, checkpoint, rank FROM r WHERE rank <= 3"""
)
def retained_checkpoints(spark, sf):
    return retained(_validity(spark, sf), 3)


@query(
    f"""WITH {METRICS_SQL}, r AS (SELECT run, step, value, row_number() OVER (PARTITION BY run ORDER BY value, step) AS i
      FROM metrics WHERE metric = 'eval_loss')
    SELECT run, step AS best_step, value AS best_value FROM r WHERE i = 1"""
)
def best_step(spark, sf):
    return best(metric_rows(spark, sf), "eval_loss")


EARLY_STOP_SQL = f"""WITH {METRICS_SQL}, e AS (SELECT run, step, value,
        MIN(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best,
        row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM metrics WHERE metric = 'eval_loss'),
    g AS (SELECT *, MAX(CASE WHEN best IS NULL OR best - value > 0.001 THEN i END)
        OVER (PARTITION BY run ORDER BY step) AS last_gain FROM e)
    SELECT run, COUNT(*) AS evaluations, MIN(CASE WHEN i - last_gain >= 3 THEN step END) AS stop_step FROM g GROUP BY run"""


@query(EARLY_STOP_SQL)
def early_stop(spark, sf):
    return stop(metric_rows(spark, sf), "eval_loss", 3, 0.001)


@query(
    f"""WITH {METRICS_SQL}, m AS (SELECT run, step, value, metric,
        last_value(CASE WHEN metric = 'loss' THEN value END IGNORE NULLS) OVER (PARTITION BY run ORDER BY step) AS train_loss
      FROM metrics)
    SELECT run, step, train_loss, value AS eval_loss, round(value - train_loss, 6) AS gap,
      coalesce(value - train_loss > 0.5, false) AS overfit FROM m WHERE metric = 'eval_loss'"""
)
def loss_gap(spark, sf):
    return gap(metric_rows(spark, sf)).withColumn("gap", F.round("gap", 6))


@query(f"WITH {LOG_SQL} SELECT run, ts, 'INFO' AS level, step, metric, value FROM log_metrics")
def log_metrics(spark, sf):
    rows = parse_log(log_lines(spark, sf))
    return rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
