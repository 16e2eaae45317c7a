"""Whole flows (evaluation and conversation flows are ``run_summary`` and ``converse``)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from corvane.plans.prepare import PrepareOptions, prepare
from suite.inputs import RENDERED_SQL, WORDS, WS, record_lines
from suite.registry import query

OPTIONS = PrepareOptions(max_length=512, eval_ratio=0.05, vocab_size=3000, batch_size=16, permissive=True)

FLOW_SQL = (
    RENDERED_SQL
    + f""",
usable AS (
  SELECT doc_id, text FROM rendered WHERE shape IN (0, 1, 2, 3, 4, 6) AND length(trim(text, {WS})) > 0
),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS r, COUNT(*) OVER () AS n FROM usable),
split AS (
  SELECT doc_id, CASE WHEN r <= ceil(0.05 * n) THEN 'eval' ELSE 'train' END AS split,
    regexp_extract_all(text, {WORDS}) AS tokens
  FROM ranked
),
counts AS (
  SELECT token, COUNT(*) AS rows FROM (SELECT unnest(tokens) AS token FROM split WHERE split = 'train') GROUP BY token
),
vocab AS (
  SELECT token, row_number() OVER (ORDER BY rows DESC, token) + 1 AS token_id
  FROM counts ORDER BY rows DESC, token LIMIT 3000
),
pieces AS (
  SELECT doc_id, split, unnest(tokens[1:512]) AS token, generate_subscripts(tokens[1:512], 1) AS pos FROM split
),
encoded AS (
  SELECT doc_id, split, list(coalesce(token_id, 1) ORDER BY pos) AS ids
  FROM pieces LEFT JOIN vocab USING (token) GROUP BY doc_id, split
),
sized AS (SELECT doc_id, split, ids, len(ids) AS n_ids FROM encoded),
total AS (SELECT split, COUNT(*) AS n, least(greatest(COUNT(*) // 64, 1), 50) AS m FROM sized GROUP BY split),
bucketed AS (
  SELECT t.*, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT
    % greatest(CAST(ceil(n / (m * 16)) AS BIGINT), 1) AS bucket
  FROM sized t JOIN total USING (split)
),
batched AS (
  SELECT *, (row_number() OVER (PARTITION BY split, bucket ORDER BY n_ids DESC, md5('42:' || doc_id)) - 1) // 16 AS batch
  FROM bucketed
),
padded AS (
  SELECT *, CAST(ceil(max(n_ids) OVER (PARTITION BY split, bucket, batch) / 64) * 64 AS INTEGER) AS pad_len FROM batched
)"""
)


@query(
    f"""WITH {FLOW_SQL} SELECT doc_id, bucket, batch, pad_len,
      array_to_string(ids, ' ') || repeat(' -100', pad_len - n_ids) AS labels FROM padded WHERE split = 'train'"""
)
def prepared_batches(spark, sf):
    return _labelled(prepare(record_lines(spark, sf), "doc_id", OPTIONS).batches)


@query(
    f"""WITH {FLOW_SQL} SELECT doc_id, bucket, batch, pad_len,
      array_to_string(ids, ' ') || repeat(' -100', pad_len - n_ids) AS labels FROM padded WHERE split = 'eval'"""
)
def prepared_eval_batches(spark, sf):
    return _labelled(prepare(record_lines(spark, sf), "doc_id", OPTIONS).eval_batches)


@query(
    f"""WITH {RENDERED_SQL} SELECT doc_id, text FROM rendered WHERE length(trim(text, {WS})) > 0"""
)
def prepared_all_shapes(spark, sf):
    """Ordinary ingest: conversations and unknown shapes are examples too."""
    done = prepare(record_lines(spark, sf), "doc_id", replace(OPTIONS, permissive=False))
    return done.examples.select("doc_id", "text")


def _labelled(rows):
    labels = F.array_join(F.col("labels").cast("array<string>"), " ")
    return rows.select("doc_id", "bucket", "batch", "pad_len", labels.alias("labels"))


@query(f"WITH {FLOW_SQL} SELECT doc_id, split, array_to_string(ids, ' ') AS input_ids FROM encoded")
def prepared_tokens(spark, sf):
    rows = prepare(record_lines(spark, sf), "doc_id", OPTIONS).tokenized
    return rows.select(
        "doc_id", "split", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids")
    )
