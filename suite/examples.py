"""Ingest, rendering, evaluation pairs, sampling, splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import records as R
from corvane.functions import text as T
from corvane.operators.examples import eval_pairs as to_pairs
from corvane.operators.examples import min_chars, nonempty_pairs, render, validate
from corvane.operators.ingest import canonical as to_canonical
from corvane.operators.ingest import ingest, reject_sample as first_rejects, with_record
from corvane.operators.sampling import (
    head_n as first_n,
    sample_n,
    sample_n_by,
    split_report as report,
    train_eval_split as split_rows,
)
from corvane.session import staged
from suite.inputs import (
    PAIRS_SQL,
    RECORDS_SQL,
    RENDERED_SQL,
    WS,
    dialog_pairs,
    load,
    predictions,
    record_lines,
    records,
)
from suite.registry import query


def _rec():
    return F.col("record")


@query(f"WITH {RENDERED_SQL} SELECT doc_id, text FROM rendered WHERE shape IN (0, 1, 2, 3, 4, 6)")
def ingest_good(spark, sf):
    return render(ingest(record_lines(spark, sf)).good, "doc_id")


REJECTS_SQL = (
    RECORDS_SQL
    + """,
rejects AS (
  SELECT doc_id, CASE WHEN shape = 9 THEN 'malformed' ELSE 'no_known_shape' END AS reason
  FROM d WHERE shape IN (5, 7, 8, 9)
)"""
)


@query(f"WITH {REJECTS_SQL} SELECT doc_id, reason FROM rejects")
def ingest_rejects(spark, sf):
    return ingest(record_lines(spark, sf)).rejects.select("doc_id", "reason")


@query(
    f"""WITH {RECORDS_SQL} SELECT COUNT(*) AS total_rows,
      COUNT(*) FILTER (WHERE shape NOT IN (5, 7, 8, 9)) AS valid_rows,
      COUNT(*) FILTER (WHERE shape IN (5, 7, 8, 9)) AS skipped_rows FROM d"""
)
def ingest_counts(spark, sf):
    return ingest(record_lines(spark, sf)).counts


@query(
    f"""WITH {RECORDS_SQL} SELECT doc_id,
      CASE shape WHEN 2 THEN h END AS prompt, CASE shape WHEN 2 THEN t END AS completion,
      CASE shape WHEN 0 THEN source WHEN 1 THEN text END AS instruction,
      CASE shape WHEN 0 THEN text WHEN 3 THEN h END AS input,
      CASE shape WHEN 0 THEN lang WHEN 3 THEN t END AS output,
      CASE shape WHEN 1 THEN source END AS response,
      CASE shape WHEN 4 THEN 'system=' || source || '|user=' || h || '|assistant=' || t END AS messages,
      CASE shape WHEN 6 THEN b END AS text
    FROM d WHERE shape IN (0, 1, 2, 3, 4, 6)"""
)
def canonical(spark, sf):
    typed = to_canonical(ingest(record_lines(spark, sf)).good)
    shown = F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return typed.withColumn("messages", F.array_join(shown, "|"))


@query(f"WITH {REJECTS_SQL} SELECT doc_id, reason FROM rejects ORDER BY doc_id LIMIT 5")
def reject_sample(spark, sf):
    return first_rejects(ingest(record_lines(spark, sf)).rejects, "doc_id").select("doc_id", "reason")


@query(
    f"""WITH {RECORDS_SQL} SELECT doc_id, CASE shape WHEN 0 THEN 'instruction' WHEN 1 THEN 'instruction'
      WHEN 2 THEN 'prompt_completion' WHEN 3 THEN 'input_output' WHEN 4 THEN 'messages'
      WHEN 5 THEN 'conversation' WHEN 6 THEN 'text' ELSE 'other' END AS shape,
      shape NOT IN (5, 7, 8) AS accepted
    FROM d WHERE shape <> 9"""
)
def classify_shape(spark, sf):
    return records(spark, sf).select(
        "doc_id", R.classify_shape(_rec()).alias("shape"), R.accepted(_rec()).alias("accepted")
    )


def _docs(spark, sf):
    """Documents with their halves."""
    docs = load(spark, sf, "documents").withColumn("half", T.halves(F.col("text")))
    return docs.select("*", F.col("half.prompt").alias("h"), F.col("half.reference").alias("t"))


def _rendered(expression):
    return f"WITH {RECORDS_SQL} SELECT doc_id, {expression} AS text FROM d"


@query(
    _rendered(
        """E'### Instruction:\\n' || source || E'\\n'
      || CASE WHEN lang = 'es' THEN '' ELSE E'\\n### Input:\\n' || text || E'\\n' END
      || CASE WHEN lang = 'fr' THEN '' ELSE E'\\n### Response:\\n' || lang END"""
    )
)
def render_instruction(spark, sf):
    lang = F.col("lang")
    given = F.when(lang == "es", F.lit("")).otherwise(F.col("text"))
    text = R.render_instruction(F.col("source"), given, F.when(lang != "fr", lang))
    return _docs(spark, sf).select("doc_id", text.alias("text"))


@query(_rendered("E'### Prompt:\\n' || h || E'\\n\\n### Response:\\n' || t"))
def render_prompt_completion(spark, sf):
    text = R.render_prompt_completion(F.col("h"), F.col("t"))
    return _docs(spark, sf).select("doc_id", text.alias("text"))


@query(_rendered("E'### Input:\\n' || h || E'\\n\\n### Output:\\n' || t"))
def render_input_output(spark, sf):
    text = R.render_input_output(F.col("h"), F.col("t"))
    return _docs(spark, sf).select("doc_id", text.alias("text"))


@query(
    _rendered(
        f"""trim(E'### System:\\n' || source || E'\\n\\n### Tool_Call:\\n' || h
      || E'\\n\\n### Unknown:\\n' || t, {WS})"""
    )
)
def render_messages(spark, sf):
    parts = [("system", "source"), ("tool_call", "h"), (None, "t")]
    messages = F.array(
        *[F.struct(F.lit(r).cast("string").alias("role"), F.col(c).alias("content")) for r, c in parts]
    )
    return _docs(spark, sf).select("doc_id", R.render_messages(messages).alias("text"))


@query(_rendered("E'### Turn 1:\\n' || h || E'\\n\\n### Turn 2:\\n' || t"))
def render_conversation(spark, sf):
    text = R.render_conversation(F.array("h", "t"))
    return _docs(spark, sf).select("doc_id", text.alias("text"))


@query(_rendered("text"))
def render_text(spark, sf):
    return _docs(spark, sf).select("doc_id", R.render_text(F.col("text")).alias("text"))


@query(_rendered("'title:' || source || ' body:' || text || ' doc_id:' || doc_id"))
def render_fallback(spark, sf):
    line = F.to_json(F.struct(F.col("source").alias("title"), F.col("text").alias("body"), "doc_id"))
    parsed = with_record(load(spark, sf, "documents").select("doc_id", line.alias("line")))
    return parsed.select("doc_id", R.render_fallback(_rec()).alias("text"))


@query(f"WITH {RENDERED_SQL} SELECT doc_id, text FROM rendered")
def render_all(spark, sf):
    return render(records(spark, sf), "doc_id")


@query(
    f"""WITH {RENDERED_SQL} SELECT r.doc_id,
      CASE r.shape WHEN 1 THEN r.text || E'\\n### Response:\\n' || d.source ELSE r.text END AS text
    FROM rendered r JOIN d USING (doc_id)"""
)
def render_with_response(spark, sf):
    return render(records(spark, sf), "doc_id", answer_keys=("output", "response"))


EVAL_SQL = (
    RECORDS_SQL
    + """,
evals AS (
  SELECT doc_id,
    CASE shape WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN h WHEN 3 THEN h WHEN 4 THEN '' WHEN 5 THEN ''
      WHEN 6 THEN substr(b, 1, length(b) // 2) WHEN 7 THEN h WHEN 8 THEN source END AS prompt,
    CASE shape WHEN 0 THEN lang WHEN 1 THEN '' WHEN 2 THEN t WHEN 3 THEN t
      WHEN 4 THEN CAST(to_json([{'role': 'system', 'content': source}, {'role': 'user', 'content': h},
        {'role': 'assistant', 'content': t}]) AS VARCHAR)
      WHEN 5 THEN CAST(to_json([h, t]) AS VARCHAR)
      WHEN 6 THEN substr(b, length(b) // 2 + 1) WHEN 7 THEN t WHEN 8 THEN text END AS reference
  FROM d WHERE shape <> 9
)"""
)


@query(f"WITH {EVAL_SQL} SELECT * FROM evals")
def eval_pairs(spark, sf):
    return to_pairs(records(spark, sf), "doc_id")


@query(f"WITH {EVAL_SQL} SELECT * FROM evals WHERE prompt <> '' AND reference <> ''")
def eval_nonempty(spark, sf):
    return nonempty_pairs(to_pairs(records(spark, sf), "doc_id"))


@query(
    """SELECT doc_id, substr(text, 1, length(text) // 2) AS prompt,
      substr(text, length(text) // 2 + 1) AS reference FROM documents"""
)
def text_halves(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", T.halves(F.col("text")).alias("half"))
    return docs.select("doc_id", "half.prompt", "half.reference")


@query(
    """SELECT conv_id, turn, E'### Instruction:\\n' || text || E'\\n\\n### Response:\\n' AS prompt
    FROM conversations WHERE role = 'user'"""
)
def wrap_prompt(spark, sf):
    users = load(spark, sf, "conversations").filter(F.col("role") == "user")
    return users.select("conv_id", "turn", T.wrap_prompt(F.col("text")).alias("prompt"))


@query(f"WITH {PAIRS_SQL} SELECT example_id, reference AS response FROM pairs")
def extract_response(spark, sf):
    pairs = dialog_pairs(spark, sf).withColumn("sent", T.wrap_prompt(F.col("prompt")))
    decoded = F.concat(F.col("sent"), F.lit(" \n"), F.col("reference"), F.lit("\n"))
    return pairs.select("example_id", T.extract_response(decoded, F.col("sent")).alias("response"))


@query(
    """SELECT doc_id, CASE WHEN lang = 'es' THEN 'run-' || doc_id
      WHEN lang = 'en' THEN 'base-7b_base_' || source || '_train'
      ELSE 'base-7b_with_' || lang || '_' || source || '_' || source || '_train' END AS run_name
    FROM documents"""
)
def run_name(spark, sf):
    lang, source = F.col("lang"), F.col("source")
    adapters = F.when(lang == "en", F.array().cast("array<string>")).otherwise(F.array(lang, source))
    override = F.when(lang == "es", F.concat(F.lit("run-"), F.col("doc_id").cast("string")))
    name = T.run_name(F.lit("base-7b"), adapters, source, F.lit("train"), override)
    return load(spark, sf, "documents").select("doc_id", name.alias("run_name"))


VALID_SQL = RENDERED_SQL + f", valid AS (SELECT doc_id, shape, text FROM rendered WHERE length(trim(text, {WS})) > 0)"


def _valid(spark, sf, max_length=1536):
    return validate(render(records(spark, sf), "doc_id"), max_length)


def _stored(spark, sf):
    return staged(_valid(spark, sf), "examples")


@query(f"WITH {VALID_SQL} SELECT doc_id, text FROM valid")
def valid_examples(spark, sf):
    return _valid(spark, sf).select("doc_id", "text")


@query(f"WITH {VALID_SQL} SELECT doc_id, length(text) > 3200 AS overlong FROM valid")
def overlong_flag(spark, sf):
    return _valid(spark, sf, 320).select("doc_id", "overlong")


@query(
    f"""WITH {PAIRS_SQL} SELECT run_id, example_id, prediction FROM preds
    WHERE length(trim(prediction, {WS})) >= 5"""
)
def ppl_candidates(spark, sf):
    return min_chars(predictions(spark, sf), "prediction", 5)


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def head_n(spark, sf):
    return first_n(load(spark, sf, "documents"), "doc_id", 50).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('42:' || doc_id) LIMIT 300")
def seeded_sample(spark, sf):
    return sample_n(load(spark, sf, "documents"), "doc_id", 300, 42).select("doc_id", "lang", "n_chars")


@query(
    f"""WITH {PAIRS_SQL}, keyed AS (
      SELECT run_id, run_id || ':' || example_id AS text_id, prediction FROM preds
      WHERE length(trim(prediction, {WS})) >= 5),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY md5('7:' || text_id)) AS r FROM keyed)
    SELECT run_id, text_id, prediction FROM ranked WHERE r <= 128"""
)
def ppl_sample(spark, sf):
    texts = min_chars(predictions(spark, sf), "prediction", 5)
    keyed = texts.withColumn("text_id", F.concat_ws(":", "run_id", F.col("example_id").cast("string")))
    return sample_n_by(keyed, ["run_id"], "text_id", 128, 7).select("run_id", "text_id", "prediction")


SPLIT_SQL = (
    VALID_SQL
    + """,
numbered AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS r, COUNT(*) OVER () AS n FROM valid
),
splits AS (SELECT doc_id, CASE WHEN r <= ceil(0.05 * n) THEN 'eval' ELSE 'train' END AS split FROM numbered)"""
)


@query(f"WITH {SPLIT_SQL} SELECT doc_id, split FROM splits")
def train_eval_split(spark, sf):
    return split_rows(_stored(spark, sf), "doc_id", 0.05, 42).select("doc_id", "split")


@query(
    f"""WITH {SPLIT_SQL} SELECT split, COUNT(*) AS examples,
      round(100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS percent,
      COUNT(*) * 1000 / 1e6::DOUBLE AS est_tokens_m FROM splits GROUP BY split"""
)
def split_report(spark, sf):
    return report(split_rows(_stored(spark, sf), "doc_id", 0.05, 42)).withColumn(
        "percent", F.round("percent", 6)
    )
