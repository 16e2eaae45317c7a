"""Tokenization, vocabulary, batches, length statistics, bigram model."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators.batches import (
    batch_plan as plan,
    length_batches as group_lengths,
    lm_labels as labels_of,
    pad_batches as pad,
)
from corvane.operators.ngram import fit_ngram, ngram_nll as score_texts
from corvane.operators.predict import embed_tokens as add_vectors
from corvane.operators.predict import predict as run_predictor
from corvane.operators.stats import length_stats as stats_of
from corvane.operators.stats import perplexity as perplexity_of
from corvane.operators.tokens import encode as encode_tokens
from corvane.operators.tokens import fit_vocab, tokenize as split_tokens, tokenize_with
from corvane.plans.evaluate import text_perplexity
from corvane.session import staged
from suite.inputs import PAIRS_SQL, WORDS, WS, dialog_pairs, load, predictions
from suite.registry import query

VOCAB = 2000  # size of the fitted vocabulary

TOKENS_SQL = f"""
tok AS (SELECT doc_id, lang, regexp_extract_all(text, {WORDS}) AS tokens FROM documents)"""
VOCAB_SQL = (
    TOKENS_SQL
    + f""",
counts AS (SELECT token, COUNT(*) AS rows FROM (SELECT unnest(tokens) AS token FROM tok) GROUP BY token),
vocab AS (
  SELECT token, rows, CAST(row_number() OVER (ORDER BY rows DESC, token) + 1 AS INTEGER) AS token_id
  FROM counts ORDER BY rows DESC, token LIMIT {VOCAB}
)"""
)


def encoded_sql(cut: int | None) -> str:
    kept = "tokens" if cut is None else f"tokens[1:{cut}]"
    return (
        VOCAB_SQL
        + f""",
pieces AS (
  SELECT doc_id, unnest({kept}) AS token, generate_subscripts({kept}, 1) AS pos FROM tok
),
encoded AS (
  SELECT p.doc_id, list(coalesce(v.token_id, 1) ORDER BY p.pos) AS ids
  FROM pieces p LEFT JOIN vocab v USING (token) GROUP BY p.doc_id
)"""
    )


BATCH_SQL = (
    encoded_sql(None)
    + """,
sized AS (SELECT doc_id, ids, len(ids) AS n_ids FROM encoded),
total AS (SELECT COUNT(*) AS n, least(greatest(COUNT(*) // 64, 1), 50) AS m FROM sized),
bucketed AS (
  SELECT s.*, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT
    % greatest(CAST(ceil(n / (m * 16)) AS BIGINT), 1) AS bucket
  FROM sized s, total
),
batched AS (
  SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY n_ids DESC, md5('42:' || doc_id)) - 1) // 16 AS batch
  FROM bucketed
),
padded AS (
  SELECT *, CAST(ceil(max(n_ids) OVER (PARTITION BY bucket, batch) / 64) * 64 AS INTEGER) AS pad_len FROM batched
)"""
)


def _docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "lang", "text")


def _encoded(spark, sf, cut):
    docs = _docs(spark, sf)
    vocab = fit_vocab(split_tokens(docs, None), VOCAB)
    return encode_tokens(split_tokens(docs, cut), vocab)


def _batched(spark, sf):
    ids = _encoded(spark, sf, None).select("doc_id", "input_ids")
    return group_lengths(staged(ids, "ids"), "doc_id", 16)


def _joined(name):
    return F.array_join(F.col(name).cast("array<string>"), " ")


@query(
    f"""WITH {TOKENS_SQL} SELECT doc_id, array_to_string(tokens[1:1536], ' ') AS tokens,
      CAST(len(tokens) AS INTEGER) AS n_tokens, CAST(least(len(tokens), 1536) AS INTEGER) AS mask_sum FROM tok"""
)
def tokenize(spark, sf):
    cut = split_tokens(_docs(spark, sf), 1536)
    return cut.select(
        "doc_id",
        F.array_join("tokens", " ").alias("tokens"),
        "n_tokens",
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
    )


@query(
    """SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')[1:512],
      lambda w: CAST(length(w) AS VARCHAR)), ' ') AS input_ids,
      CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) AS INTEGER) AS n_tokens FROM documents"""
)
def tokenize_custom(spark, sf):
    def make_encoder():
        import re

        words = re.compile(r"[^ \t\n\x0b\f\r]+")
        return lambda texts: [[len(w) for w in words.findall(t)] for t in texts]

    out = tokenize_with(_docs(spark, sf).select("doc_id", "text"), make_encoder, 512)
    return out.select("doc_id", _joined("input_ids").alias("input_ids"), "n_tokens")


@query(f"WITH {VOCAB_SQL} SELECT token, rows, token_id FROM vocab")
def vocab(spark, sf):
    return fit_vocab(split_tokens(_docs(spark, sf), None), VOCAB)


@query(f"WITH {encoded_sql(None)} SELECT doc_id, array_to_string(ids, ' ') AS input_ids FROM encoded")
def encode(spark, sf):
    return _encoded(spark, sf, None).select("doc_id", _joined("input_ids").alias("input_ids"))


@query(f"WITH {BATCH_SQL} SELECT doc_id, bucket, batch, CAST(n_ids AS INTEGER) AS n_ids FROM batched")
def length_batches(spark, sf):
    return _batched(spark, sf).select("doc_id", "bucket", "batch", "n_ids")


@query(
    f"""WITH {BATCH_SQL} SELECT doc_id, pad_len,
      array_to_string(ids, ' ') || repeat(' 0', pad_len - n_ids) AS padded_ids,
      CAST(n_ids AS INTEGER) AS mask_sum FROM padded"""
)
def pad_batches(spark, sf):
    return pad(_batched(spark, sf)).select(
        "doc_id",
        "pad_len",
        _joined("padded_ids").alias("padded_ids"),
        F.aggregate("padded_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
    )


@query(
    f"""WITH {BATCH_SQL} SELECT doc_id,
      array_to_string(ids, ' ') || repeat(' -100', pad_len - n_ids) AS labels FROM padded"""
)
def lm_labels(spark, sf):
    rows = pad(_batched(spark, sf)).withColumn("labels", labels_of(F.col("padded_ids")))
    return rows.select("doc_id", _joined("labels").alias("labels"))


@query(
    f"""WITH {BATCH_SQL}, per_batch AS (
      SELECT bucket, batch, COUNT(*) AS rows, SUM(n_ids) AS ids, SUM(pad_len) AS slots FROM padded
      GROUP BY bucket, batch)
    SELECT CAST(SUM(rows) AS BIGINT) AS examples, COUNT(*) AS batches, 64 AS effective_batch,
      CAST(ceil(COUNT(*) / 4) AS BIGINT) AS steps_per_epoch, round(1 - SUM(ids) / SUM(slots), 6) AS padding_share
    FROM per_batch"""
)
def batch_plan(spark, sf):
    out = plan(pad(_batched(spark, sf)), 16, 4)
    return out.withColumn("padding_share", F.round("padding_share", 6))


LENGTH_SQL = (
    TOKENS_SQL
    + """,
sizes AS (SELECT lang, len(tokens) AS n FROM tok),
placed AS (
  SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n) - 1 AS i, COUNT(*) OVER (PARTITION BY lang) AS c
  FROM sizes
)"""
)


@query(
    f"""WITH {LENGTH_SQL} SELECT lang, COUNT(*) AS n, round(SUM(n) / COUNT(*), 6) AS mean_len,
      CAST(MAX(CASE WHEN i = c // 2 THEN n END) AS INTEGER) AS median_len,
      CAST(MAX(CASE WHEN i = CAST(floor(c * 0.95::DOUBLE) AS BIGINT) THEN n END) AS INTEGER) AS p95_len
    FROM placed GROUP BY lang"""
)
def length_stats(spark, sf):
    out = stats_of(split_tokens(_docs(spark, sf), None), "n_tokens", ["lang"])
    return out.withColumn("mean_len", F.round("mean_len", 6))


@query(
    """WITH placed AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, COUNT(*) OVER () AS c FROM documents)
    SELECT COUNT(*) AS n, round(SUM(n_chars) / COUNT(*), 6) AS mean_len,
      MAX(CASE WHEN i = c // 2 THEN n_chars END) AS median_len,
      MAX(CASE WHEN i = CAST(floor(c * 0.95::DOUBLE) AS BIGINT) THEN n_chars END) AS p95_len FROM placed"""
)
def length_stats_all(spark, sf):
    out = stats_of(load(spark, sf, "documents"), "n_chars")
    return out.withColumn("mean_len", F.round("mean_len", 6))


NGRAM_SQL = f"""
corpus AS (SELECT doc_id AS id, regexp_extract_all(lower(text), {WORDS}) AS tokens FROM documents),
grams AS (
  SELECT unnest(list_concat(['<s>'], tokens[:-2])) AS w1, unnest(tokens) AS w2 FROM corpus WHERE len(tokens) > 0
),
pair_counts AS (SELECT w1, w2, COUNT(*) AS n FROM grams GROUP BY w1, w2),
context_counts AS (SELECT w1, SUM(n) AS n FROM pair_counts GROUP BY w1),
vocab_size AS (SELECT COUNT(DISTINCT w2) + 1 AS v FROM pair_counts)"""


def ngram_score_sql(texts: str) -> str:
    """Scores of ``texts(id, text)`` under the corpus model."""
    return (
        NGRAM_SQL
        + f""",
texts AS ({texts}),
words AS (SELECT id, regexp_extract_all(lower(text), {WORDS}) AS tokens FROM texts),
scored_grams AS (
  SELECT id, unnest(list_concat(['<s>'], tokens[:-2])) AS w1, unnest(tokens) AS w2 FROM words WHERE len(tokens) > 0
),
nll AS (
  SELECT id, COUNT(*) AS n_tokens,
    SUM(-ln((coalesce(p.n, 0) + 1.0::DOUBLE) / (coalesce(c.n, 0) + 1.0::DOUBLE * (SELECT v FROM vocab_size)))) AS nll
  FROM scored_grams LEFT JOIN pair_counts p USING (w1, w2) LEFT JOIN context_counts c USING (w1) GROUP BY id
)"""
    )


@query(
    f"""WITH {ngram_score_sql('SELECT item_id AS id, text FROM benchmark')}
    SELECT id AS item_id, n_tokens, round(nll, 4) AS nll, round(nll / n_tokens, 6) AS loss FROM nll"""
)
def ngram_nll(spark, sf):
    model = fit_ngram(load(spark, sf, "documents"))
    out = score_texts(load(spark, sf, "benchmark"), model, "item_id", max_tokens=None)
    return out.select("item_id", "n_tokens", F.round("nll", 4).alias("nll"), F.round("loss", 6).alias("loss"))


@query(
    f"""WITH {PAIRS_SQL}, {ngram_score_sql(
        "SELECT run_id || ':' || example_id AS id, prediction AS text FROM preds "
        f"WHERE length(trim(prediction, {WS})) >= 5")}
    SELECT split_part(id, ':', 1) AS run_id, COUNT(*) AS texts, CAST(SUM(n_tokens) AS BIGINT) AS total_tokens,
      round(exp(SUM(nll) / SUM(n_tokens)), 4) AS perplexity FROM nll GROUP BY 1"""
)
def perplexity(spark, sf):
    model = fit_ngram(load(spark, sf, "documents"))
    keyed = predictions(spark, sf).withColumn(
        "text_id", F.concat_ws(":", "run_id", F.col("example_id").cast("string"))
    )
    out = text_perplexity(keyed, model, "text_id", "prediction", ["run_id"], max_tokens=None)
    return out.withColumn("perplexity", F.round("perplexity", 4))


@query(
    """WITH l AS (SELECT user_id, value / 100 AS loss, CAST(floor(value / 10) AS BIGINT) AS n FROM events)
    SELECT user_id, COUNT(*) AS texts, CAST(SUM(n) AS BIGINT) AS total_tokens,
      round(exp(coalesce(SUM(loss * n) / nullif(SUM(n), 0), 0)), 6) AS perplexity FROM l GROUP BY user_id"""
)
def perplexity_of_losses(spark, sf):
    losses = load(spark, sf, "events").select(
        "user_id", (F.col("value") / 100).alias("loss"), F.floor(F.col("value") / 10).alias("n_tokens")
    )
    return perplexity_of(losses, ["user_id"]).withColumn("perplexity", F.round("perplexity", 6))


@query(
    f"""WITH {PAIRS_SQL}, w AS (SELECT example_id, regexp_extract_all(reference, '[^ \\t\\n]+') AS words FROM pairs)
    SELECT example_id, CAST(len(words) AS INTEGER) AS vectors, array_to_string(list_transform(words,
      lambda x: CAST(length(x) AS VARCHAR) || ':' || CAST(ascii(x) AS VARCHAR)), ' ') AS parts FROM w"""
)
def embed_tokens(spark, sf):
    def make_encoder():
        import re

        words = re.compile(r"[^ \t\n]+")
        return lambda texts: [[[float(len(w)), float(ord(w[0]))] for w in words.findall(t)] for t in texts]

    out = add_vectors(dialog_pairs(spark, sf), make_encoder, "reference", "v")
    part = lambda x: F.concat_ws(":", x[0].cast("int").cast("string"), x[1].cast("int").cast("string"))
    return out.select("example_id", F.size("v").alias("vectors"), F.array_join(F.transform("v", part), " ").alias("parts"))


@query(f"WITH {PAIRS_SQL} SELECT example_id, reverse(prompt) AS prediction FROM pairs")
def predict(spark, sf):
    def make_predict_fn():
        return lambda prompts: [p[::-1] for p in prompts]

    return run_predictor(dialog_pairs(spark, sf), make_predict_fn).select("example_id", "prediction")


@query(f"WITH {PAIRS_SQL} SELECT example_id, reverse(prompt) || '!' AS prediction FROM pairs")
def predict_by_length(spark, sf):
    """Batches by a token budget; the model refuses what is over it."""

    def make_predict_fn():
        def fn(prompts):
            longest = max(len(p.split()) for p in prompts)
            if len(prompts) > 1 and len(prompts) * longest > 2000:
                raise ValueError("more tokens than were asked for")
            return [p[::-1] + "!" for p in prompts]

        return fn

    pairs = dialog_pairs(spark, sf)
    return run_predictor(pairs, make_predict_fn, batch_size=64, token_budget=2000).select("example_id", "prediction")
