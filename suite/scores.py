"""Similarity, quality metrics, grading, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.functions.let import let
from corvane.functions.scoring import clamp_score as clamp
from corvane.functions.scoring import grade as grade_of
from corvane.functions.scoring import length_match as match_of
from corvane.functions.scoring import ppl_score as ppl_score_of
from corvane.functions.scoring import recommendations as advice_of
from corvane.functions.similarity import greedy_match as match_vectors
from corvane.functions.similarity import greedy_word_match as match_words
from corvane.functions.similarity import rouge_l as rouge
from corvane.functions.text import overlap_words
from corvane.operators.positions import attach_by_position
from corvane.operators.scores import (
    attach_predictions as attach,
    breakdown,
    compare_runs as compare,
    display_breakdown,
    long_scores,
    normalise_weights,
    overall,
    profile_scores,
    profiles as builtin_profiles,
    retention as retained_scores,
    score_rows,
)
from corvane.operators.stats import exact_match as share_equal
from corvane.operators.stats import quality_metrics
from corvane.operators.ngram import fit_ngram
from corvane.plans.evaluate import METRICS, evaluate, run_perplexities
from suite.inputs import (
    PAIRS_SQL,
    RUN_METRICS_SQL,
    WORDS,
    WS,
    dialog_pairs,
    load,
    predictions,
    run_metrics,
)
from suite.registry import query
from corvane.session import scratch_dir, staged
from corvane.sources.files import read_jsonl
from suite.tokens import NGRAM_SQL

DIM = 8


def _words(text):
    return F.filter(F.split(overlap_words(text), " "), lambda w: w != "")


def _vectors(text):
    """A vector per word from its digest; stands in for a model's encoder."""
    number = lambda w: F.conv(F.substring(F.md5(w), 1, DIM), 16, 10).cast("long")
    digit = lambda n, i: F.shiftright(n, 4 * (DIM - 1 - i)).bitwiseAND(F.lit(15)).cast("double") - 7.5
    return F.transform(_words(text), lambda w: let(number(w), lambda n: F.array(*[digit(n, i) for i in range(DIM)])))


def _make_encoder():
    """The same vectors, for many words at a time."""

    def make_encoder():
        from hashlib import md5

        import numpy as np

        def encode(words):
            pairs = np.frombuffer(b"".join(md5(w.encode()).digest()[: DIM // 2] for w in words), np.uint8)
            return np.stack([pairs >> 4, pairs & 15], axis=1).reshape(-1, DIM) - 7.5

        return encode

    return make_encoder


GRADE_SQL = (
    "CASE "
    + " ".join(f"WHEN overall_score >= {low:g} THEN '{name}'" for low, name in fixed.GRADES)
    + f" ELSE '{fixed.LOWEST_GRADE}' END"
)
ADVICE_SQL = (
    "concat_ws('; ', "
    + ", ".join(
        f"CASE WHEN {metric} < {low:g} THEN '{poor}' WHEN {metric} >= {high:g} THEN '{good}' END"
        for metric, (low, poor, high, good) in fixed.ADVICE.items()
    )
    + ")"
)


def _answered(spark, sf):
    return attach(dialog_pairs(spark, sf), predictions(spark, sf))


def _scored(spark, sf, rows=None):
    rows = _answered(spark, sf) if rows is None else rows
    match = match_words(_words(F.col("prediction")), _words(F.col("reference")), _make_encoder())
    return score_rows(rows, "run_id", "example_id", match=match)


def _rounded(df, digits, *names):
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


# The longest common subsequence by rows of smallest end positions: after i words of
# the one list, v[k] is the smallest position in the other at which k words match.
ROUGE_SQL = (
    PAIRS_SQL
    + """,
sides AS (
  SELECT run_id, example_id, prompt, reference, prediction,
    regexp_extract_all(lower(prediction), '[a-z0-9]+') AS a, regexp_extract_all(lower(reference), '[a-z0-9]+') AS b
  FROM preds JOIN pairs USING (example_id)
),
ends AS (
  SELECT run_id, example_id, a, b, 1 AS i, CAST([] AS BIGINT[]) AS v FROM sides
  UNION ALL
  SELECT run_id, example_id, a, b, i + 1,
    list_filter(list_transform(range(1, len(v) + 2), lambda k: least(
      coalesce(v[k], 1000000000),
      coalesce(nullif(list_position(b[(CASE WHEN k = 1 THEN 0 ELSE v[k - 1] END) + 1:], a[i]), 0)
        + (CASE WHEN k = 1 THEN 0 ELSE v[k - 1] END), 1000000000))), lambda z: z < 1000000000)
  FROM ends WHERE i <= len(a)
),
rouge AS (
  SELECT run_id, example_id, CASE WHEN len(v) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * len(v) / (len(a) + len(b)) END AS f
  FROM ends WHERE i = len(a) + 1
)"""
)
SCORED_SQL = (
    ROUGE_SQL
    + """,
pw AS (SELECT DISTINCT run_id, example_id, unnest(a) AS w FROM sides),
rw AS (SELECT DISTINCT run_id, example_id, unnest(b) AS w FROM sides),
words AS (SELECT DISTINCT w FROM (SELECT w FROM pw UNION ALL SELECT w FROM rw)),
vec AS (
  SELECT w, list_transform(range(1, 9), lambda i: CAST(('0x' || substr(md5(w), i, 1))::BIGINT AS DOUBLE) - 7.5) AS x
  FROM words
),
cosines AS (
  SELECT p.run_id, p.example_id, p.w AS pw, r.w AS rw, list_cosine_similarity(vp.x, vr.x) AS c
  FROM pw p JOIN rw r ON p.run_id = r.run_id AND p.example_id = r.example_id
  JOIN vec vp ON vp.w = p.w JOIN vec vr ON vr.w = r.w
),
best_p AS (SELECT run_id, example_id, pw AS w, MAX(c) AS c FROM cosines GROUP BY ALL),
best_r AS (SELECT run_id, example_id, rw AS w, MAX(c) AS c FROM cosines GROUP BY ALL),
precision_ AS (
  SELECT s.run_id, s.example_id, AVG(b.c) AS p
  FROM (SELECT run_id, example_id, unnest(a) AS w FROM sides) s JOIN best_p b USING (run_id, example_id, w) GROUP BY ALL
),
recall_ AS (
  SELECT s.run_id, s.example_id, AVG(b.c) AS r
  FROM (SELECT run_id, example_id, unnest(b) AS w FROM sides) s JOIN best_r b USING (run_id, example_id, w) GROUP BY ALL
),
scored AS (
  SELECT s.run_id, s.example_id, s.prompt, s.reference, s.prediction, 100 * g.f AS rougeL,
    100 * coalesce(2 * p.p * r.r / (p.p + r.r), 0) AS bertscore,
    (0.5 * g.f + 0.5 * coalesce(2 * p.p * r.r / (p.p + r.r), 0)) * 100 AS final_score
  FROM sides s JOIN rouge g USING (run_id, example_id)
  LEFT JOIN precision_ p USING (run_id, example_id) LEFT JOIN recall_ r USING (run_id, example_id)
)"""
)
QUALITY_SQL = (
    SCORED_SQL
    + f""",
wordy AS (
  SELECT *, len(regexp_extract_all(prediction, '[^{WS[1:-1]}]+')) AS pw_n,
    len(regexp_extract_all(reference, '[^{WS[1:-1]}]+')) AS rw_n FROM scored
),
quality AS (
  SELECT run_id, COUNT(*) AS num_examples, AVG(bertscore) AS bert_score, AVG(rougeL) AS rouge_score,
    (200 - least(stddev_samp(bertscore), 100) - least(stddev_samp(rougeL), 100)) / 2 AS consistency,
    AVG(CASE WHEN bertscore >= 70 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS high_quality_pct,
    AVG(pw_n) AS avg_pred_words, AVG(rw_n) AS avg_ref_words
  FROM wordy GROUP BY run_id
)"""
)


@query(
    f"WITH {PAIRS_SQL} SELECT example_id, prompt, reference, run_id, prediction FROM pairs JOIN preds USING (example_id)"
)
def attach_predictions(spark, sf):
    return _answered(spark, sf)


@query(
    f"""WITH {PAIRS_SQL} SELECT example_id, run_id, reference, prediction FROM pairs JOIN preds USING (example_id)
    WHERE length(reference) % 5 <> 0"""
)
def predictions_by_position(spark, sf):
    """The answers of both runs as lines without keys, met by their place after some pairs were filtered."""
    rows = _answered(spark, sf).select("run_id", "example_id", "reference", "prediction")
    rows = staged(rows, "answered")
    folder = scratch_dir(spark, "positional")
    asked = F.length("reference") % 5 != 0

    def write(part, value, files, name):
        """In order of the keys: a range of them per file, the files in their order."""
        ordered = part.repartitionByRange(files, "example_id", "run_id").sortWithinPartitions("example_id", "run_id")
        ordered.select(F.to_json(value).alias("value")).write.text(f"{folder}/{name}")

    write(rows, F.struct("run_id", "example_id", "reference"), 4, "pairs")
    # A prediction per kept pair, in other files, cut elsewhere.
    write(rows.filter(asked), F.struct("prediction"), 3, "predictions")
    pairs = read_jsonl(spark, f"{folder}/pairs/*.txt")
    pairs = pairs.select("file", "block", "seq", F.from_json("line", "run_id string, example_id long, reference string").alias("p"))
    pairs = pairs.select("file", "block", "seq", "p.*").filter(asked)
    met = attach_by_position(pairs, read_jsonl(spark, f"{folder}/predictions/*.txt"))
    return met.select("example_id", "run_id", "reference", F.get_json_object("prediction", "$.prediction").alias("prediction"))


@query(f"WITH RECURSIVE {ROUGE_SQL} SELECT run_id, example_id, round(f * 100, 6) AS rougeL FROM rouge")
def rouge_l(spark, sf):
    score = rouge(F.col("prediction"), F.col("reference")) * 100
    return _answered(spark, sf).select("run_id", "example_id", F.round(score, 6).alias("rougeL"))


@query(
    """WITH sides AS (SELECT vec_id // 8 AS grp, vec_id % 8 < 4 AS pred, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    cosines AS (SELECT p.grp, p.vec_id AS pv, r.vec_id AS rv, list_cosine_similarity(p.e, r.e) AS c
      FROM sides p JOIN sides r ON p.grp = r.grp AND p.pred AND NOT r.pred),
    p AS (SELECT grp, AVG(c) AS p FROM (SELECT grp, pv, MAX(c) AS c FROM cosines GROUP BY ALL) GROUP BY grp),
    r AS (SELECT grp, AVG(c) AS r FROM (SELECT grp, rv, MAX(c) AS c FROM cosines GROUP BY ALL) GROUP BY grp)
    SELECT g.grp, round(100 * coalesce(p, 0), 4) AS p, round(100 * coalesce(r, 0), 4) AS r,
      round(100 * coalesce(2 * p * r / (p + r), 0), 4) AS f1
    FROM (SELECT DISTINCT grp FROM sides) g LEFT JOIN p USING (grp) LEFT JOIN r USING (grp)"""
)
def greedy_match(spark, sf):
    # Eight vectors per group by the meaning of the key: bounded lists.
    sides = load(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("grp")).agg(
        F.collect_list(F.when(F.col("vec_id") % 8 < 4, F.col("embedding"))).alias("a"),
        F.collect_list(F.when(F.col("vec_id") % 8 >= 4, F.col("embedding"))).alias("b"),
    )
    m = sides.select("grp", match_vectors(F.col("a"), F.col("b")).alias("m"))
    return m.select(
        "grp",
        F.round(F.col("m.precision") * 100, 4).alias("p"),
        F.round(F.col("m.recall") * 100, 4).alias("r"),
        F.round(F.col("m.f1") * 100, 4).alias("f1"),
    )


@query(
    f"""WITH RECURSIVE {SCORED_SQL} SELECT run_id, example_id, prompt, reference, prediction,
      round(rougeL, 4) AS rougeL, round(bertscore, 4) AS bertscore, round(final_score, 4) AS final_score FROM scored"""
)
def scored_examples(spark, sf):
    return _rounded(_scored(spark, sf), 4, "rougeL", "bertscore", "final_score")


@query(
    f"""WITH RECURSIVE {QUALITY_SQL} SELECT run_id, num_examples, round(bert_score, 4) AS bert_score,
      round(rouge_score, 4) AS rouge_score FROM quality"""
)
def corpus_means(spark, sf):
    out = quality_metrics(_scored(spark, sf), ["run_id"])
    return _rounded(out, 4, "bert_score", "rouge_score").select(
        "run_id", "num_examples", "bert_score", "rouge_score"
    )


@query(
    f"""WITH RECURSIVE {QUALITY_SQL} SELECT run_id, round(avg_pred_words, 4) AS avg_pred_words,
      round(avg_ref_words, 4) AS avg_ref_words, round(avg_pred_words / avg_ref_words, 6) AS length_ratio,
      round(100 * exp(-abs(ln(avg_pred_words / avg_ref_words + 0.001)) / 0.5), 4) AS length_match FROM quality"""
)
def length_ratio(spark, sf):
    out = quality_metrics(_scored(spark, sf), ["run_id"])
    out = _rounded(out, 4, "avg_pred_words", "avg_ref_words", "length_match")
    return _rounded(out, 6, "length_ratio").select(
        "run_id", "avg_pred_words", "avg_ref_words", "length_ratio", "length_match"
    )


@query(
    """SELECT event_id, round(CASE WHEN value > 1 THEN 100 * exp(-abs(ln((value - 1) / 20 + 0.001)) / 0.5) ELSE 50 END, 6)
      AS length_match FROM events"""
)
def length_match(spark, sf):
    ratio = F.greatest(F.col("value") - 1, F.lit(0.0)) / 20
    return load(spark, sf, "events").select("event_id", F.round(match_of(ratio), 6).alias("length_match"))


@query(f"WITH RECURSIVE {QUALITY_SQL} SELECT run_id, round(consistency, 4) AS consistency FROM quality")
def consistency(spark, sf):
    out = quality_metrics(_scored(spark, sf), ["run_id"])
    return out.select("run_id", F.round("consistency", 4).alias("consistency"))


@query(f"WITH RECURSIVE {QUALITY_SQL} SELECT run_id, round(high_quality_pct, 4) AS high_quality_pct FROM quality")
def high_quality_pct(spark, sf):
    out = quality_metrics(_scored(spark, sf), ["run_id"])
    return out.select("run_id", F.round("high_quality_pct", 4).alias("high_quality_pct"))


@query(
    """SELECT lang, COUNT(*) AS n, round(AVG(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS accuracy
    FROM labels JOIN documents USING (doc_id) GROUP BY lang"""
)
def exact_match(spark, sf):
    labelled = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return share_equal(labelled, "quality", "toxic", ["lang"]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    """SELECT event_id, round(100 * exp(-value / 250), 6) AS v3, round(100 * exp(-value / 300), 6) AS v2,
      round(greatest(0, 100 - ln(value + 1) * 20), 6) AS v1 FROM events"""
)
def ppl_score(spark, sf):
    value = F.col("value")
    return load(spark, sf, "events").select(
        "event_id", *[F.round(ppl_score_of(value, p), 6).alias(p) for p in ("v3", "v2", "v1")]
    )


@query(
    """WITH w AS (SELECT user_id AS profile, event_type AS metric, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS weight
      FROM events GROUP BY ALL)
    SELECT profile, metric, round(weight / SUM(weight) OVER (PARTITION BY profile), 6) AS weight FROM w"""
)
def weights(spark, sf):
    raw = load(spark, sf, "events").groupBy(
        F.col("user_id").alias("profile"), F.col("event_type").alias("metric")
    ).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("weight"))
    return normalise_weights(raw).withColumn("weight", F.round("weight", 6))


@query(
    """SELECT event_id, CASE event_type WHEN 'signup' THEN 0.0::DOUBLE WHEN 'error' THEN 100.0 WHEN 'click' THEN 100.0
      WHEN 'view' THEN 0.0 ELSE least(value, 100) END AS score FROM events"""
)
def clamp_score(spark, sf):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "signup", F.lit(float("nan")))
        .when(kind == "error", F.lit(float("inf")))
        .when(kind == "click", F.lit(float("-inf")))
        .when(kind == "view", F.lit(0.0) - F.col("value"))
        .otherwise(F.col("value"))
    )
    return load(spark, sf, "events").select("event_id", clamp(raw).alias("score"))


LONG_SQL = (
    RUN_METRICS_SQL
    + """,
ppl AS (SELECT *, 100 * exp(-coalesce(perplexity, 100) / 250) AS perplexity_score FROM run_metrics),
long AS (
  SELECT run_id, 'BERTScore' AS metric, bert_score AS score, 0.30::DOUBLE AS weight FROM ppl
  UNION ALL SELECT run_id, 'ROUGE-L', rouge_score, 0.40 FROM ppl
  UNION ALL SELECT run_id, 'Consistency', consistency, 0.15 FROM ppl
  UNION ALL SELECT run_id, 'High Quality %', high_quality_pct, 0.10 FROM ppl
  UNION ALL SELECT run_id, 'Perplexity', perplexity_score, 0.05 FROM ppl
),
parts AS (
  SELECT run_id, metric, least(greatest(coalesce(score, 0), 0), 100) AS score, weight,
    least(greatest(coalesce(score, 0), 0), 100) * weight AS contribution FROM long
),
totals AS (
  SELECT run_id, CAST(SUM(CAST(format('{:.2f}', contribution) AS DECIMAL(18,2))) AS DOUBLE) AS overall_score
  FROM parts GROUP BY run_id
),
graded AS (
  SELECT *, """
    + GRADE_SQL
    + """ AS grade FROM totals
)"""
)


def _run_scores(spark, sf):
    ppl = ppl_score_of(F.coalesce(F.col("perplexity"), F.lit(fixed.EMPTY_PERPLEXITY)))
    return run_metrics(spark, sf).withColumn("perplexity_score", ppl)


def _parts(spark, sf):
    scores = long_scores(_run_scores(spark, sf), ["run_id"], METRICS)
    return breakdown(scores, normalise_weights(builtin_profiles(spark)), ["run_id"])


@query(
    f"""WITH {LONG_SQL} SELECT run_id, metric, round(score, 6) AS score, weight,
      round(contribution, 6) AS contribution FROM parts"""
)
def score_breakdown(spark, sf):
    return _rounded(_parts(spark, sf), 6, "score", "contribution")


@query(
    f"""WITH {LONG_SQL} SELECT run_id, metric, format('{{:.2f}}', score) AS score,
      format('{{:.2f}}%', weight * 100) AS weight, format('{{:.2f}}', contribution) AS contribution FROM parts"""
)
def score_table(spark, sf):
    return display_breakdown(_parts(spark, sf))


@query(f"WITH {LONG_SQL} SELECT run_id, overall_score FROM totals")
def overall_score(spark, sf):
    return overall(_parts(spark, sf), ["run_id"])


@query(f"WITH {LONG_SQL} SELECT run_id, overall_score, grade FROM graded")
def grade(spark, sf):
    total = overall(_parts(spark, sf), ["run_id"])
    return total.withColumn("grade", grade_of(F.col("overall_score")))


@query(
    f"""WITH {LONG_SQL}, said AS (SELECT run_id, {ADVICE_SQL} AS s FROM ppl)
    SELECT run_id, CASE WHEN s = '' THEN '{fixed.DEFAULT_ADVICE}' ELSE s END AS advice FROM said"""
)
def recommendations(spark, sf):
    advice = advice_of(**{name: F.col(name) for name in fixed.ADVICE})
    return _run_scores(spark, sf).select("run_id", F.array_join(advice, "; ").alias("advice"))


def _ppl_sql(run: str, texts: str) -> str:
    """A subquery of the perplexity per run of texts ``(run_id, text)``."""
    return f"""(WITH t AS ({texts}),
      w AS (SELECT run_id, regexp_extract_all(lower(text), {WORDS}) AS tokens FROM t),
      g AS (SELECT run_id, unnest(list_concat(['<s>'], tokens[:-2])) AS w1, unnest(tokens) AS w2 FROM w WHERE len(tokens) > 0)
      SELECT run_id, exp(SUM(-ln((coalesce(p.n, 0) + 1.0::DOUBLE)
        / (coalesce(c.n, 0) + 1.0::DOUBLE * (SELECT v FROM vocab_size)))) / COUNT(*)) AS {run}
      FROM g LEFT JOIN pair_counts p USING (w1, w2) LEFT JOIN context_counts c USING (w1) GROUP BY run_id)"""


@query(
    f"""WITH RECURSIVE {QUALITY_SQL}, {NGRAM_SQL},
    ppl AS (SELECT *, 100 * exp(-gen / 250) AS perplexity_score FROM quality
      JOIN {_ppl_sql('gen', f'SELECT run_id, prediction AS text FROM preds WHERE length(trim(prediction, {WS})) >= 5')} USING (run_id)
      JOIN {_ppl_sql('ref', 'SELECT run_id, reference AS text FROM preds JOIN pairs USING (example_id)')} USING (run_id)),
    long AS (
      SELECT run_id, 'BERTScore' AS metric, bert_score AS score, 0.30::DOUBLE AS weight FROM ppl
      UNION ALL SELECT run_id, 'ROUGE-L', rouge_score, 0.40 FROM ppl
      UNION ALL SELECT run_id, 'Consistency', consistency, 0.15 FROM ppl
      UNION ALL SELECT run_id, 'High Quality %', high_quality_pct, 0.10 FROM ppl
      UNION ALL SELECT run_id, 'Perplexity', perplexity_score, 0.05 FROM ppl),
    parts AS (SELECT *, least(greatest(score, 0), 100) * weight AS contribution FROM long),
    totals AS (SELECT run_id, CAST(SUM(CAST(format('{{:.2f}}', contribution) AS DECIMAL(18,2))) AS DOUBLE) AS overall_score,
      string_agg(metric || '=' || format('{{:.2f}}', contribution), ',' ORDER BY metric) AS parts FROM parts GROUP BY run_id)
    SELECT run_id, num_examples, overall_score,
      {GRADE_SQL} AS quality_grade,
      round(bert_score, 4) AS bert_score, round(rouge_score, 4) AS rouge_score,
      round(gen, 4) AS perplexity_generated, round(ref, 4) AS perplexity_reference,
      round(perplexity_score, 4) AS perplexity_score, round(consistency, 4) AS consistency_score,
      round(high_quality_pct, 4) AS high_quality_percentage, parts AS score_breakdown,
      round(avg_pred_words / avg_ref_words, 4) AS length_ratio
    FROM ppl JOIN totals USING (run_id)"""
)
def run_summary(spark, sf):
    answered = staged(_answered(spark, sf), "answered")
    model = fit_ngram(load(spark, sf, "documents"))
    ppl = run_perplexities(answered, model, "example_id")
    out = evaluate(_scored(spark, sf, answered), ppl).summary
    entries = F.array_sort(F.map_entries("score_breakdown"))
    shown = F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), F.format_number(e["value"]["contribution"], 2))
    )
    out = out.withColumn("length_ratio", F.col("statistics")["length_ratio"]).drop("statistics")
    out = out.withColumn("score_breakdown", F.array_join(shown, ","))
    return _rounded(
        out,
        4,
        "bert_score",
        "rouge_score",
        "perplexity_generated",
        "perplexity_reference",
        "perplexity_score",
        "consistency_score",
        "high_quality_percentage",
        "length_ratio",
    )


@query(
    f"""WITH {RUN_METRICS_SQL}, m AS (SELECT run_id, bert_score, rouge_score, mcq, coalesce(perplexity, 100) AS ppl FROM run_metrics),
    long AS (
      SELECT run_id, 'v1' AS profile, mcq AS score, 0.35::DOUBLE AS weight FROM m
      UNION ALL SELECT run_id, 'v1', bert_score, 0.25 FROM m UNION ALL SELECT run_id, 'v1', rouge_score, 0.15 FROM m
      UNION ALL SELECT run_id, 'v1', greatest(0, 100 - ln(ppl + 1) * 20), 0.25 FROM m
      UNION ALL SELECT run_id, 'v2', mcq, 0.40 FROM m UNION ALL SELECT run_id, 'v2', bert_score, 0.30 FROM m
      UNION ALL SELECT run_id, 'v2', rouge_score, 0.20 FROM m
      UNION ALL SELECT run_id, 'v2', 100 * exp(-ppl / 300), 0.10 FROM m
      UNION ALL SELECT run_id, 'v3', bert_score, 0.30 FROM m UNION ALL SELECT run_id, 'v3', rouge_score, 0.40 FROM m
      UNION ALL SELECT run_id, 'v3', consistency, 0.15 FROM run_metrics
      UNION ALL SELECT run_id, 'v3', high_quality_pct, 0.10 FROM run_metrics
      UNION ALL SELECT run_id, 'v3', 100 * exp(-ppl / 250), 0.05 FROM m)
    SELECT run_id, profile, CAST(SUM(CAST(format('{{:.2f}}', least(greatest(coalesce(score, 0), 0), 100) * weight)
      AS DECIMAL(18,2))) AS DOUBLE) AS overall_score FROM long GROUP BY ALL"""
)
def profiles(spark, sf):
    metrics = run_metrics(spark, sf).withColumn(
        "perplexity", F.coalesce("perplexity", F.lit(fixed.EMPTY_PERPLEXITY))
    )
    scores = profile_scores(metrics, ["run_id"], {**METRICS, "MCQ Accuracy": "mcq"}, "perplexity")
    rows = breakdown(scores, normalise_weights(builtin_profiles(spark)), ["run_id"], profile=None)
    return overall(rows, ["run_id", "profile"])


@query(
    f"""WITH {LONG_SQL}, s AS (SELECT run_id, overall_score, bert_score, rouge_score,
        coalesce(perplexity, 100) AS perplexity_generated FROM totals JOIN run_metrics USING (run_id)),
    base AS (SELECT * FROM s WHERE run_id = 8)
    SELECT s.run_id, s.overall_score, round(s.bert_score, 6) AS bert_score, round(s.rouge_score, 6) AS rouge_score,
      round(s.perplexity_generated, 6) AS perplexity_generated,
      round(s.overall_score - base.overall_score, 4) AS overall_score_delta,
      round(s.bert_score - base.bert_score, 6) AS bert_score_delta,
      round(s.rouge_score - base.rouge_score, 6) AS rouge_score_delta,
      round(s.perplexity_generated - base.perplexity_generated, 6) AS perplexity_generated_delta
    FROM s, base"""
)
def compare_runs(spark, sf):
    metrics = run_metrics(spark, sf).select(
        "run_id",
        "bert_score",
        "rouge_score",
        F.coalesce("perplexity", F.lit(fixed.EMPTY_PERPLEXITY)).alias("perplexity_generated"),
    )
    out = compare(overall(_parts(spark, sf), ["run_id"]).join(metrics, "run_id"), 8)
    out = _rounded(out, 4, "overall_score_delta")
    names = ("bert_score", "rouge_score", "perplexity_generated")
    return _rounded(out, 6, *names, *[f"{n}_delta" for n in names])


@query(
    """WITH s AS (SELECT lang, CAST(substr(source, 4) AS BIGINT) AS stage, AVG(n_chars) AS score
      FROM documents GROUP BY ALL),
    f AS (SELECT *, first_value(score) OVER (PARTITION BY lang ORDER BY stage) AS first_score FROM s)
    SELECT lang, stage, round(score, 4) AS score, round(first_score, 4) AS first_score,
      score >= first_score * 0.95 AS retained FROM f"""
)
def retention(spark, sf):
    stage = F.substring("source", 4, 10).cast("long")
    scores = load(spark, sf, "documents").groupBy("lang", stage.alias("stage")).agg(
        F.avg("n_chars").alias("score")
    )
    return _rounded(retained_scores(scores, ["lang"], "stage", "score"), 4, "score", "first_score")
