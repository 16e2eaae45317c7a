"""Sampling, tokens, batches, statistics, scores, artifacts."""

import hashlib
import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.operators import artifacts, batches, ngram, sampling, scores, stats, telemetry, tokens
from corvane.operators.predict import embed_tokens, predict
from corvane.plans.converse import converse
from corvane.plans.evaluate import evaluate, run_perplexities
from corvane.plans.prepare import PrepareOptions, prepare


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=12, deadline=None)
@given(n=st.integers(0, 400), k=st.integers(0, 450), seed=st.integers(0, 99), parts=st.integers(1, 5))
def test_sample_is_exact(spark, n, k, seed, parts):
    df = spark.range(0, n, 1, parts)
    got = {r[0] for r in sampling.sample_n(df, "id", k, seed).collect()}
    assert got == set(sorted(range(n), key=lambda i: digest(seed, i))[:k])


@settings(max_examples=10, deadline=None)
@given(n=st.integers(1, 300), ratio=st.sampled_from([0.05, 0.1, 0.5, 1 / 3]), parts=st.integers(1, 5))
def test_split_is_exact_and_stable(spark, n, ratio, parts):
    df = spark.range(0, n, 1, parts)
    rows = sampling.train_eval_split(df, "id", ratio, 7).collect()
    chosen = {r["id"] for r in rows if r["split"] == "eval"}
    assert len(rows) == n
    assert chosen == set(sorted(range(n), key=lambda i: digest(7, i))[: math.ceil(ratio * n)])


def test_split_moves_no_rows(spark):
    """Only histograms are exchanged; the rows themselves stay in place."""
    df = spark.range(0, 5000, 1, 4).withColumn("payload", F.lit("x"))
    split = sampling.train_eval_split(df, "id", 0.1, 7)
    main = plan_of(split).split("Subquery")[0]
    assert "Exchange" not in main and "payload" in main


def test_sampling_with_a_hot_key(spark):
    """A key that holds a third of the rows stays together and is counted whole."""
    df = spark.createDataFrame([(i if i % 3 else 0,) for i in range(600)], "id long")
    split = sampling.train_eval_split(df, "id", 0.5, 7)
    sides = split.groupBy("id").agg(F.countDistinct("split").alias("n"))
    assert sides.filter("n > 1").isEmpty()
    chosen = split.filter("split = 'eval'").count()
    assert 300 <= chosen < 300 + 201


def test_first_rows_are_the_same_by_ranges(spark, monkeypatch):
    df = spark.range(3000).selectExpr("(id * 7919) % 3001 AS id", "id AS v").repartition(5)
    for n in (1, 700, 2999, 3000, 9000):
        want = [tuple(r) for r in df.orderBy("id").limit(n).collect()]
        monkeypatch.setattr(sampling, "RANKED", 0)
        assert [tuple(r) for r in sampling.head_n(df, "id", n).collect()] == want
        monkeypatch.undo()


def test_sample_per_group(spark):
    df = spark.range(300).withColumn("g", F.when(F.col("id") < 250, "big").otherwise("small"))
    got = sampling.sample_n_by(df, ["g"], "id", 40, 3)
    by = {r["g"]: r["count"] for r in got.groupBy("g").count().collect()}
    assert by == {"big": 40, "small": 40}
    assert "WindowGroupLimit" in plan_of(got)
    assert sampling.sample_n_by(df, ["g"], "id", 2000, 3).count() == 300


def test_sample_per_group_is_the_same_by_histograms(spark, monkeypatch):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 2500, "big").when(F.col("id") % 3 > 0, "small"))
    for n in (1, 40, 700):
        ranked = {r["id"] for r in sampling.sample_n_by(df, ["g"], "id", n, 3).collect()}
        monkeypatch.setattr(sampling, "RANKED", 0)
        found = sampling.sample_n_by(df, ["g"], "id", n, 3)
        assert {r["id"] for r in found.collect()} == ranked and found.columns == df.columns
        monkeypatch.undo()


def test_approximate_split(spark):
    split = sampling.train_eval_split(spark.range(4000), "id", 0.25, 1, exact=False)
    assert 850 < split.filter("split = 'eval'").count() < 1150


def test_report(spark):
    rows = sampling.split_report(sampling.train_eval_split(spark.range(200), "id", 0.05, 1)).collect()
    got = {r["split"]: (r["examples"], r["percent"], r["est_tokens_m"]) for r in rows}
    assert got == {"train": (190, 95.0, 0.19), "eval": (10, 5.0, 0.01)}


TEXTS = ["the cat, the dog", "a cat sat", "", "the the the end.", "éa ça"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def words(t):
    import re

    return re.findall(r"\w+|[^\w\s]", t)


def test_tokenize_and_encode(corpus):
    cut = tokens.tokenize(corpus, 3)
    rows = {r["id"]: r for r in cut.collect()}
    for i, t in enumerate(TEXTS):
        assert rows[i]["tokens"] == words(t)[:3]
        assert rows[i]["n_tokens"] == len(words(t))
        assert rows[i]["attention_mask"] == [1] * min(3, len(words(t)))
    vocab = tokens.fit_vocab(tokens.tokenize(corpus, None), 3)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    counts = {}
    for t in TEXTS:
        for w in words(t):
            counts[w] = counts.get(w, 0) + 1
    best = sorted(counts, key=lambda w: (-counts[w], w))[:3]
    assert ids == {w: i + 2 for i, w in enumerate(best)}
    coded = tokens.encode(tokens.tokenize(corpus, None), vocab)
    for r in coded.collect():
        assert r["input_ids"] == [ids.get(w, 1) for w in words(TEXTS[r["id"]])]
    assert "_slots" not in coded.columns
    assert "Exchange" not in plan_of(coded).split("Subquery")[0]


def test_any_vocabulary_size_gives_the_same_ids(spark, corpus, monkeypatch):
    rows = tokens.tokenize(corpus, None)
    vocab = tokens.fit_vocab(rows, 6)
    want = {r["id"]: r["input_ids"] for r in tokens.encode(rows, vocab).collect()}
    order = [(r["token"], r["token_id"]) for r in vocab.orderBy("token_id").collect()]
    for most in (1, 2, 5):
        monkeypatch.setattr(tokens, "MAX_VOCAB", most)
        again = tokens.fit_vocab(rows, 6)
        assert [(r["token"], r["token_id"]) for r in again.orderBy("token_id").collect()] == order
        coded = tokens.encode(rows, vocab)
        assert {r["id"]: r["input_ids"] for r in coded.collect()} == want
        assert coded.columns == [*rows.columns, "input_ids"]


def test_user_functions_leave_other_columns_alone(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a b", [None, big]), (None, None, None)], "id long, text string, more array<long>")
    out = tokens.tokenize_with(df, lambda: lambda texts: [[len(t)] for t in texts], None)
    assert sorted(map(str, out.collect())) == sorted(
        ["Row(id=9007199254740993, more=[None, 9007199254740993], input_ids=[3], attention_mask=[1], n_tokens=1)",
         "Row(id=None, more=None, input_ids=None, attention_mask=None, n_tokens=None)"]
    )
    made = predict(df, lambda: lambda prompts: [p.upper() for p in prompts], "text")
    assert {(r["id"], r["prediction"]) for r in made.collect()} == {(big, "A B"), (None, None)}


def test_user_tokenizer(corpus):
    def make():
        from tokenizers import Tokenizer, models, pre_tokenizers

        tok = Tokenizer(models.WordLevel({"[UNK]": 0, "the": 1, "cat": 2}, unk_token="[UNK]"))
        tok.pre_tokenizer = pre_tokenizers.Whitespace()
        return lambda texts: [e.ids for e in tok.encode_batch(texts)]

    rows = {r["id"]: r for r in tokens.tokenize_with(corpus, make, 3, batch_size=2).collect()}
    assert rows[0]["input_ids"] == [1, 2, 0] and rows[0]["n_tokens"] == 5
    assert rows[2]["input_ids"] == [] and rows[3]["attention_mask"] == [1, 1, 1]


def test_batches(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.randint(1, 9) for _ in range(rnd.randint(0, 150))]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, input_ids array<int>")
    placed = batches.length_batches(df, "id", 8, mega=4)
    assert "SinglePartition" not in plan_of(placed).split("Subquery")[0]
    out = batches.pad_batches(placed, 16).collect()
    assert len(out) == 500
    groups = {}
    for r in out:
        groups.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), members in groups.items():
        longest = max(r["n_ids"] for r in members)
        assert {r["pad_len"] for r in members} == {math.ceil(longest / 16) * 16}
        last = max(b for k, b in groups if k == bucket)
        assert len(members) == 8 or batch == last
        for r in members:
            assert r["padded_ids"] == r["input_ids"] + [0] * (r["pad_len"] - r["n_ids"])
            assert r["padded_mask"] == [1] * r["n_ids"] + [0] * (r["pad_len"] - r["n_ids"])
    for bucket in {k for k, _ in groups}:
        order = [min(r["n_ids"] for r in groups[bucket, b]) for b in sorted(b for k, b in groups if k == bucket)]
        assert order == sorted(order, reverse=True)
    plan = batches.batch_plan(batches.pad_batches(placed, 16), 8, 4).first()
    assert plan["examples"] == 500 and plan["batches"] == len(groups)
    assert plan["effective_batch"] == 32 and plan["steps_per_epoch"] == math.ceil(len(groups) / 4)
    waste = 1 - sum(r["n_ids"] for r in out) / sum(r["pad_len"] for r in out)
    assert plan["padding_share"] == pytest.approx(waste)


def test_labels(spark):
    df = spark.createDataFrame([([5, 0, 7, 0],)], "ids array<int>")
    assert df.select(batches.lm_labels(F.col("ids"))).first()[0] == [5, -100, 7, -100]


@pytest.mark.parametrize("n", [1, 2, 4, 20, 99, 100])
def test_length_stats(spark, n):
    rnd = random.Random(n)
    lengths = [rnd.randint(1, 12) for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in lengths], "len int")
    row = stats.length_stats(df, "len").first()
    order = sorted(lengths)
    assert row["n"] == n and row["mean_len"] == pytest.approx(sum(lengths) / n)
    assert (row["median_len"], row["p95_len"]) == (order[n // 2], order[int(n * 0.95)])


SCORED = "run_id string, prompt string, reference string, prediction string, rougeL double, bertscore double"


def test_quality_of_one_run_row_and_none(spark):
    one = spark.createDataFrame([("r", "p", "a b", "a", 50.0, 80.0)], SCORED)
    row = stats.quality_metrics(one, ["run_id"]).first()
    assert row["consistency"] is None and row["high_quality_pct"] == 100.0 and row["length_ratio"] == 0.5
    none = stats.quality_metrics(one.limit(0)).first()
    assert (none["consistency"], none["high_quality_pct"], none["length_match"]) == (50.0, 50.0, 50.0)


def test_perplexity(spark):
    df = spark.createDataFrame([(1.0, 2), (3.0, 6), (9.0, 0)], "loss double, n_tokens long")
    assert stats.perplexity(df).first()["perplexity"] == pytest.approx(math.exp(20 / 8))
    assert stats.perplexity(df.filter("n_tokens = 0")).first()["perplexity"] == 1.0
    assert stats.perplexity(df.limit(0)).first()["perplexity"] == 100.0


def test_exact_match(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), (None, "a")], "p string, g string")
    assert stats.exact_match(df, "p", "g").first()["accuracy"] == pytest.approx(100 / 3)
    assert stats.exact_match(df.limit(0), "p", "g").first()["accuracy"] == 0.0


@pytest.mark.parametrize(
    "mcq,bert,rouge,ppl,total", [(93.37, 85.13, 10.18, 53.55, 60.49), (92.86, 86.25, 12.94, 598.18, 56.00)]
)
def test_published_totals(spark, mcq, bert, rouge, ppl, total):
    df = spark.createDataFrame([("r", mcq, bert, rouge, ppl, 0.0, 0.0)], "run_id string, mcq double, b double, r double, ppl double, c double, h double")
    columns = {"MCQ Accuracy": "mcq", "BERTScore": "b", "ROUGE-L": "r", "Consistency": "c", "High Quality %": "h"}
    long = scores.profile_scores(df, ["run_id"], columns, "ppl")
    rows = scores.breakdown(long, scores.profiles(spark), ["run_id"], profile=None)
    got = {r["profile"]: r["overall_score"] for r in scores.overall(rows, ["run_id", "profile"]).collect()}
    assert got["v1"] == total


def test_weights(spark):
    df = spark.createDataFrame([("p", "a", 2.0), ("p", "b", 6.0), ("q", "a", 0.4), ("q", "b", 0.6)], "profile string, metric string, weight double")
    got = {(r[0], r[1]): r[2] for r in scores.normalise_weights(df).collect()}
    assert got == {("p", "a"): 0.25, ("p", "b"): 0.75, ("q", "a"): 0.4, ("q", "b"): 0.6}
    metric = spark.createDataFrame([("a", 10.0), ("z", 10.0)], "metric string, score double")
    rows = {r["metric"]: r["weight"] for r in scores.attach_weights(metric, df.filter("profile = 'q'").drop("profile")).collect()}
    assert rows == {"a": 0.4, "z": 0.0}


def test_any_number_of_weights(spark):
    many = spark.range(1500).select(F.col("id").cast("string").alias("metric"), F.lit(0.1).alias("weight"))
    metric = spark.createDataFrame([("1", 10.0), ("none", 1.0)], "metric string, score double")
    got = {r["metric"]: r["weight"] for r in scores.attach_weights(metric, many).collect()}
    assert got == {"1": 0.1, "none": 0.0}


def test_evaluate_run(spark):
    rows = [("r", "p", "a b c", "a b", 60.0, 90.0), ("r", "p", "a", "a", 100.0, 80.0)]
    ppl = spark.createDataFrame([("r", 20.0)], "run_id string, perplexity_generated double").withColumn(
        "perplexity_reference", F.lit(None).cast("double")
    )
    done = evaluate(spark.createDataFrame(rows, SCORED), ppl)
    s = done.summary.first()
    sd = lambda a, b: abs(a - b) / math.sqrt(2)
    consistency = (100 - sd(60, 100) + 100 - sd(90, 80)) / 2
    parts = [85 * 0.3, 80 * 0.4, consistency * 0.15, 100 * 0.1, 100 * math.exp(-20 / 250) * 0.05]
    assert s["overall_score"] == pytest.approx(sum(round(x, 2) for x in parts), abs=1e-9)
    assert s["perplexity_reference"] == 100.0 and s["num_examples"] == 2
    assert s["score_breakdown"]["ROUGE-L"]["contribution"] == pytest.approx(32.0)
    assert s["statistics"]["length_ratio"] == pytest.approx(0.75)
    assert done.advice.first()["recommendations"][0] == fixed.ADVICE["bert_score"][3]


def test_perplexities_of_both_sides(spark, corpus):
    model = ngram.fit_ngram(corpus)
    rows = [("r", i, "the cat sat here" if i else "the", "a dog") for i in range(5)]
    df = spark.createDataFrame(rows, "run_id string, id long, prediction string, reference string")
    out = run_perplexities(df, model, "id", sample=3).first()

    def one(text):
        texts = spark.createDataFrame([(1, text)], "id long, text string")
        return math.exp(ngram.ngram_nll(texts, model, "id").first()["loss"])

    assert out["perplexity_generated"] == pytest.approx(one("the cat sat here"))
    assert out["perplexity_reference"] == pytest.approx(one("a dog"))
    short = run_perplexities(df.filter("id = 0"), model, "id").first()
    assert short["perplexity_generated"] is None and short["perplexity_reference"] is not None


def test_compare(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0), ("b", 2.0, 2.5, 1.0, 8.0)], "run_id string, overall_score double, bert_score double, rouge_score double, perplexity_generated double")
    got = {r["run_id"]: r["rouge_score_delta"] for r in scores.compare_runs(df, "a").collect()}
    assert got == {"a": 0.0, "b": -2.0}


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_ngram_against_plain_counts(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(ngram, "HOT_ROWS", hot)
    model = ngram.fit_ngram(corpus, k=0.5)
    texts = spark.createDataFrame([(1, "the cat sat"), (2, "new words the the"), (3, "")], "key long, text string")
    got = {r["key"]: r for r in ngram.ngram_nll(texts, model, "key", max_tokens=3).collect()}
    grams = [g for t in TEXTS for g in zip([ngram.START, *words(t.lower())], words(t.lower()))]
    v = len({w for _, w in grams}) + 1
    for key, t in [(1, "the cat sat"), (2, "new words the the"), (3, "")]:
        mine = words(t)[:3]
        nll = 0.0
        for g in zip([ngram.START, *mine], mine):
            nll -= math.log((grams.count(g) + 0.5) / (sum(x[0] == g[0] for x in grams) + 0.5 * v))
        assert got[key]["n_tokens"] == len(mine)
        assert got[key]["nll"] == pytest.approx(nll)


def test_place_is_a_join_key(spark, corpus, monkeypatch):
    """Rows of frequent keys must not meet in one task of the second join."""
    monkeypatch.setattr(ngram, "HOT_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        counts = spark.createDataFrame([("the", 5), ("cat", 1)], "w1 string, n long")
        texts = spark.range(100).withColumn("w1", F.lit("the"))
        out = ngram.lookup_counts(texts, counts, ["w1"], "found")
        assert out.filter("found = 5").count() == 100
        plan = out._jdf.queryExecution().executedPlan().toString()
        join = [x for x in plan.splitlines() if "SortMergeJoin" in x][0]
        assert "_place" in join.split("LeftOuter")[0].split("[", 2)[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("n", [1, 3, 10, 500])
def test_most_frequent(spark, n):
    from corvane.operators.top import most_frequent

    rnd = random.Random(n)
    rows = [(f"t{i}", int(rnd.paretovariate(0.7))) for i in range(400)]
    df = spark.createDataFrame(rows, "token string, rows long")
    got = [tuple(r) for r in most_frequent(df, n, "rows", "token").collect()]
    assert got == sorted(rows, key=lambda r: (-r[1], r[0]))[:n]


def test_predict_and_embed(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("prompt"))
    sizes = lambda: lambda prompts: [str(len(prompts))] * len(prompts)
    got = [int(r["prediction"]) for r in predict(df.coalesce(1), sizes, batch_size=16).collect()]
    assert sorted(set(got)) == [2, 16] and len(got) == 50
    vectors = embed_tokens(df, lambda: lambda texts: [[[float(len(t))]] for t in texts], "prompt", "v")
    assert vectors.first()["v"] == [[1.0]]


LISTING = [
    "root_ok/adapter_config.json",
    "root_ok/adapter_model.bin",
    "root_ok/checkpoint-5/adapter_config.json",
    "newest_bad/checkpoint-9/adapter_config.json",
    "newest_bad/checkpoint-9/adapter_model.safetensors",
    "newest_bad/checkpoint-10/adapter_config.json",
    "newest_bad/checkpoint-100/README.md",
    "fixable/adapter_config.json",
    "fixable/checkpoint-2/adapter_config.json",
    "fixable/checkpoint-2/adapter_model.safetensors",
    "fixable/checkpoint-2/adapter_model.bin",
    "fixable/checkpoint-2/tokenizer.json",
    "fixable/checkpoint-2/optimizer.pt",
    "fixable/checkpoint-2/deep/adapter_model.bin",
    "empty/README.md",
    "odd/checkpoint-abc/adapter_config.json",
    "odd/checkpoint-1/adapter_config.json",
    "odd/checkpoint-1/adapter_model.bin",
    ".hidden/adapter_config.json",
    "loose.txt",
]


def test_artifacts(spark):
    df = spark.createDataFrame([(f"/x/adapters/{p}", 10) for p in LISTING], "path string, length long")
    files = artifacts.parse_listing(df, "/x/adapters")
    valid = artifacts.artifact_validity(files)
    state = {(r["adapter"], r["checkpoint"]): (r["valid"], r["reason"]) for r in valid.collect()}
    assert state["root_ok", None] == (True, None)
    assert state["newest_bad", "checkpoint-10"] == (False, "missing model file")
    assert state["newest_bad", "checkpoint-100"] == (False, "missing config")
    assert (".hidden", None) not in state
    latest = dict(map(tuple, artifacts.latest_checkpoint(valid).collect()))
    assert latest == {"root_ok": "root", "newest_bad": None, "fixable": "root", "empty": None, "odd": None}
    best = dict(map(tuple, artifacts.resolved_artifact(valid).collect()))
    assert best == {"root_ok": "root", "newest_bad": "checkpoint-9", "fixable": "checkpoint-2", "empty": None, "odd": None}
    report = {r["adapter"]: (r["status"], r["latest"]) for r in artifacts.artifact_report(valid).collect()}
    assert report["root_ok"][0] == "valid" and report["empty"] == ("no_checkpoints", None)
    assert report["fixable"] == ("needs_fix", "checkpoint-2") and report["newest_bad"] == ("needs_fix", "checkpoint-100")
    plan = {(r["adapter"], r["file"]) for r in artifacts.repair_plan(files, valid).collect()}
    assert plan == {("fixable", "adapter_config.json"), ("fixable", "adapter_model.safetensors"), ("fixable", "tokenizer.json")}
    kept = artifacts.retained(valid, 2)
    assert {r["checkpoint"] for r in kept.filter("adapter = 'newest_bad'").collect()} == {"checkpoint-100", "checkpoint-10"}
    assert "WindowGroupLimit" in plan_of(kept)


def test_log_lines(spark):
    head = "2024-05-01 10:00:00 | INFO     | __main__:report:7 - "
    rows = [
        head + "Step 10 | loss: 1.2500, learning_rate: 0.0001, epoch: 0.1",
        head + "Evaluation at step 10",
        head + "  eval_loss: 1.0000",
        head + "Step 20 | note: none, loss: 1.0",
        "no log line",
    ]
    df = spark.createDataFrame([("r", x) for x in rows], "run string, line string")
    got = sorted((r["step"], r["metric"], r["value"]) for r in telemetry.parse_log(df).collect())
    assert got == [(10, "epoch", 0.1), (10, "learning_rate", 0.0001), (10, "loss", 1.25), (20, "loss", 1.0)]


def test_prepare_end_to_end(spark):
    lines = spark.range(120).select(
        "id",
        F.when(F.col("id") % 10 == 0, F.lit("{broken"))
        .otherwise(F.to_json(F.struct(F.repeat(F.lit("word "), (F.col("id") % 7 + 1).cast("int")).alias("text"))))
        .alias("line"),
    )
    options = PrepareOptions(max_length=5, max_samples=100, eval_ratio=0.1, batch_size=4, pad_multiple=8)
    done = prepare(lines, "id", options)
    assert done.rejects.count() == 12 and done.counts.first()["valid_rows"] == 108
    sizes = {r["split"]: r["count"] for r in done.examples.groupBy("split").count().collect()}
    assert sizes == {"train": 90, "eval": 10}
    rows = done.batches.collect()
    assert len(rows) == 90 and all(len(r["labels"]) == r["pad_len"] == 8 for r in rows)
    assert done.tokenized.filter("size(input_ids) > 5").isEmpty()


def test_converse(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "w " * 3000)], "conv_id long, turn long, role string, text string")
    out = converse(df, lambda: lambda prompts: [p.upper() for p in prompts]).collect()
    assert [(r["turn"], r["prediction"]) for r in out] == [(0, "USER: HI\nASSISTANT:")]
