"""Bigrams of a corpus whose splits hold much text."""

from collections import Counter

from corvane.operators import ngram


def test_large_splits_are_counted_in_shares(spark, monkeypatch):
    """One split of many texts, copies among them: what a task combines is bounded, the counts are the same."""
    texts = [f"w{i % 7} w{i % 5} x" for i in range(300)] + ["same text"] * 100 + [None, ""]
    corpus = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    monkeypatch.setattr(ngram, "TEXT", 1000, raising=False)
    shares = []
    bigrams = ngram._bigrams

    def watched(df, *rest):
        shares.extend(df.rdd.mapPartitions(lambda rows: [sum(len(r["text"] or "") for r in rows)]).collect())
        return bigrams(df, *rest)

    monkeypatch.setattr(ngram, "_bigrams", watched)
    model = ngram.fit_ngram(corpus)
    assert sum(shares) == sum(len(t or "") for t in texts) and max(shares) < 2000
    words = [(t or "").split() for t in texts]
    grams = Counter(g for w in words for g in zip([ngram.START, *w], w))
    assert {(r["w1"], r["w2"]): r["n"] for r in model.pairs.collect()} == grams
    assert model.vocabulary.first()["v"] == len({b for _, b in grams}) + 1
