"""Kneser-Ney models against a plain implementation; accuracy on held-out documents."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import language

SCHEMA = "doc_id long, text string, lang string, best string, _text string"
WORDS = {
    "aa": "the of and to in is that it was for on with as his they at be this from have".split(),
    "bb": "der die und das nicht ein ist mit sich des auf für als auch es an werden aus er hat".split(),
    "cc": "de la que el en y los se del las un por con no una su para es al lo".split(),
}


def rows(count=240):
    draw = random.Random(3)
    out = []
    for i in range(count):
        lang = draw.choice(list(WORDS))
        words = ["".join(draw.choices(WORDS[lang], k=draw.randint(1, 2))) for _ in range(draw.randint(5, 60))]
        out.append((i, " ".join(words).capitalize() + ".", lang))
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, lang, "x", "y") for i, t, lang in data], SCHEMA)


def plain_kneser_ney(texts):
    """Probability of a character after up to three others, by the textbook."""
    raw = Counter()
    for text in texts:
        for word in language.LETTERS.findall(text.lower()):
            s = f" {word} "
            for end in range(2, len(s) + 1):
                for k in range(1, min(4, end) + 1):
                    raw[s[end - k : end]] += 1
    kinds = Counter(g[1:] for g in raw if len(g) > 1)
    count = {g: n if len(g) == 4 or (len(g) > 1 and g[0] == " ") else kinds.get(g, n) for g, n in raw.items()}
    discount = {}
    for size in range(1, 5):
        one, two = (sum(c == x for g, c in count.items() if len(g) == size) for x in (1, 2))
        discount[size] = max(0.1, one / (one + 2 * two) if one + two else 0.5)
    total, follow = Counter(), Counter()
    for g, c in count.items():
        total[g[:-1]] += c
        follow[g[:-1]] += 1

    def probability(context, char):
        p = 1 / language.ALPHABET
        for k in range(0, len(context) + 1):
            h = context[len(context) - k :]
            if total[h]:
                d = discount[k + 1]
                p = max(count.get(h + char, 0) - d, 0) / total[h] + d * follow[h] / total[h] * p
        return p

    return probability


def test_models_are_kneser_ney(spark):
    data = rows(90)
    df = frame(spark, data)
    learn = F.lit(True)
    models = language.fit(df, learn, documents=1000)
    kept = defaultdict(list)
    for r in language._sample(df, learn, 1000).collect():
        if not r["calibrates"]:
            kept[r["lang"]].append(r["text"])
    assert models.languages == sorted(WORDS)
    words = ["the", "nicht", "zzqé", "quela", "a", "ististist"]
    cost, letters = models.costs([w.encode() for w in words])
    assert letters.tolist() == [len(w) + 1 for w in words]
    for column, lang in enumerate(models.languages):
        probability = plain_kneser_ney(kept[lang])
        for row, word in enumerate(words):
            s = f" {word} "
            want = -sum(math.log(probability(s[max(0, i - 3) : i], s[i])) for i in range(1, len(s)))
            assert cost[row, column] == pytest.approx(want, rel=1e-4)


def test_held_out_documents_and_odd_texts(spark):
    data = rows()
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "123 ... !! ½ ² Ⅷ _", None), (903, "жзийклмн опрст уфхц " * 9, None)]
    odd += [(904, "the of and to in " * 30000, None), (905, "the of and to in it is", None), (None, "der die das und", None)]
    df = frame(spark, data + odd + [data[0]])
    held_out = language.F.col("doc_id") % 5 == 0
    models = language.fit(df, ~held_out)
    got = [r.asDict() for r in language.identify(df, models, ["doc_id", "lang"]).collect()]
    assert len(got) == len(data) + len(odd) + 1 and all(0 <= r["score"] <= 1 for r in got)
    tested = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 5 == 0]
    assert np.mean([r["lang"] == r["lang_pred"] for r in tested]) > 0.97
    assert not any(r["rejected"] for r in tested)
    found = {r["doc_id"]: r for r in got}
    for doc in (900, 901, 902):
        assert (found[doc]["lang_pred"], found[doc]["score"], found[doc]["rejected"]) == ("und", 0.0, True)
    assert found[903]["rejected"] and found[903]["lang_pred"] in WORDS
    assert found[904]["lang_pred"] == found[905]["lang_pred"] == "aa" and found[None]["lang_pred"] == "bb"
    kept = language.identified(df, models)
    assert kept.columns == df.columns and dict(kept.dtypes) == dict(df.dtypes)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["rejected"]}


def test_nothing_to_learn_from(spark):
    df = frame(spark, rows(5))
    models = language.fit(df, F.lit(False))
    assert {r["lang_pred"] for r in language.identify(df, models, ["doc_id"]).collect()} == {"und"}
    models = language.fit(df, F.lit(True))
    assert language.identify(df.limit(0), models, ["doc_id"]).collect() == []


def test_a_repeated_id_counts_once_in_the_sample(spark):
    """One document repeated more often than the sample has places leaves room for the others."""
    data = [(i, f"{WORDS['aa'][i % 20]} word{'abcdefghij'[i % 10]}", "aa") for i in range(60)]
    df = frame(spark, data + [(7, "der die das", "aa")] * 300)
    sample = language._sample(df, F.lit(True), 50).collect()
    assert len(sample) == 50
    assert len({r["text"] for r in sample}) > 10


def test_all_ngrams_of_the_sample_are_kept(spark):
    """A small language beside a large one keeps its rarest n-grams, so each model stays a distribution."""
    draw = random.Random(1)
    big = [(i, " ".join("".join(draw.choices("abcdefghijkl", k=6)) for _ in range(80)), "aa") for i in range(40)]
    df = frame(spark, big + [(1000 + i, "zwq " * 3 + "wzq", "bb") for i in range(5)])
    models = language.fit(df, F.lit(True))
    for gram in ("z", "zw", "zwq", "zwq ", " wzq", "wzq", "wzq "):
        at = int(np.searchsorted(models.hashes, np.uint64(language.gram_hash(gram))))
        assert models.hashes[at] == language.gram_hash(gram)
