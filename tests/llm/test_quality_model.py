"""Quality votes: exact cosines, held-out accuracy, odd inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import quality_model

SCHEMA = "doc_id long, text string, score string, label string"


def rows():
    draw = random.Random(12)
    out = []
    for i in range(500):
        words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 8))) for _ in range(draw.randint(8, 120))]
        good = draw.random() < 0.8
        if not good:
            kind = draw.randrange(3)
            if kind == 0:
                words = [w + draw.choice(["***", "###"]) for w in words]
            elif kind == 1:
                words = [w.upper() + "!!" for w in words]
            else:
                words = [w for w in words for _ in range(9)]
        out.append((i, " ".join(words) + ".", int(good)))
    return out


def test_scores(spark):
    data = rows()
    odd = [(900, None), (901, ""), (902, " \n"), (903, "ÉÉ " * 40000), (None, "abc def abc ghi abd")]
    docs = spark.createDataFrame([(i, t, "s", "l") for i, t, _ in data] + [(i, t, "", "") for i, t in [*odd, data[3][:2]]], SCHEMA)
    labels = [(i, y, 0) for i, _, y in data] + [(5, None, 0), (None, 1, 0), (77777, 0, 0), (1, data[1][2], 0)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    learn = F.col("doc_id") % 4 != 2
    voters = quality_model.fit(docs, marked, learn, sample=300)
    assert len(voters.labels) == 300
    got = [r.asDict() for r in quality_model.score(docs, voters, ["doc_id"]).collect()]
    assert len(got) == len(data) + len(odd) + 1
    found = {r["doc_id"]: r for r in got}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    tested = [(found[i]["predicted"], y) for i, _, y in data if i % 4 == 2]
    assert np.mean([p == y for p, y in tested]) > 0.95
    prior = float(voters.labels.mean())
    assert [found[i]["score"] for i in (900, 901, 902)] == [prior] * 3
    again = quality_model.fit(docs.repartition(5), marked.repartition(3), learn, sample=300)
    assert np.array_equal(again.labels, voters.labels) and np.allclose(again.vectors, voters.vectors, atol=1e-4)


def test_votes_are_exact():
    draw = np.random.default_rng(0)
    size = quality_model.WORDS + quality_model.SHAPES + quality_model.REPEATS
    labelled, asked = draw.random((60, size)), draw.random((7, size))
    axes = np.linalg.qr(draw.random((size, 12)))[0].astype(np.float32)
    voters = quality_model.Voters(axes, np.zeros((0, 12)), draw.integers(0, 2, 60).astype(np.float32))
    voters.vectors = voters.project(labelled)
    for row, vote in zip(asked, voters.votes(asked)):
        point = (row @ axes) / np.linalg.norm(row @ axes)
        near = sorted(((float(point @ v), y) for v, y in zip(voters.vectors, voters.labels)), reverse=True)
        near = near[: quality_model.NEIGHBOURS]
        weights = [(c / near[0][0]) ** quality_model.SHARPNESS for c, _ in near]
        assert abs(vote - sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)) < 1e-3


def test_blocks_do_not_matter(monkeypatch):
    text = " ".join(t for _, t, _ in rows()[:20]).encode()
    whole = quality_model.features(quality_model._Terms(), text)
    monkeypatch.setattr(quality_model, "word_blocks", lambda t: __import__("corvane.llm.texts").llm.texts.word_blocks(t, 64))
    assert np.array_equal(whole, quality_model.features(quality_model._Terms(), text))


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.fit(docs, none, F.lit(True)) is None
    assert quality_model.score(docs, None, ["doc_id"]).first()["score"] == 0.5
    one = quality_model.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), F.lit(True))
    assert quality_model.score(docs, one, ["doc_id"]).first()["predicted"] == 1
    assert quality_model.score(docs.limit(0), one, ["doc_id"]).collect() == []
