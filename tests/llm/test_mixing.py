"""Mixing: water-filling against the iteration of its definition, and what is taken."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string, row string"


def plain_targets(sizes, weights, share, epochs):
    total = share * sum(sizes.values())
    clamped, target = set(), {}
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(epochs * sizes[s] for s in clamped)
        target = {s: epochs * sizes[s] for s in clamped}
        target |= {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if target[s] > epochs * sizes[s]}
        if not over:
            return target
        clamped |= over
        if len(clamped) == len(sizes):
            return {s: epochs * sizes[s] for s in sizes}


@pytest.mark.parametrize("share", [0.3, 1.0, 2.9, 50.0])
def test_water_filling(spark, share):
    draw = random.Random(share)
    sizes = {f"s{i:02}": draw.choice([0, 1, 7, 90, 1000, 50000]) for i in range(17)}
    weights = {s: float(i % 3 + 1) for i, s in enumerate(sorted(sizes))}
    rows = [(s, n) for s, n in sizes.items()]
    sources = mixing.weigh(spark.createDataFrame(rows, "source string, source_size long"), (1.0, 2.0, 3.0))
    got = {r["source"]: r for r in mixing.water_fill(sources, share, 3.0).collect()}
    want = plain_targets(sizes, weights, share, 3.0)
    for s in sizes:
        assert got[s]["weight"] == weights[s]
        assert got[s]["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-6)


def table(spark, sources=9, docs=1500):
    draw = random.Random(1)
    rows = []
    for i in range(docs):
        source = draw.choice([None, "é", "Z", "a", *(f"s{j}" for j in range(sources))]) if i % 3 else "hot"
        text = draw.choice([None, "", " \n", "w " * draw.randint(1, 200), "one\x0btwo\x1cthree"])
        rows.append((i, text, source, -1, "x", "y"))
    rows += [rows[10], (None, "a b c", "s1", 0, "", ""), (None, "a b", None, 0, "", "")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_what_is_taken(spark):
    df, rows = table(spark)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["source"] or "", r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    taken, per = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["times"]
        taken[r["source"]] += r["taken"]
        per[r["source"]] = (r["target"], r["source_size"])
    for source, (target, size) in per.items():
        assert abs(taken[source] - target) <= 200 and target <= 3 * size + 1e-6
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and dict(mixed.dtypes) == dict(df.dtypes)
    times = defaultdict(int)
    for r in mixed.collect():
        times[r["doc_id"], r["source"], r["text"]] += 1
    want = defaultdict(int)
    for r, row in ((r, x) for r in got for x in rows if x[0] == r["doc_id"] and x[2] == r["source"]):
        want[row[0], row[2], row[1]] += r["times"] if row[0] != 10 and row[0] is not None else 0
    for k, n in want.items():
        if k[0] not in (10, None):
            assert times.get(k, 0) == n


def test_order_of_sources_and_empty(spark):
    rows = [(s, 1) for s in ["b", None, "Z", "é", "a", "\U0001f600", "｡"]]
    found = mixing.weigh(spark.createDataFrame(rows, "source string, source_size long"), (1.0, 2.0, 3.0))
    assert {r["source"]: r["weight"] for r in found.collect()} == {
        "Z": 1, "a": 2, "b": 3, "é": 1, "｡": 2, "\U0001f600": 3, None: 1,
    }
    df, _ = table(spark, docs=20)
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mixed(df.limit(0)).collect() == []
    empty = df.withColumn("text", F.lit(None).cast("string"))
    assert {r["taken"] for r in mixing.mix(empty).collect()} == {0}
