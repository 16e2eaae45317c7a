"""The pipeline's stages against plain versions, each on what its predecessor kept."""

import os
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from test_packing import plain_ids
from test_simhash import plain_groups

from corvane.llm.queries import QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="tables are not there")
def test_pipeline_against_plain_versions(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    con = duckdb.connect()

    def run(name, df):
        out = stages[name](spark, df, TABLES).persist()
        return out, out.toPandas()

    known, frame = run("language ID", docs)
    every = docs.toPandas()
    # Whatever is written with letters here is in one of the table's languages.
    assert sorted(frame["doc_id"]) == sorted(every[every["text"].str.contains(r"[^\W\d_]")]["doc_id"])

    con.register("documents", frame)
    rules = con.execute(QUERIES["op8_quality_rules"][1]).fetchdf().set_index("doc_id")
    good, kept = run("quality rules", known)
    assert sorted(kept["doc_id"]) == sorted(rules.index[rules["kept"]])
    before = dict(zip(frame["doc_id"], frame["text"]))
    for doc, text, n_chars in zip(kept["doc_id"], kept["text"], kept["n_chars"]):
        left = iter(before[doc].split("\n"))
        assert all(line in left for line in text.split("\n")) and len(text) == n_chars
        assert len(text.split()) == rules.loc[doc, "kept_words"]

    single, one = run("SimHash near-dedup", good)
    groups = plain_groups(list(zip(kept["doc_id"].tolist(), kept["text"])))
    assert sorted(one["doc_id"]) == sorted({g for _, _, g in groups})

    con.unregister("documents")
    con.register("documents", one)
    times = con.execute(QUERIES["op6_mixing"][1]).fetchdf()
    mixed, many = run("mixing sources to target weights", single)
    want = {d: int(n) for d, n in zip(times["doc_id"], times["times"]) if n}
    assert Counter(many["doc_id"].tolist()) == Counter(want)

    _, pieces = run("packing", mixed)
    ids = {doc: plain_ids(text) for doc, text in zip(many["doc_id"], many["text"])}
    got = pieces.groupby("doc_id")["length"].sum().to_dict()
    assert got == {doc: len(ids[doc]) * n for doc, n in want.items()}
    room = pieces.sort_values("offset").groupby("sequence_id")["length"]
    assert room.sum().max() <= 2048
    gapless = pieces.sort_values("offset").groupby("sequence_id")["length"].cumsum() - pieces["length"]
    assert (gapless == pieces["offset"]).all()
