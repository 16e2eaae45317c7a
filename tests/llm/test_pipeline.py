"""Registered queries of the operators, and the pipeline stage by stage."""

import glob
import os
import random
import subprocess
import sys

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from corvane.llm import mixing, simhash
from corvane.llm.queries import QUERIES
from tools.check import rows_of

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="tables are not there")


def test_every_operator_has_one_query():
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted(f"op{n}" for n in range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(registered.queries())


@needs_tables
@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = registered.queries()[name](spark, TABLES).toPandas(), con.execute(QUERIES[name][1]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def documents(spark):
    draw = random.Random(1)
    pool = "fox ran over hills while birds sang about summer rain warm bread and old stories of the quiet town".split()
    line = lambda: " ".join(draw.choices(pool, k=12)).capitalize() + "."
    rows = []
    for i in range(120):
        text = "\n".join(line() for _ in range(4))
        rows.append((i, text, "en", f"s{i % 5}", len(text), "k"))
    rows += [(200 + i, rows[i][1].upper(), "en", "s0", 9, "k") for i in range(30)]  # copies but for case
    rows += [(300, None, None, None, None, None), (301, "", "en", "s1", 0, "k"), (302, "12 34 " * 30, "en", "s1", 0, "k")]
    rows += [(303, "WOW!! THIS!! " * 30, "en", None, 0, "k"), (304, "too short", "en", "s2", 0, "k"), rows[7], rows[7]]
    rows += [(None, line() + line() + line(), "en", "s1", 0, "k")]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_keep_columns_and_take_effect(spark):
    docs = documents(spark)
    out = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").persist()
        assert [f.name for f in docs.schema] == [f.name for f in documents(spark).schema]
        out.append({r["doc_id"] for r in docs.collect()})
        last = docs
    assert not out[0] & {300, 301, 302} and set(range(120)) <= out[0]
    assert not out[1] & {303, 304} and set(range(120)) <= out[1]
    assert set(range(120)) <= out[2] and not any(200 + i in out[2] for i in range(30)) and None in out[2]
    assert out[3] <= out[2]
    name, pack = corpus_pipeline.STAGES[-1]
    pieces = pack(spark, last, "")
    assert pieces.filter(F.col("start") == 0).count() == last.count()


def test_empty_documents_go_through(spark):
    docs = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []


def test_run_is_its_stages(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    steps = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        steps = stage(spark, steps, str(tmp_path))
    pick = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    key = lambda df: sorted(map(str, df.select(*pick).collect()))
    assert key(got) == key(steps) and got.count() > 100


@needs_tables
def test_dedup_and_mix_agree_with_their_queries(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    kept = {r["doc_id"] for r in simhash.deduplicated(docs).select("doc_id").collect()}
    assert kept == {r["component_id"] for r in simhash.grouped(docs).collect()}
    times = {r["doc_id"]: r["times"] for r in mixing.mix(docs).collect()}
    counted = {r["doc_id"]: r["count"] for r in mixing.mixed(docs).groupBy("doc_id").count().collect()}
    assert counted == {d: n for d, n in times.items() if n}


def test_the_rest_works_without_these_folders():
    """The entry imports where the operators' modules cannot be found."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[:2] == ['corvane', 'llm'] or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'messages' in names and not any(n.startswith('op') and n[2].isdigit() for n in names)\n"
        "assert 'pipeline' not in names\n"
    )
    root = os.path.dirname(os.path.abspath(registered.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
