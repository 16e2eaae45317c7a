import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from corvane.operators.ingest import parse_record
from corvane.session import scratch_dir
from corvane.sources import catalog, files, locator, logs, sinks


def put(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    text = "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n"
    if path.endswith(".gz"):
        with gzip.open(path, "wt", encoding="utf-8") as f:
            f.write(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("data"))
    put(f"{base}/shards/train-00000-of-00002.jsonl.gz", [{"text": "a"}, {"text": "b"}])
    put(f"{base}/shards/train-00001-of-00002.jsonl", [{"text": "c"}])
    put(f"{base}/shards/test-00000-of-00001.json", [{"text": "d"}])
    put(f"{base}/loose/one.jsonl", [{"text": "e"}, {"text": "f"}])
    put(f"{base}/loose/deep/two.jsonl", [{"text": "g"}])
    put(f"{base}/loose/notes.md", ["not data"])
    put(f"{base}/described/train-0.jsonl", [{"text": "h"}])
    info = {"default": {"splits": {"train": {"num_examples": 7}, "test": {"num_examples": 3}}}, "other": {"splits": {}}}
    put(f"{base}/described/dataset_infos.json", [info])
    put(f"{base}/empty/readme.txt", ["x"])
    return base


def texts(df):
    got = df.select(parse_record(F.col("line"))["text"].alias("t")).collect()
    return sorted(r["t"] for r in got)


def test_shards(spark, root):
    assert texts(files.read_split_files(spark, f"{root}/shards", "train")) == ["a", "b", "c"]
    with pytest.raises(FileNotFoundError):
        files.read_split_files(spark, f"{root}/shards", "dev")


def test_line_order_is_file_order(spark, root):
    rows = files.read_split_files(spark, f"{root}/shards", "train").orderBy("file", "block", "seq").collect()
    assert [json.loads(r["line"])["text"] for r in rows] == ["a", "b", "c"]


def test_globs(spark, root):
    assert texts(files.read_jsonl(spark, f"{root}/loose/*.jsonl")) == ["e", "f"]
    assert texts(files.read_jsonl(spark, f"{root}/loose/**/*.jsonl")) == ["e", "f", "g"]
    for missing in (f"{root}/loose/*.csv", f"{root}/none/**/*.jsonl", f"{root}/empty/**/*.jsonl"):
        with pytest.raises(FileNotFoundError):
            files.read_jsonl(spark, missing)


def test_json_list_files(spark, root):
    path = f"{root}/lists/all.json"
    os.makedirs(os.path.dirname(path))
    with open(path, "w", encoding="utf-8") as f:
        json.dump([{"text": "x"}, {"text": "y\n"}], f, indent=2)
    rows = files.read_lines(spark, [path])
    assert texts(rows) == ["x", "y\n"]
    assert rows.columns == ["file", "block", "seq", "line"]


def test_json_files_may_be_lists_or_lines(spark, tmp_path):
    base = str(tmp_path)
    put(f"{base}/in/a b/deep/list.json", [json.dumps([{"text": "p"}, {"text": "q\n"}], indent=1)])
    put(f"{base}/in/c/deep/lines.json", [{"text": "r"}, "[1]", {"text": "s"}])
    put(f"{base}/in/c/deep/odd.json", ["[1, 2]", {"text": "t"}])
    put(f"{base}/in/c/other/no.json", [{"text": "u"}])
    rows = files.read_jsonl(spark, f"{base}/in/**/deep/*.json")
    got = [parse for parse in (json.loads(r["line"]) for r in rows.collect())]
    assert sorted(g["text"] for g in got if isinstance(g, dict)) == ["p", "q\n", "r", "s", "t"]
    assert sum(isinstance(g, list) for g in got) == 2
    assert rows.columns == ["file", "block", "seq", "line"]
    numbers = files.number_lines(rows.filter(F.col("file").endswith("list.json"))).orderBy("number").collect()
    assert [r["number"] for r in numbers] == [1, 2]


def test_globs_as_patterns():
    import re

    for glob, good, bad in [
        ("*.json", "a.json", "a/b.json"), ("**/x/*.j", "a/b/x/c.j", "a/b/c.j"), ("a?[!b-d].t", "axe.t", "axc.t"),
        ("**/*.x", "a/b.x", "a/b.y"), ("[ab]/c+.x", "b/c+.x", "b/cc.x"),
    ]:
        assert re.fullmatch(files.glob_pattern(glob), good) and not re.fullmatch(files.glob_pattern(glob), bad)


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    put(f"{tmp_path}/a.jsonl", [{"id": i, "text": "x" * (i % 97)} for i in range(5000)])
    put(f"{tmp_path}/b.jsonl", [{"id": 9000 + i} for i in range(3)])
    found = []
    for size in ("20k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.number_lines(files.read_jsonl(spark, f"{tmp_path}/*.jsonl")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        found.append(sorted((r["file"], r["number"], r["line"]) for r in rows))
    assert found[0] == found[1]
    assert [json.loads(line)["id"] for _, _, line in found[0]] == [*range(5000), *range(9000, 9003)]


@pytest.mark.parametrize("after", [',{"\\u0001":"end"}] garbage', ',{"\\u0001":"end"}]', "]", "}", ",", '"', " x", "] x", "] , [{\"text\":\"b\"}", ',{"text":"b"}', ", 1", "[", "{"])
def test_nothing_may_follow_a_record(spark, after):
    lines = ['{"text":"a"}' + after, '{"text":"a"}', "", " ", "1", "null", "[]", '[{"text":"a"}]', ' {"text": "a"} ']
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    got = [r[0] for r in df.select(parse_record(F.col("line"))).collect()]
    assert got == [None, {"text": "a"}, None, None, None, None, None, None, {"text": "a"}]


def test_locators(spark, root):
    assert texts(locator.read_dataset(spark, f"hf_files:{root}/shards:test")) == ["d"]
    assert texts(locator.read_dataset(spark, f"hf_files:{root}/shards")) == ["a", "b", "c"]
    assert texts(locator.read_dataset(spark, f"hf_files:file:{root}/shards:test")) == ["d"]
    assert texts(locator.read_dataset(spark, f"{root}/loose/*.jsonl")) == ["e", "f"]
    spark.range(3).withColumn("split", F.lit("train")).createOrReplaceTempView("small")
    assert locator.read_named(spark, "small").count() == 3
    assert locator.read_named(spark, "small", "test").count() == 0


def test_columnar(spark, root):
    for split, n in (("train", 4), ("test", 2)):
        spark.range(n).write.parquet(f"{root}/columnar/{split}")
    spark.range(5).write.parquet(f"{root}/single")
    assert locator.read_dataset(spark, f"hf:{root}/columnar:test").count() == 2
    assert locator.read_dataset(spark, f"hf:{root}/columnar").count() == 4
    assert locator.read_dataset(spark, f"hf:{root}/single").count() == 5
    with pytest.raises(ValueError, match="test, train"):
        locator.read_columnar(spark, f"{root}/columnar", "dev")
    assert locator.read_columnar(spark, f"{root}/columnar", "dev", strict=False).count() == 6
    with pytest.raises(FileNotFoundError):
        locator.read_columnar(spark, f"{root}/empty")


def test_evaluation_source(spark, root):
    assert texts(locator.read_evaluation(spark, f"{root}/shards", "test")) == ["d"]
    assert texts(locator.read_evaluation(spark, f"{root}/shards", "dev")) == ["a", "b", "c", "d"]
    spark.range(4).write.parquet(f"{root}/evaluation/train")
    assert locator.read_evaluation(spark, f"{root}/evaluation", "dev").count() == 4
    with pytest.raises(FileNotFoundError):
        locator.read_evaluation(spark, f"{root}/empty")


def test_catalogs(spark, root):
    found = {r["dataset"]: r["files"] for r in catalog.dataset_catalog(spark, root).collect()}
    assert found["loose"] == 2 and found["shards"] == 2 and found["described"] == 2
    assert "empty" not in found
    splits = lambda d: {r["split"]: r["rows"] for r in catalog.split_catalog(spark, f"{root}/{d}").collect()}
    assert splits("described") == {"train": 7, "test": 3}
    assert splits("shards") == {"train": 3, "test": 1}
    assert splits("loose") == {"train": 2}
    assert splits("empty") == {"train": 0}
    for split, n in (("train", 4), ("test", 2)):
        spark.range(n).write.parquet(f"{root}/tables/{split}")
    assert splits("tables") == {"train": 4, "test": 2}
    assert splits("tables/train") == {"train": 4}
    parquet = catalog.dataset_catalog(spark, root, [".parquet"])
    assert "tables" in {r["dataset"] for r in parquet.collect()}


def test_catalog_reads_no_content(spark, root):
    plan = catalog.dataset_catalog(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_unreadable_files_are_passed_over(spark, root):
    put(f"{root}/broken/train-0.jsonl", [{"text": "ok"}])
    with open(f"{root}/broken/train-1.jsonl.gz", "wb") as f:
        f.write(b"no gzip")
    assert texts(files.read_split_files(spark, f"{root}/broken", "train")) == ["ok"]


def test_scores_survive_csv(spark):
    rows = [(1, 'a "b", c\nd', " blanks "), (2, "\\n", 'x"'), (3, "é\r\ny", ",")]
    df = spark.createDataFrame(rows, "id long, p string, r string")
    path = scratch_dir(spark, "csv")
    sinks.write_scores(df, path)
    back = sinks.read_scores(spark, path, "id long, p string, r string").orderBy("id").collect()
    assert [tuple(r)[::2] for r in back] == [(i, r) for i, _, r in rows]
    assert [r["p"].replace("\r\n", "\n") for r in back] == [p.replace("\r\n", "\n") for _, p, _ in rows]


def test_summaries_round_trip(spark):
    part = F.create_map(F.lit("ROUGE-L"), F.struct(F.lit(1.0).alias("score"), F.lit(0.4).alias("weight"), F.lit(0.4).alias("contribution")))
    df = spark.range(1).select(F.lit("r").alias("run_id"), F.lit(60.0).alias("overall_score"), part.alias("score_breakdown"))
    path = scratch_dir(spark, "summary")
    sinks.write_summary(df, path)
    sinks.write_summary(df.withColumn("run_id", F.lit("s")), path)
    back = sinks.read_summaries(spark, path).orderBy("run_id").collect()
    assert [r["run_id"] for r in back] == ["r", "s"]
    assert back[0]["score_breakdown"]["ROUGE-L"]["weight"] == 0.4


def test_transcripts(spark):
    rows = [(1, 1, "b\n\nc\n"), (1, 0, "a\n"), (2, 0, "x\n")]
    df = spark.createDataFrame(rows, "conv_id long, part long, transcript string")
    path = scratch_dir(spark, "transcripts")
    sinks.write_transcripts(df, path, per_conversation=True)
    back = spark.read.text(path, wholetext=True).collect()
    assert sorted((r["conv_id"], r["part"], r["value"]) for r in back) == sorted(rows)
    path = scratch_dir(spark, "transcripts")
    sinks.write_transcripts(df, path)
    back = spark.read.json(path).select("conv_id", "part", "transcript")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_training_log_files(spark, root):
    line = "2024-05-01 10:00:00 | INFO     | __main__:report:7 - Step 10 | loss: 1.25"
    put(f"{root}/logs/run_a.log", [line])
    rows = logs.read_training_log(spark, f"{root}/logs").collect()
    assert [(r["run"], r["step"], r["value"]) for r in rows] == [("run_a", 10, 1.25)]


def test_shared_folder_comes_from_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(shared)
