"""Arrow datasets with a description: the same rows as Parquet, many partitions of one file, strict splits."""

import datetime
import json
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.sources import arrow
from corvane.sources.locator import read_columnar, read_dataset, read_evaluation


def frame(spark, count=5000):
    rows = spark.range(count).select(
        F.col("id"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("text é "), "id")).alias("text"),
        F.when(F.col("id") % 5 != 0, F.array(F.lit("a"), F.lit(None).cast("string"), F.col("id").cast("string"))).alias("parts"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("msg"),
        F.timestamp_seconds(F.col("id") * 1000).alias("at"),
        F.date_add(F.lit(datetime.date(2020, 1, 1)), F.col("id").cast("int") % 400).alias("day"),
        (F.col("id") / 3).alias("x"),
        F.encode(F.col("id").cast("string"), "utf-8").alias("raw"),
        (F.col("id") % 2 == 0).alias("ok"),
    )
    return rows


def same(got, want):
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(got) == key(want)


def test_rows_come_back_from_many_partitions_of_one_file(spark, tmp_path):
    want = frame(spark)
    arrow.write_arrow(want.coalesce(1), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.arrow"))) == 1
    got = arrow.read_arrow(spark, str(tmp_path / "one"), range_bytes=40_000)
    assert got.rdd.getNumPartitions() > 5
    same(got, want)
    counts = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) > 3  # several partitions have rows
    same(arrow.read_arrow(spark, str(tmp_path / "one"), columns=["x", "text"]), want.select("x", "text"))
    with pytest.raises(FileExistsError):
        arrow.write_arrow(want, str(tmp_path / "one"))


def test_splits_are_strict(spark, tmp_path):
    rows = frame(spark, 300)
    parts = {"train": rows.filter("id < 200"), "test": rows.filter("id >= 200")}
    path = str(tmp_path / "two")
    arrow.write_arrow_splits(parts, path)
    same(read_dataset(spark, f"hf:{path}:test"), parts["test"])
    same(read_dataset(spark, f"hf:{path}"), parts["train"])
    with pytest.raises(ValueError, match="train, test and not dev"):
        read_dataset(spark, f"hf:{path}:dev")
    same(read_evaluation(spark, path, "dev"), rows)
    same(read_columnar(spark, f"file:{path}", "test"), parts["test"])
    with pytest.raises(FileNotFoundError):
        arrow.read_arrow(spark, str(tmp_path))
    (tmp_path / "two" / "test" / "data-left-over.arrow").write_bytes(b"not named by the description")
    same(read_dataset(spark, f"hf:{path}:test"), parts["test"])


def test_files_of_other_writers(spark, tmp_path):
    """Types that Spark lacks, dictionaries, old headers and several files, written with pyarrow alone."""
    kinds = {
        "u8": pa.array([1, None, 255], pa.uint8()),
        "u64": pa.array([1, 2**64 - 1, None], pa.uint64()),
        "big": pa.array(["a", None, "c"], pa.large_string()),
        "none": pa.nulls(3),
        "half": pa.array([0.5, None, 2.0], pa.float16()),
        "word": pa.array(["x", "y", "x"]).dictionary_encode(),
        "list": pa.array([[1], [], None], pa.large_list(pa.uint16())),
        "when": pa.array([1, None, 3], pa.timestamp("s")),
        "item": pa.array([{"a": 1, "b": ["q"]}, None, {"a": None, "b": []}], pa.struct({"a": pa.int8(), "b": pa.list_(pa.string())})),
    }
    batch = pa.RecordBatch.from_pydict(kinds)
    for n, legacy in enumerate([False, True]):
        options = pa.ipc.IpcWriteOptions(use_legacy_format=legacy)
        with pa.OSFile(str(tmp_path / f"data-{n}.arrow"), "wb") as out, pa.ipc.new_stream(out, batch.schema, options=options) as stream:
            for _ in range(4):
                stream.write_batch(batch)
    (tmp_path / "state.json").write_text(json.dumps({"_data_files": [{"filename": f"data-{n}.arrow"} for n in (0, 1)]}))
    got = arrow.read_arrow(spark, str(tmp_path), range_bytes=2_000)
    rows = sorted(map(repr, got.collect()))
    one = got.first().asDict(recursive=True)
    assert len(rows) == 24 and len(set(rows)) == 3
    assert {k: one[k] for k in ("u8", "u64", "big", "none", "half", "word", "list")} == {
        "u8": 1, "u64": Decimal(1), "big": "a", "none": None, "half": 0.5, "word": "x", "list": [1],
    }
    assert one["item"] == {"a": 1, "b": ["q"]}
    assert [r["word"] for r in arrow.read_arrow(spark, str(tmp_path), columns=["word"]).limit(2).collect()] == ["x", "y"]


def test_a_missing_file_is_an_error(spark, tmp_path):
    arrow.write_arrow(frame(spark, 10).coalesce(1), str(tmp_path / "d"))
    state = json.loads((tmp_path / "d" / "state.json").read_text())
    state["_data_files"].append({"filename": "data-gone.arrow"})
    (tmp_path / "d" / "state.json").write_text(json.dumps(state))
    with pytest.raises(Exception, match="which is not there"):
        arrow.read_arrow(spark, str(tmp_path / "d")).collect()


def test_empty_datasets(spark, tmp_path):
    arrow.write_arrow(frame(spark, 10).filter("id < 0"), str(tmp_path / "e"))
    same(arrow.read_arrow(spark, str(tmp_path / "e")), frame(spark, 10).filter("id < 0"))
