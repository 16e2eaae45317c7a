"""The JSON lists that src_json_list writes are bounded, and hold documents of any language or none."""

import hashlib

from pyspark.sql import functions as F

from suite import sources


def test_json_lists_are_bounded_and_whole(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " * 9, ("en", "fr", "de", None)[i % 4]) for i in range(120)]
    rows += [(None, f"nameless {i}", "de") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    read, seen = sources.files.read_jsonl, {}

    def reading(spark, path):
        found = read(spark, path)
        seen.update({r["file"]: r["count"] for r in found.groupBy("file").count().collect()})
        return found

    monkeypatch.setattr(sources.files, "read_jsonl", reading)
    monkeypatch.setattr(sources, "LIST_BYTES", 600, raising=False)
    got = {(r["doc_id"], r["digest"]) for r in sources.src_json_list(spark, str(tmp_path)).collect()}
    assert got == {(i, hashlib.md5(t.encode()).hexdigest()) for i, t, _ in rows}
    lists = [n for file, n in seen.items() if "/lists/" in file]
    assert len(lists) > 9 and max(lists) < 25
