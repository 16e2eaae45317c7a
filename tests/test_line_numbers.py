"""Line numbers of many small splits."""

from corvane.sources import files
from suite import sources
from tests.test_plans import plan_of

TINY = "/root/testdata/sf0.001"


def test_texts_are_read_once(spark, monkeypatch):
    """What is counted and numbered are stored places, not the texts again."""
    seen = []
    number = files.number_lines

    def watched(lines):
        seen.append((plan_of(lines), lines.columns))
        return number(lines)

    monkeypatch.setattr(files, "number_lines", watched)
    rows = sources.src_line_numbers(spark, TINY)
    documents = spark.read.parquet(f"{TINY}/documents.parquet").count()
    assert rows.count() == rows.select("lang", "source", "number").distinct().count() == documents
    [(plan, columns)] = seen
    assert "FileScan text" not in plan and "line" not in columns
