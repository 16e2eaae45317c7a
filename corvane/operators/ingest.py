"""Permissive ingest of JSON lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import fixed
from corvane.functions.let import let
from corvane.functions.records import accepted, messages_of
from corvane.operators.once import once

JSON_OPTIONS = {"allowSingleQuotes": "false"}
RECORD_TYPE = "map<string,string>"
MARK = "\x01"  # the key of what stands after a line


@dataclass(frozen=True)
class Ingested:
    """``good`` has a ``record`` column, ``rejects`` the line and a ``reason``."""

    good: DataFrame
    rejects: DataFrame
    counts: DataFrame


class NoRowsError(ValueError):
    """Nothing valid is left and the caller asked for rows."""


def parse_record(line: Column) -> Column:
    """Map from key to value; NULL unless the line is exactly one JSON object.

    The line is read as the first of a list's two elements, the second being a
    mark: whatever closes, continues or follows the object moves the mark from
    its place or breaks the list. The mark holds the line's own digest, so that no
    line can bring it along. Of a repeated key the last value stands.
    """
    own = F.md5(line)
    marked = F.concat(F.lit("["), line, F.lit(',{"\\u0001":"'), own, F.lit('"}]'))
    listed = F.from_json(marked, f"array<{RECORD_TYPE}>", JSON_OPTIONS)

    def first(found: Column) -> Column:
        in_place = F.get(found, F.lit(1))[MARK] == own
        return F.when((F.size(found) == 2) & in_place, F.get(found, F.lit(0)))

    return let(let(listed, first), _last_of_each_key)


def _last_of_each_key(record: Column) -> Column:
    entries = F.map_entries(record)
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]
        ),
    )
    repeated = F.size(F.array_distinct(F.map_keys(record))) < F.size(record)
    return F.when(repeated, F.map_from_entries(last)).otherwise(record)


def with_record(lines: DataFrame, line: str = "line", permissive: bool = True) -> DataFrame:
    """Add ``record`` and ``reason``; the reason is NULL for rows to keep.

    Permissive ingest, the way out when records do not agree, keeps only the
    known training shapes; with ``permissive=False`` every object is kept and
    rendered by whatever shape it has.
    """
    parsed = once(lines, record=parse_record(F.col(line)))
    record = F.col("record")
    return parsed.withColumn(
        "reason",
        F.when(record.isNull(), "malformed").when(
            F.lit(permissive) & ~accepted(record), "no_known_shape"
        ),
    )


def ingest(
    lines: DataFrame, line: str = "line", require_rows: bool = False, permissive: bool = True
) -> Ingested:
    """Split lines into kept records and rejects, and count both.

    ``require_rows`` runs a query to make sure that something is kept.
    """
    tagged = with_record(lines, line, permissive)
    good = tagged.filter(F.col("reason").isNull()).drop("reason", line)
    rejects = tagged.filter(F.col("reason").isNotNull()).drop("record")
    if require_rows and good.isEmpty():
        raise NoRowsError("no valid example among the input lines")
    return Ingested(good, rejects, count_reasons(tagged))


def count_reasons(tagged: DataFrame) -> DataFrame:
    """One row: total, valid and skipped rows."""
    return tagged.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("reason").isNull()).alias("valid_rows"),
        F.count_if(F.col("reason").isNotNull()).alias("skipped_rows"),
    )


def canonical(df: DataFrame, record: str = "record") -> DataFrame:
    """Replace the record by one typed column per canonical key."""
    rec = F.col(record)
    columns = [
        (messages_of(rec) if key == "messages" else rec[key]).alias(key)
        for key in fixed.CANONICAL_KEYS
    ]
    return df.select(*[c for c in df.columns if c != record], *columns)


def record_from_columns(df: DataFrame, *keep: str) -> DataFrame:
    """Build ``record`` from typed canonical columns; only non-null ones count."""
    present = [c for c in df.columns if c not in keep]

    def value(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        nested = kind in ("array", "struct", "map")
        return F.to_json(F.col(name)) if nested else F.col(name).cast("string")

    entries = F.array(
        *[F.struct(F.lit(c).alias("key"), value(c).alias("value")) for c in present]
    )
    known = F.filter(entries, lambda e: e["value"].isNotNull())
    return df.select(*keep, F.map_from_entries(known).alias("record"))


def reject_sample(rejects: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rejects in the given order (a report, not a filter)."""
    return rejects.orderBy(*order).limit(n)

