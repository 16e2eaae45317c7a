"""Near-duplicate documents by SimHash and multi-index hashing.

A document's fingerprint has a bit set where more than half of the 64-bit
hashes of its word shingles have it. Two fingerprints link when at most two
bits differ, and linked documents form a component.

Links are found by multi-index hashing over the different fingerprints (exact
copies have met before, in a map-side combined aggregate). A fingerprint is cut
into two segments of 32 bits. If at most two bits differ, then the upper
segments differ in at most one bit or the lower ones are equal. So a table holds
every fingerprint by its upper and by its lower segment; a fingerprint looks up
the ball of radius 1 around its upper segment and its lower segment as it is,
and each match is verified on all 64 bits.

A segment that very many fingerprints share (copies of one page with small
changes) would make all pairs of them candidates. Matches there are not listed.
Every fingerprint that meets such a bucket enumerates the ball of radius 1
around its whole 64 bits instead: two fingerprints have a ball member in common
exactly when they differ in at most two bits, and at most 65 fingerprints share
one member, so the work stays proportional to the number of fingerprints.

Defined results. NULL text reads as empty; a text without words has fingerprint
zero and links like any other. Fewer words than a shingle: the whole sequence is
one shingle. NULL ids take part in links but never name a component. Repeated
rows meet in one component. An empty table gives no rows. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.components import components
from corvane.llm.texts import word_blocks
from corvane.session import staged

SEED = 42
SHINGLE = 3
SEGMENT = 32
NAMELESS = 1 << 62  # documents without an id are numbered from here on
BUCKET = 64  # fingerprints in a table entry up to which its pairs are listed
CHUNK = 1 << 15  # hashes whose bits are spread out at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as an unsigned number."""
    digest = xxhash.xxh64_intdigest
    ones, count = np.zeros(64, dtype=np.int64), 0

    def add(hashes: list[int]) -> int:
        values = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        for at in range(0, len(values), CHUNK):
            ones[:] += np.unpackbits(values[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.int32)
        return len(hashes)

    words: list[bytes] = []
    for block in word_blocks((text or "").encode()):
        words += block.lower().split()  # of bytes: ASCII letters, ASCII white space
        if len(words) >= shingle:
            count += add([digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))])
            words = words[len(words) - shingle + 1 :]
    if not count and words:
        count = add([digest(b" ".join(words), SEED)])
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every document as a signed long."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            signed = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], ["doc_id", "fp"])

    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(batches, "doc_id long, fp long")


def _segments(fp: Column) -> tuple[Column, Column]:
    mask = F.lit((1 << SEGMENT) - 1)
    return F.shiftrightunsigned(fp, SEGMENT).bitwiseAND(mask), fp.bitwiseAND(mask)


def _ball(value: Column, bits: int) -> Column:
    """The value and all values that differ from it in one bit."""
    # The top bit of 64 is the sign: as a signed number it is -2^63.
    flips = [0] + [(1 << b) - (1 << 64 if b == 63 else 0) for b in range(bits)]
    return F.transform(F.lit(flips), lambda flip: value.bitwiseXOR(flip))


def _entries(segment: int, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(segment).alias("segment"), v.alias("value")))


def _by_segment(fps: DataFrame, upper: Column, lower: Column) -> DataFrame:
    keys = F.explode(F.concat(_entries(0, upper), _entries(1, lower)))
    return fps.select("fp", keys.alias("key")).select("fp", "key.segment", "key.value")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` between different fingerprints; their components are those of all links.

    ``fps`` has each fingerprint once, in ``fp``.
    """
    upper, lower = _segments(F.col("fp"))
    table = _by_segment(fps, F.array(upper), F.array(lower))
    probes = _by_segment(fps, _ball(upper, SEGMENT), F.array(lower))
    key = ["segment", "value"]

    entries = table.groupBy(*key).agg(F.count(F.lit(1)).alias("entries"))
    full = staged(entries.filter(F.col("entries") > bucket).select(*key), "full-buckets")

    listed = table.join(full, key, "left_anti").withColumnRenamed("fp", "b")
    matches = probes.withColumnRenamed("fp", "a").join(listed, key)
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    verified = matches.filter((F.col("a") < F.col("b")) & (apart <= 2)).select("a", "b")

    crowded = probes.join(full, key, "left_semi").select("fp").distinct()
    members = crowded.select("fp", F.explode(_ball(F.col("fp"), 64)).alias("member"))
    first = members.groupBy("member").agg(F.min("fp").alias("a"))
    shared = members.join(first, "member").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return verified.unionAll(shared).distinct()


def grouped(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET
) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per document.

    The fingerprint is in 16 hexadecimal digits; a component is named by the
    smallest id in it.
    """
    marked = staged(fingerprints(docs, id, text, shingle), "fingerprints")
    fps = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "different-fingerprints")
    roots = components(links(fps, bucket))
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_fp = staged(placed.join(named, "root").select("fp", "component_id"), "components")
    # Copies of one text share a fingerprint: that join is on a few hot keys, split by Spark.
    return marked.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, all columns as they are.

    Rows with the same id are one document, of which one row stays. Documents
    without an id count by their text, behind all others: one stays of a component
    that has no ids. What goes is named, being much less than what stays: Spark
    broadcasts those ids while they are few, and shuffles the texts once beyond that.
    """
    key = "_key"
    while key in docs.columns:
        key += "_"
    nameless = NAMELESS + F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(NAMELESS))
    keyed = docs.withColumn(key, F.coalesce(F.col(id).cast("long"), nameless))
    return one_of_each(keyed, grouped(keyed, key, text), key).drop(key)


def one_of_each(docs: DataFrame, found: DataFrame, id: str = "doc_id") -> DataFrame:
    """One document of each component of ``found``, which has ``doc_id, component_id`` of every row. No id is NULL."""
    names = F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    ids = staged(found.groupBy("doc_id").agg(names.alias("names"), F.count(F.lit(1)).alias("rows")), "document-ids")
    gone = staged(ids.filter(~F.col("names")).select(F.col("doc_id").alias("gone")), "removed-ids")
    kept = docs.join(gone, docs[id] == gone["gone"], "left_anti")
    if ids.filter(F.col("rows") > 1).isEmpty():
        return kept
    return kept.dropDuplicates([id])
