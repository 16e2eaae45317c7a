"""Pack documents into sequences of a fixed number of tokens, with little padding.

A document is tokenized and cut into pieces of the sequence length; full pieces
are sequences by themselves. What is left of each document (its last piece) is
packed first-fit decreasing: pieces from long to short, each into the first
sequence with room for it, which a tournament tree over the sequences' room
finds in logarithmic time. That runs on its own in random groups of a bounded
number of pieces, so that no task or group grows with the corpus.

Only lengths travel: the ids stay where they were cut and meet their place in a
sequence by the piece's number when the sequences themselves are wanted.

Defined results. NULL text reads as empty: its only id is the end mark. Repeated
rows are documents of their own. An empty table gives no rows. Only the named
columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.texts import text_groups
from corvane.llm.tokenizing import ChunkEncoder
from corvane.session import staged

LENGTH = 2048
END = 1
GROUP = 20_000  # pieces packed together


def cut(
    docs: DataFrame,
    tokenizer: str,
    id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece, and its ``ids`` when asked for.

    ``tokenizer`` is the path of a tokenizer file; it is read here, once, and
    sent to the executors (a vocabulary, not data). ``ids_crc32`` is the
    checksum of the ids as little-endian unsigned 32-bit numbers.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    if with_ids:
        schema += ", ids array<int>"
    names = [field.split()[0] for field in schema.split(", ")]
    mark, step = np.array([end], dtype="<u4").tobytes(), 4 * length

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(definition.value)
        for batch in rows:
            keys = batch.column(0)
            for first, texts in text_groups(batch.column(1)):
                out: list[list] = [[] for _ in names]
                for row, body in enumerate(texts, first):
                    raw = encoder.encode(body) + mark
                    for at in range(0, len(raw), step):
                        piece = raw[at : at + step]
                        values = [keys[row].as_py(), at // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4]
                        if with_ids:
                            values.append(np.frombuffer(piece, dtype="<i4"))
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
                arrays = [pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(batches, schema)


def first_fit_decreasing(lengths: np.ndarray, room: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece.

    The tree holds the most room below every node; its leaves are the sequences
    in order. The first sequence with room is found by going down from the root,
    to the left child where that has enough.
    """
    count = len(lengths)
    leaves = 1 << max(0, count - 1).bit_length()
    most = [room] * (2 * leaves)
    sequence, offset = np.empty(count, dtype=np.int64), np.empty(count, dtype=np.int64)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[piece])
        node = 1
        while node < leaves:
            node *= 2
            if most[node] < size:
                node += 1
        sequence[piece], offset[piece] = node - leaves, room - most[node]
        most[node] -= size
        while node > 1:
            node //= 2
            left, right = most[2 * node], most[2 * node + 1]
            best = left if left >= right else right
            if most[node] == best:
                break
            most[node] = best
    return sequence, offset


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP, seed: int = 42) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces (stored ones: they are read more than once).

    A group has about ``group`` pieces. Full pieces are numbered by their own
    number, packed sequences by group and place; the last bit tells which.
    """
    numbered = pieces.withColumn("piece", F.monotonically_increasing_id())
    own = numbered.filter(F.col("length") >= length).select(
        *pieces.columns, (F.col("piece") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = numbered.filter(F.col("length") < length)
    groups = max(1, math.ceil(rest.count() / group))
    columns = [c for c in pieces.columns if c != "ids"]

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = first_fit_decreasing(rows["length"].to_numpy(), length)
        key = rows["pack_group"].to_numpy() * (1 << 32) + sequence
        return rows.drop(columns=["pack_group"]).assign(sequence_id=key * 2 + 1, offset=offset)

    dealt = rest.select(
        *columns, "piece", F.pmod(F.xxhash64("piece", F.lit(seed)), F.lit(groups)).alias("pack_group")
    )
    kinds = dict(dealt.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*columns, "piece"]) + ", sequence_id long, offset long"
    placed = dealt.groupBy("pack_group").applyInPandas(place, schema)
    if "ids" in pieces.columns:
        placed = placed.join(rest.select("piece", "ids"), "piece")
    return own.unionByName(placed.drop("piece"))


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False, **options) -> DataFrame:
    """Every piece of the documents with its sequence and offset."""
    return pack(staged(cut(docs, tokenizer, length=length, with_ids=with_ids, **options), "pieces"), length)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, length, ids, doc_ids``: the sequences themselves, without padding.

    A group here is one sequence, so it has no more than the sequence's tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    return whole.select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
    ).select("sequence_id", F.size("ids").cast("long").alias("length"), "ids", "doc_ids")
