"""Quality scores by votes of the nearest labelled documents in latent-semantic space.

A text's terms are its chunks' letters (hashed), their shapes (``Xx``, ``X!``,
``x*``) and how they repeat. The square roots of the terms' shares make a
vector; a truncated singular value decomposition of a bounded sample of labelled
documents (``SAMPLE`` of them, chosen by a digest of the id) gives the latent
space. The sample's vectors and labels are broadcast, a few megabytes by that
bound, and every document's cosines with all of them are computed exactly, block
by block. The nearest ones vote with a weight that falls steeply with distance.

Defined results. NULL text reads as empty; a text without chunks has no
neighbours and gets the sample's share of label 1. Without any labelled row
every score is 0.5. Of conflicting labels of one id the largest counts. Repeated
rows get the same score; an empty table gives no rows. Only the named columns
are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.common import thinned
from corvane.llm.texts import text_groups, word_blocks
from corvane.session import staged

SAMPLE = 6000  # labelled documents that are learned from
WORDS = 512  # buckets of hashed letters
SHAPES = 256  # buckets of shapes
REPEATS = 8
SHAPE_WEIGHT = 3.0  # shapes and repeats against letters
SPACE = 48  # latent dimensions
NEIGHBOURS = 15
SHARPNESS = 20  # power of a cosine in its vote
BLOCK = 512  # documents whose cosines are held at a time
KNOWN = 300_000  # chunks that a task holds
THRESHOLD = 0.7

_KIND = bytes(
    0x58 if 0x41 <= b <= 0x5A else 0x78 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x39 if 0x30 <= b <= 0x39 else b
    for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)


class _Terms(dict):
    """Chunk to a number made of a checksum of its letters and of its shape."""

    def __missing__(self, chunk: bytes) -> int:
        shape = _RUN.sub(rb"\1", chunk.translate(_KIND))
        self[chunk] = number = zlib.crc32(chunk.lower()) << 8 | zlib.crc32(shape) % SHAPES
        return number


def features(terms: _Terms, text: bytes) -> np.ndarray | None:
    """Square roots of the weighted shares of a whole text's terms; None without any."""
    if len(terms) > KNOWN:
        terms.clear()
    blocks = [np.fromiter(map(terms.__getitem__, b.split()), dtype=np.int64) for b in word_blocks(text)]
    numbers = np.concatenate(blocks) if blocks else np.zeros(0, dtype=np.int64)
    count = len(numbers)
    if not count:
        return None
    words = np.bincount((numbers >> 8) % WORDS, minlength=WORDS)
    shapes = np.bincount(numbers & (SHAPES - 1), minlength=SHAPES)
    repeats = np.zeros(REPEATS)
    for back in (1, 2):
        repeats[back - 1] = (numbers[back:] == numbers[:-back]).sum()
    repeats[2] = count - len(np.unique(numbers))
    repeats[3 + min(4, len(str(count)) - 1)] = 0.1 * count  # how long the text is, in tens
    return np.sqrt(np.concatenate([words, SHAPE_WEIGHT * shapes, SHAPE_WEIGHT * repeats]) / count)


@dataclass
class Voters:
    """The latent space, the labelled vectors in it and their labels."""

    axes: np.ndarray  # term, dimension
    vectors: np.ndarray  # document, dimension; of length 1
    labels: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        found = rows.astype(np.float32) @ self.axes
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def votes(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled documents, weighted by cosine."""
        cosines = self.project(rows) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        close = np.take_along_axis(cosines, near, axis=1)
        # Against the nearest one, so that far documents get a vote of the same kind.
        weight = np.maximum(close / np.maximum(close.max(axis=1, keepdims=True), 1e-6), 0) ** SHARPNESS
        return (weight * self.labels[near]).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, label: str = "quality") -> Voters | None:
    """Learn from at most ``sample`` labelled documents that ``learn`` admits, by ``doc_id``. Runs jobs."""
    marked = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    one = marked.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    # Labels of documents that are not there do not use up the sample.
    there = one.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    few = thinned(there, "doc_id", [], sample)
    chosen = staged(few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "quality-sample")
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for batch in batches:
            kept = []
            for first, group in text_groups(batch.column(1)):
                for row, text in enumerate(group, first):
                    if (found := features(terms, text)) is not None:
                        kept.append((batch.column(0)[row].as_py(), found.astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in kept], pa.int32()), pa.array([k[1] for k in kept], pa.binary())],
                ["label", "vector"],
            )

    # Bounded by ``sample`` rows of a fixed length.
    rows = texts.select("label", "text").mapInArrow(look, "label int, vector binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (bytes(r["vector"]), r["label"]))  # the same model whatever order they came in
    matrix = np.stack([np.frombuffer(r["vector"], dtype="<f4") for r in rows]).astype(np.float64)
    values, axes = np.linalg.eigh(matrix.T @ matrix)
    axes = axes[:, ::-1][:, :SPACE].astype(np.float32)
    voters = Voters(axes, np.zeros((0, axes.shape[1])), np.array([r["label"] for r in rows], dtype=np.float32))
    voters.vectors = voters.project(matrix)
    return voters


def score(docs: DataFrame, voters: Voters | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``score`` and ``predicted`` of every document."""
    if voters is None:
        return docs.select(*keep, F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(voters)
    prior = float(voters.labels.mean())
    picked = docs.select(*keep, F.col(text).alias("_text"))
    kinds = dict(picked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, terms = sent.value, _Terms()
        for batch in batches:
            scores = np.full(batch.num_rows, prior)
            rows: list[int] = []
            vectors: list[np.ndarray] = []

            def settle() -> None:
                if rows:
                    scores[rows] = voters.votes(np.stack(vectors))
                rows.clear(), vectors.clear()

            for first, group in text_groups(batch.column(len(keep))):
                for row, text in enumerate(group, first):
                    if (found := features(terms, text)) is not None:
                        rows.append(row)
                        vectors.append(found)
                    if len(rows) == BLOCK:
                        settle()
            settle()
            columns = [*batch.columns[: len(keep)], pa.array(np.clip(scores, 0, 1))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "score"])

    scored = picked.mapInArrow(look, schema)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
