"""Row-wise text similarity.

Both kernels compare all tokens of a row's two sides and need arrays of numbers
or bit sets, so they run on Arrow batches; the text clean-up
before and the arithmetic after them stay in the JVM.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from corvane.functions.text import overlap_words

MATCH = T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1")])


FREQUENT = 64  # places from which a token's bits are kept; there are few such tokens
ROW = 4  # matches that cost as much as a row of bits, and one more for every
BITS = 600  # bits in it


def common_subsequence(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence.

    What the ends have in common is part of it. Of the rest, few matching pairs of
    places are gone through one by one; otherwise a row of bits, one per left
    token, is moved on by each right token. Memory is linear in the tokens: bits are
    kept for frequent tokens only, of which there are few.
    """
    if len(left) < len(right):
        left, right = right, left
    ends, same, short = 0, 0, len(right)
    while ends < short and left[ends] == right[ends]:
        ends += 1
    while same < short - ends and left[-1 - same] == right[-1 - same]:
        same += 1
    left, right = left[ends : len(left) - same], right[ends : short - same]
    places: dict[str, list[int]] = {}
    for i, token in enumerate(left):
        places.setdefault(token, []).append(i)
    right = [token for token in right if token in places]
    matches = sum(len(places[token]) for token in right)
    few = matches <= len(right) * (ROW + len(left) // BITS)
    return ends + same + (_by_matches(places, right) if few else _by_bits(places, right, len(left)))


def _by_matches(places: dict[str, list[int]], right: list[str]) -> int:
    """``ends[k]`` is the least left place at which a common subsequence of k + 1 tokens ends."""
    ends: list[int] = []
    for token in right:
        for place in reversed(places[token]):
            if not ends or place > ends[-1]:
                ends.append(place)
            else:
                ends[bisect_left(ends, place)] = place
    return len(ends)


def _by_bits(places: dict[str, list[int]], right: list[str], size: int) -> int:
    def bits(token: str) -> int:
        row = bytearray(size // 8 + 1)
        for place in places[token]:
            row[place >> 3] |= 1 << (place & 7)
        return int.from_bytes(row, "little")

    kept = {token: bits(token) for token, own in places.items() if len(own) >= FREQUENT or size <= FREQUENT * 64}
    full = (1 << size) - 1
    open_bits = full
    for token in right:
        hits = kept[token] if token in kept else bits(token)
        matched = open_bits & hits
        open_bits = ((open_bits + matched) | (open_bits - matched)) & full
    return size - open_bits.bit_count()


@F.arrow_udf(T.DoubleType())
def _overlap(left: pa.Array, right: pa.Array) -> pa.Array:
    scores = []
    for a, b in zip(left, right):
        a, b = (a.as_py() or "").split(), (b.as_py() or "").split()
        common = common_subsequence(a, b)
        scores.append(2.0 * common / (len(a) + len(b)) if common else 0.0)
    return pa.array(scores, pa.float64())


def rouge_l(prediction: Column, reference: Column) -> Column:
    """ROUGE-L F1 as a fraction, over whole texts."""
    return _overlap(overlap_words(prediction), overlap_words(reference))


BLOCK = 4096  # vectors of a side whose cosines are held at a time


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _matrices(lists: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row's vectors as a matrix, cut from the batch's one array of numbers; None without any vector."""
    vectors = lists.values
    numbers = vectors.values.to_numpy(zero_copy_only=False)
    rows, places = lists.offsets.to_numpy(), vectors.offsets.to_numpy()
    for known, first, end in zip(lists.is_valid().to_pylist(), rows[:-1], rows[1:]):
        if not known or first == end:
            yield None
            continue
        widths = np.diff(places[first : end + 1])
        if (widths != widths[0]).any():
            raise ValueError("vectors of one text have different lengths")
        own = numbers[places[first] : places[end]].astype(np.float64)
        yield own.reshape(end - first, widths[0])


@F.arrow_udf(MATCH)
def _greedy(left: pa.Array, right: pa.Array) -> pa.Array:
    units = lambda lists: (None if m is None else _unit_rows(m) for m in _matrices(lists))
    return _matched(len(left), units(left), units(right))


def _matched(size: int, left: Iterable[np.ndarray | None], right: Iterable[np.ndarray | None]) -> pa.Array:
    """The match of each row's unit vectors; zeros where a side has none."""
    out = np.zeros((size, 3))
    for row, (rows_a, rows_b) in enumerate(zip(left, right)):
        if rows_a is None or rows_b is None:
            continue
        best_a, best_b = np.full(len(rows_a), -np.inf), np.full(len(rows_b), -np.inf)
        for i in range(0, len(rows_a), BLOCK):
            for j in range(0, len(rows_b), BLOCK):
                cosine = rows_a[i : i + BLOCK] @ rows_b[j : j + BLOCK].T
                best_a[i : i + BLOCK] = np.maximum(best_a[i : i + BLOCK], cosine.max(axis=1))
                best_b[j : j + BLOCK] = np.maximum(best_b[j : j + BLOCK], cosine.max(axis=0))
        p, r = float(best_a.mean()), float(best_b.mean())
        out[row] = p, r, 2 * p * r / (p + r) if p + r != 0 else 0.0
    return pa.StructArray.from_arrays([pa.array(c) for c in out.T], names=["precision", "recall", "f1"])


def greedy_match(prediction: Column, reference: Column) -> Column:
    """Precision, recall and F1 of greedy cosine matching of two vector lists.

    Both columns are ``ARRAY<ARRAY<FLOAT|DOUBLE>>``, one vector per token. The
    cosines are worked out a block at a time, so memory grows with the vectors
    and not with their pairs.
    """
    return _greedy(prediction, reference)


def greedy_word_match(
    prediction: Column, reference: Column, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]]
) -> Column:
    """``greedy_match`` of word lists whose vectors depend on the words alone.

    The encoder that ``make_encoder`` makes in the worker gives a matrix, a row
    per word. It sees each different word of a batch once, and vectors exist
    there only: no column of vectors is computed or sent.
    """

    @F.arrow_udf(MATCH)
    def match(left: pa.Array, right: pa.Array) -> pa.Array:
        own = left.flatten()
        words = pa.concat_arrays([own, right.flatten()]).dictionary_encode()
        if not len(words):
            return _matched(len(left), [], [])
        units = _unit_rows(np.asarray(make_encoder()(words.dictionary.to_pylist()), np.float64))
        codes = words.indices.to_numpy(zero_copy_only=False)
        sides = (left, codes[: len(own)]), (right, codes[len(own) :])
        return _matched(len(left), *[_rows_of(units, lists, places) for lists, places in sides])

    return match(prediction, reference)


def _rows_of(units: np.ndarray, lists: pa.Array, places: np.ndarray) -> Iterator[np.ndarray | None]:
    """Each row's vectors, its words being the next ``places`` in a table; None without any word."""
    at = 0
    for size in lists.value_lengths().fill_null(0).to_pylist():
        yield units[places[at : at + size]] if size else None
        at += size
