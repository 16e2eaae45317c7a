"""Vectors of a batch stay one array of numbers on the Python side."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from corvane.functions import similarity

LISTS = pa.list_(pa.list_(pa.float64()))


def test_a_batch_takes_little_more_than_its_numbers():
    rows = [[[float(i % 7), 1.0, float(j)] for j in range(40)] for i in range(1500)]
    batch = pa.array(rows, LISTS)
    tracemalloc.start()
    found = similarity._greedy.func(batch, batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(found.field("f1").to_numpy(), 1.0)
    assert peak < 1_500_000  # 180,000 numbers of 8 bytes; an object each for a vector takes several times that


def test_odd_vectors():
    left = pa.array([None, [], [[1.0, 0.0]], [[0.0, 0.0]]], LISTS).slice(0)
    right = pa.array([[[1.0]], [[1.0]], [[1.0, 0.0], [0.0, 1.0]], [[1.0, 1.0]]], LISTS)
    found = similarity._greedy.func(left, right).to_pylist()
    assert [round(r["precision"], 6) for r in found] == [0, 0, 1, 0]
    assert [round(r["recall"], 6) for r in found] == [0, 0, 0.5, 0]
    with pytest.raises(ValueError):
        similarity._greedy.func(pa.array([[[1.0], [1.0, 2.0]]], LISTS), right.slice(2, 1))
