"""Grams of many words are looked up a piece at a time, whose memory doesn't follow the batch's size."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tallyforge.operators import contamination


def peak(rows):
    lists = pa.array(np.arange(rows * 500).reshape(rows, 500).tolist(), pa.list_(pa.int64()))
    tracemalloc.start()
    for _, size, values in contamination.pieces(lists):
        contamination.gram_bits(size, values, 8)
    out = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out


def test_pieces_bound_memory():
    assert peak(2500) < 15e6
    assert peak(2500) < 1.5 * peak(500)
