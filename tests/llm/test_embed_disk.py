"""Vectors go to disk once: no kept table holds them, and cells, blocks and tiles don't change the links."""

import os

import numpy as np
import pytest

from tallyforge.llm import embed_dedup, scratch
from tallyforge.llm.embed_dedup import Settings, near_duplicates


def vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 20, width))
    return centres[rng.integers(0, n // 20, n)] + rng.normal(size=(n, width)) * rng.choice([0.01, 0.2, 0.5], (n, 1))


def test_kept_tables_hold_no_vectors(spark):
    x = vectors(4000, 64, 3).astype(np.float32)
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    bases, own = [], scratch.Scratch

    class Watched(own):
        def __init__(self, *args):
            super().__init__(*args)
            bases.append(self.base.removeprefix("file:"))

    with pytest.MonkeyPatch.context() as m:
        m.setattr(embed_dedup, "Scratch", Watched)
        near_duplicates(df).count()
    kept = sum(os.path.getsize(os.path.join(d, f)) for b in bases for d, _, files in os.walk(b) for f in files)
    assert kept < x.nbytes / 2


@pytest.mark.parametrize("width", [3, 48])
def test_cells_blocks_and_tiles(spark, width):
    x = vectors(300, width, width)
    x[7] = x[8] = x[9]
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2)
    want = near.sum(1) - 1
    for s in (Settings(), Settings(cell_rows=40, block=30, tile=7), Settings(block_bytes=8 * width * 25, tile=4)):
        assert [r["n_links"] for r in near_duplicates(df, s).orderBy("vec_id").collect()] == want.tolist()
