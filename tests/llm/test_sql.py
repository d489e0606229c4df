"""Queries of the training-data operators against their SQL, on the driver's tables and on made ones."""

import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyforge.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def compare(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, str(folder)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = next(c for c in ("vec_id", "doc_id", "word") if c in want)
    both = [f.sort_values(key, ignore_index=True)[sorted(want.columns)].convert_dtypes() for f in (got, want)]
    pd.testing.assert_frame_equal(*both)
    return want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_driver_tables(spark, name):
    compare(spark, name, SF)


@pytest.mark.parametrize("seed", [1, 2])
def test_vectors_with_links(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 16)) * rng.choice([0.01, 0.25, 0.4], (300, 1))
    rows = [x.tolist() for x in v]
    rows[5], rows[6], rows[7], rows[8] = None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15
    rows[9] = rows[10] = rows[11]
    labels = [None if i % 50 == 0 else int(i % 3) for i in range(300)]
    pq.write_table(pa.table({"vec_id": pa.array(range(300), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}), tmp_path / "embeddings.parquet")
    assert (compare(spark, "op9_embedding_dedup", tmp_path)["n_links"] > 0).sum() > 100


@pytest.mark.parametrize("name", ["op5_minhash_dedup", "op8_suffix_dedup"])
def test_texts_with_copies(spark, tmp_path, name):
    rng = np.random.default_rng(7)
    words = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 250))) for _ in range(40)]
    passage = " ".join(rng.choice(words, 110))
    for t in list(texts):
        row = t.split(" ")
        for at in rng.integers(0, len(row), rng.integers(0, 9)):
            row[at] = "new"
        texts += [" ".join(row), t[:60] + passage + t[60:]]
    texts += [None, "", " \t\r\n", "one two", "one\ttwo", "ONE two", "ab" * 500, texts[3], texts[3]]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    found = compare(spark, name, tmp_path)
    assert (found["n_removed"] > 0).sum() > 30 if "n_removed" in found else (~found["kept"]).sum() > 10
