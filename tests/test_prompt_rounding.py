"""A prompt's confidence is rounded as in SQL where a balance lies between two hundredths."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tallyforge import catalog


def test_tied_balances(spark, tmp_path):
    balances = [50.0 * i * s for i in range(200) for s in (1, -1)] + [4949.99, 4950.01]
    n = len(balances)
    pq.write_table(pa.table({"c_custkey": list(range(n)), "c_name": [f"c{i}" for i in range(n)], "c_mktsegment": ["m"] * n, "c_acctbal": balances}), tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet'")
    got = catalog.QUERIES["prompt_render"](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(got.columns)} from ({catalog.ORACLES['prompt_render']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
