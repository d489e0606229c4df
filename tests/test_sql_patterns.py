"""Patterns find in Spark what they find in the SQL's engine: on letters, spaces and line ends beyond ASCII."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyforge import catalog
from tallyforge.functions.rules import searched

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TEXTS = [
    "es ist bestö so", "der öbest von", "die bestß, ja", "naïve literally", "jetzt justé " + "wort " * 9, "bench", "benché", "élikely", "appears to",
    "beſt of all", "would you\r work", "does it work for you", "does it\nwork for you", "\x0b", " ", "just " + "w " * 40,
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("talks")
    rows = [(5 * i + d, 1, "assistant", t) for i, t in enumerate(TEXTS) for d in range(5)]
    names = ("conv_id", "turn", "role", "text")
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))), path / "conversations.parquet")
    os.symlink(f"{SF}/benchmark.parquet", path / "benchmark.parquet")
    return path


def both(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    columns = ", ".join(got.columns)
    return sorted(map(tuple, got.collect()), key=str), sorted(con.sql(f"select {columns} from ({catalog.ORACLES[name]})").fetchall(), key=str)


@pytest.mark.parametrize("name", ["score_tone", "score_dispatch", "dispatch_report", "settings_scores", "score_signal", "score_consent", "score_gap", "first_match_note"])
def test_scores(spark, folder, name):
    got, want = both(spark, name, folder, ("conversations", "benchmark"))
    assert got == want


def test_escapes(spark):
    patterns = [r"\bbest\b", r"\Bbest\B", r"a\sb", r"a\Sb", r"[\s]x", r"\\b", "a.b", "[]a]\\b", "k"]
    texts = TEXTS + ["xbestx", "a b", "a b", "axb", "\tx", "\\b", "a\nb", "a\rb", "]é", "K"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = rows.select(*[F.col("t").rlike(searched(p)).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    want = [tuple(duckdb.execute("select regexp_matches($1, $2)", [t, "(?i)" + p]).fetchall()[0][0] for p in patterns) for t in texts]
    assert [tuple(r) for r in got] == want
