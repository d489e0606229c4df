"""Late runs in a stream give what a batch gives; silent probes are forgotten."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.streaming.late_probes import STORE, batch_regressions, late_regressions

SCHEMA = "probe string, ts timestamp, triggered int"


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(spark, runs):
    df = spark.createDataFrame([(p, t, s) for p, t, s in runs], "probe string, t string, triggered int")
    return df.select("probe", F.to_timestamp("t").alias("ts"), "triggered")


def stream(spark, tmp_path, batches, **more):
    source = tmp_path / "in"
    for i, runs in enumerate(batches):
        rows_of(spark, runs).coalesce(1).write.mode("append").parquet(str(source / f"b{i:03d}"))
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source / "*"))
    query = late_regressions(files, **more).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return sorted((r.probe, str(r.ts)) for r in spark.read.schema("probe string, ts timestamp").parquet(str(tmp_path / "out")).collect())


END = [("~end", "2030-01-01 00:00:00", 0)]


def test_late_runs_give_the_batch_answer(spark, tmp_path, store):
    rng = random.Random(3)
    runs = [(rng.choice("abc"), f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:0{rng.randrange(9)}", rng.randrange(2)) for i in range(60)]
    moved = sorted(runs, key=lambda r: (int(r[1][8:10]) * 24 + int(r[1][11:13]) + rng.randrange(36)))
    batches = [moved[i : i + 12] for i in range(0, len(moved), 12)]
    batches[1] += [("a", None, 1), (None, "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:00", None)]
    got = stream(spark, tmp_path, [*batches, END, END])
    want = sorted((r.probe, str(r.ts)) for r in batch_regressions(rows_of(spark, runs)).collect())
    assert got == want and len(want) > 8


def test_silent_probes_are_forgotten(spark, tmp_path, store):
    batches = [[("a", "2024-01-01 00:00:00", 1)], [("b", "2024-03-01 00:00:00", 0)], [("b", "2024-03-20 00:00:00", 0)], [("a", "2024-04-01 00:00:00", 1), ("b", "2024-04-01 00:00:00", 1)], END, END]
    runs = rows_of(spark, [r for b in batches for r in b])
    for days, want in ((30, ["a", "a", "b"]), (400, ["a", "b"])):
        assert [p for p, _ in stream(spark, tmp_path / str(days), batches, keep_days=days)] == want
        assert sorted(r.probe for r in batch_regressions(runs, days).collect()) == want


def test_batch_of_nothing_and_ties(spark):
    assert batch_regressions(rows_of(spark, [])).collect() == []
    got = batch_regressions(rows_of(spark, [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:00", 0), ("a", "2024-01-01 00:00:00", 1)])).collect()
    assert len(got) == 1
