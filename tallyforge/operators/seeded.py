"""Paired bootstraps whose resamples are drawn by Python's generator from a seed, so that published figures come out exactly."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Pairs of trials at most: the generator is one sequence, so one task makes all numbers.
MOST_PAIRS = 100_000


def index_table(spark: SparkSession, n: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(b, picks): for each of ``draws`` resamples the ``n`` places, from 0, that the generator gives one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import random

        for _ in batches:
            generator = random.Random(seed)
            for b in range(draws):
                yield pa.RecordBatch.from_pylist([{"b": b, "picks": [generator.randint(0, n - 1) for _ in range(n)]}], schema=pa.schema([("b", pa.int64()), ("picks", pa.list_(pa.int32()))]))

    return spark.range(1, numPartitions=1).mapInArrow(run, "b bigint, picks array<int>")


def seeded_bootstrap(pairs: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """One row: n, observed, lo, hi, p and significant, of ``pairs`` (k, a, b) with b the changed condition.

    Sums are added up in the order of the draws, as ties between resamples are decided by the last
    bit. The interval has the order statistics at int(0.025 draws) and int(0.975 draws); p is the
    share of resamples of b, shifted to the mean of a, whose difference reaches the observed one.
    A null in a or b means that the conditions have unlike numbers of trials, and is an error, as are
    fewer than two pairs and more than MOST_PAIRS. Pairs with the same k lie in the order of a, b.
    """
    n, lacking = pairs.agg(F.count("*"), F.count_if(F.col("a").isNull() | F.col("b").isNull())).first()
    if lacking:
        raise ValueError(f"samples must be of the same length: {lacking} of {n} pairs lack a side")
    if not 2 <= n <= MOST_PAIRS:
        raise ValueError(f"from 2 to {MOST_PAIRS} pairs are needed, not {n}")
    # at most MOST_PAIRS numbers
    rows = pairs.agg(F.array_sort(F.collect_list(F.struct("k", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")))).alias("p"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    values = lambda c: F.transform("p", lambda x: x[c])
    rows = rows.select(values("a").alias("xa"), values("b").alias("xb"))
    rows = rows.withColumn("observed", total(F.col("xb")) / n - total(F.col("xa")) / n)
    rows = rows.withColumn("xn", F.transform("xb", lambda v: v - F.col("observed")))
    drawn = index_table(pairs.sparkSession, n, draws, seed).join(F.broadcast(rows))
    picked = lambda c: total(F.transform("picks", lambda i: F.get(c, i))) / n
    means = drawn.select("b", "observed", (picked("xb") - picked("xa")).alias("delta"), (picked("xn") - picked("xa")).alias("null"))
    # ``draws`` numbers
    out = means.agg(F.first("observed").alias("observed"), F.array_sort(F.collect_list("delta")).alias("d"), F.avg((F.col("null") >= F.col("observed")).cast("double")).alias("p"))
    at = lambda q: F.round(F.get("d", F.lit(int(q * draws))), 6)
    return out.select(F.lit(n).cast("bigint").alias("n"), F.round("observed", 6).alias("observed"), at(0.025).alias("lo"), at(0.975).alias("hi"), F.round("p", 4).alias("p"), (F.col("p") < 0.05).alias("significant"))


def seeded_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of errors against shares of sign-ups, day by day."""
    share = lambda kind: F.avg((F.col("event_type") == kind).cast("double"))
    days = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.to_date("ts").alias("k")).agg(share("signup").alias("a"), share("error").alias("b"))
    return seeded_bootstrap(days)


QUERIES = {"seeded_bootstrap": seeded_daily}
ORACLES: dict[str, str] = {}
