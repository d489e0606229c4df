"""Probe histories: latest status, sparkline, lifetime rate, known probes, and cost bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def probe_history(runs: DataFrame, marks: int = 10) -> DataFrame:
    """One row a probe: runs, triggered, rate, latest, and the last ``marks`` runs as a text of X and dots.

    ``runs`` has probe, run and triggered (0 or 1, null counts as 0). Windows are per probe.
    """
    runs = runs.withColumn("triggered", F.coalesce(F.col("triggered").cast("int"), F.lit(0)))
    recent = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("run")))
    rows = runs.withColumn("back", recent)
    last = F.sort_array(F.collect_list(F.when(F.col("back") <= marks, F.struct("run", "triggered"))))
    line = F.array_join(F.transform(last, lambda x: F.when(x["triggered"] == 1, "X").otherwise(".")), "")
    return rows.groupBy("probe").agg(
        F.count("*").alias("runs"), F.sum("triggered").cast("bigint").alias("triggered"), F.round(F.avg("triggered"), 4).alias("rate"),
        (F.max(F.when(F.col("back") == 1, F.col("triggered"))) == 1).alias("latest"), line.alias("line"),
    )


def known_probes(runs: DataFrame, library: DataFrame) -> DataFrame:
    """Rows of ``runs`` whose probe is in ``library``, with the library's columns."""
    return runs.join(library, "probe")


def priority_matrix(losses: DataFrame) -> DataFrame:
    """``losses`` (name, rate, cost) with a priority by bands of rate (0.05, 0.02) and cost (30000, 20000)."""
    often, dear = F.col("rate") >= 0.05, F.col("cost") >= 30000
    some, fair = F.col("rate") >= 0.02, F.col("cost") >= 20000
    return losses.withColumn("priority", F.when(often & dear, "P0").when(often | dear, "P1").when(some & fair, "P2").otherwise("P3"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.groupBy((F.col("user_id") % 10).cast("int").alias("probe"), F.to_date("ts").alias("run")).agg(F.max((F.col("event_type") == "error").cast("int")).alias("triggered"))


def _library(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"P-{i:02d}", "tone" if i % 2 else "capacity") for i in (1, 2, 3, 4, 12)], "probe int, name string, category string")


def probe_library_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = known_probes(_runs(spark, sf_dir), _library(spark))
    return rows.groupBy("category", "name").agg(F.count("*").alias("runs"), F.sum("triggered").cast("bigint").alias("triggered"))


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("l_partkey") == F.col("p_partkey"))
    cents = lambda c, k: F.sum((F.col(c) * k).cast("decimal(20,0)")).cast("double") / F.count("*") / k
    return priority_matrix(lines.groupBy(F.col("p_brand").alias("name")).agg(F.round(cents("l_discount", 100), 4).alias("rate"), F.round(cents("l_extendedprice", 100), 2).alias("cost")))


_RUNS = "WITH r AS (SELECT user_id % 10 AS probe, CAST(ts AS DATE) AS run, max((event_type = 'error')::int) AS triggered FROM events GROUP BY 1, 2)"
QUERIES = {"probe_history": lambda spark, sf_dir: probe_history(_runs(spark, sf_dir)), "probe_library_join": probe_library_join, "priority_matrix": priorities}
ORACLES = {
    "probe_history": f"{_RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY run DESC) AS back FROM r) SELECT probe, count(*) AS runs, CAST(sum(triggered) AS BIGINT) AS triggered, round(avg(triggered), 4) AS rate, max(triggered) FILTER (back = 1) = 1 AS latest, string_agg(CASE WHEN triggered = 1 THEN 'X' ELSE '.' END, '' ORDER BY run) FILTER (back <= 10) AS line FROM k GROUP BY probe",
    "probe_library_join": f"{_RUNS} SELECT category, name, count(*) AS runs, CAST(sum(triggered) AS BIGINT) AS triggered FROM r JOIN (VALUES (1, 'P-01', 'tone'), (2, 'P-02', 'capacity'), (3, 'P-03', 'tone'), (4, 'P-04', 'capacity'), (12, 'P-12', 'capacity')) l(probe, name, category) USING (probe) GROUP BY ALL",
    "priority_matrix": "WITH b AS (SELECT p_brand AS name, round(sum(CAST(l_discount * 100 AS DECIMAL(20, 0)))::DOUBLE / count(*) / 100, 4) AS rate, round(sum(CAST(l_extendedprice * 100 AS DECIMAL(20, 0)))::DOUBLE / count(*) / 100, 2) AS cost FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT *, CASE WHEN rate >= 0.05 AND cost >= 30000 THEN 'P0' WHEN rate >= 0.05 OR cost >= 30000 THEN 'P1' WHEN rate >= 0.02 AND cost >= 20000 THEN 'P2' ELSE 'P3' END AS priority FROM b",
}
