"""Paired bootstraps, null shifts, and p values, as functions on DataFrames, with queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyforge.functions.distributions import student_tail
from tallyforge.functions.scoring import normal_tail


def paired_bootstrap(pairs: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """One row: n, observed mean difference, lo, hi and p of paired resamples.

    ``pairs`` has k (0 to n - 1) and d, the difference of the pair. Resample b takes the pairs
    md5(seed#b#i) mod n, so that other engines draw alike. The interval has the order statistics at
    int(0.025 draws) and int(0.975 draws); p is the share of resampled means, less the observed one,
    that reach it. Fewer than two pairs give nulls. Pairs are few by nature: every task has them all
    only as rows of a join, and nothing is gathered.
    """
    whole = pairs.agg(F.count("*").alias("n"), F.round(F.avg("d"), 12).alias("observed"))
    spark = pairs.sparkSession
    drawn = spark.range(draws).withColumnRenamed("id", "b").crossJoin(whole.where("n > 1"))
    drawn = drawn.select("b", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    number = F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(seed), "b", "i").cast("binary")), 1, 8), 16, 10).cast("bigint")
    means = drawn.select("b", (number % F.col("n")).alias("k")).join(pairs.select("k", "d"), "k").groupBy("b").agg(F.round(F.avg("d"), 12).alias("mean"))
    # one number a resample: ``draws`` rows, whatever the number of pairs
    ranked = means.withColumn("at", F.row_number().over(Window.orderBy("mean", "b")) - 1)
    out = ranked.crossJoin(whole).agg(
        F.max(F.when(F.col("at") == int(0.025 * draws), F.col("mean"))).alias("lo"),
        F.max(F.when(F.col("at") == int(0.975 * draws), F.col("mean"))).alias("hi"),
        F.avg((F.round(F.col("mean") - F.col("observed"), 12) >= F.col("observed")).cast("double")).alias("p"),
    )
    return whole.crossJoin(out).select("n", *[F.round(c, 6).alias(c) for c in ("observed", "lo", "hi", "p")])


def paired_t_test(pairs: DataFrame) -> DataFrame:
    """n, mean, t, and one-sided p by the normal law and by Student's with n - 1 degrees of freedom.

    Equal differences give a positive infinite t and p 0, whatever their sign; one pair or none give nulls.
    """
    row = pairs.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    t = F.when(F.col("n") < 2, None).when(F.col("sd") == 0, F.lit(float("inf"))).otherwise(F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0)) * F.sqrt("n"))
    row = row.withColumn("t", t)
    normal = F.when(F.col("sd") == 0, F.lit(0.0)).otherwise(normal_tail(F.col("t")))
    return row.select("n", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"), F.round(normal, 5).alias("p_normal"), F.round(student_tail(F.col("t"), F.col("n") - 1), 5).alias("p_student"))


def one_sample_z(rates: DataFrame) -> DataFrame:
    """``rates`` (name, p, n, ref, lo, hi) with delta, z and the two-sided interval and one-sided p of it.

    A standard error of 0 gives an infinite z of delta's sign, and p 0 for a positive delta, else 1.
    """
    own = F.sqrt(F.col("p") * (1 - F.col("p")) / F.greatest("n", F.lit(1)))
    error = F.sqrt(F.pow((F.col("hi") - F.col("lo")) / 3.92, F.lit(2)) + own * own)
    rows = rates.withColumn("delta", F.col("p") - F.col("ref")).withColumn("e", error)
    z = F.when(F.col("e") > 0, F.col("delta") / F.nullif(F.col("e"), F.lit(0.0))).otherwise(F.when(F.col("delta") > 0, float("inf")).otherwise(float("-inf")))
    p = F.when(F.col("e") > 0, normal_tail(F.col("delta") / F.nullif(F.col("e"), F.lit(0.0)))).otherwise(F.when(F.col("delta") > 0, 0.0).otherwise(1.0))
    return rows.select("name", F.round("delta", 6).alias("delta"), F.round(z, 4).alias("z"), F.round(p, 5).alias("p"), F.round(F.col("delta") - 1.96 * F.col("e"), 6).alias("lo"), F.round(F.col("delta") + 1.96 * F.col("e"), 6).alias("hi"))


def published_gaps(computed: DataFrame, published: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Rows of ``computed`` (name, value) that are further than ``tolerance`` from the published value.

    Names that aren't published are skipped.
    """
    both = computed.join(published.select("name", F.col("value").alias("published")), "name")
    gap = F.abs(F.col("value") - F.col("published"))
    return both.where(gap > tolerance).select("name", F.round("value", 4).alias("value"), "published", F.round(gap, 4).alias("gap"))


def daily_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day, the share of errors less the share of sign-ups among the events."""
    share = lambda kind: F.avg((F.col("event_type") == kind).cast("double"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.to_date("ts").alias("day")).agg((share("error") - share("signup")).alias("d"))
    return rows.select((F.row_number().over(Window.orderBy("day")) - 1).cast("bigint").alias("k"), "d")  # a row a day


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = (F.col("value") > 50).cast("double")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("name")).agg(F.avg(big).alias("p"), F.count("*").alias("n"))
    extra = spark.createDataFrame([("all", 1.0, 5, 0.5, 0.5, 0.5), ("none", 0.0, 5, 0.5, 0.5, 0.5)], "name string, p double, n bigint, ref double, lo double, hi double")
    return rows.select("name", "p", "n", F.lit(0.5).alias("ref"), F.lit(0.45).alias("lo"), F.lit(0.55).alias("hi")).unionByName(extra)


def published_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("click", 0.5), ("error", 0.9), ("signup", 0.2), ("absent", 0.1)], "name string, value double")
    return published_gaps(_rates(spark, sf_dir).select("name", F.col("p").alias("value")), known)


_PAIRS = "d AS (SELECT CAST(ts AS DATE) AS day, avg((event_type = 'error')::int) - avg((event_type = 'signup')::int) AS d FROM events GROUP BY 1), p AS (SELECT row_number() OVER (ORDER BY day) - 1 AS k, d FROM d)"
_TAIL = lambda z: f"CASE WHEN {z} >= 0 THEN f ELSE 1 - f END"
_PHI = lambda z: f"exp(-pow({z}, 2) / 2) / sqrt(2 * pi()) * (0.31938153 * u - 0.356563782 * pow(u, 2) + 1.781477937 * pow(u, 3) - 1.821255978 * pow(u, 4) + 1.330274429 * pow(u, 5))"
#: Steps of Simpson's rule over the density of Student's law.
_SIMPSON = 20000
QUERIES = {
    "paired_bootstrap": lambda spark, sf_dir: paired_bootstrap(daily_pairs(spark, sf_dir)),
    "paired_t_test": lambda spark, sf_dir: paired_t_test(daily_pairs(spark, sf_dir)),
    "one_sample_z_test": lambda spark, sf_dir: one_sample_z(_rates(spark, sf_dir)),
    "published_check": published_check,
}
_Z = """WITH r AS (SELECT event_type AS name, avg((value > 50)::int) AS p, count(*) AS n, 0.5 AS ref, 0.45 AS lo, 0.55 AS hi FROM events GROUP BY 1 UNION ALL VALUES ('all', 1.0, 5, 0.5, 0.5, 0.5), ('none', 0.0, 5, 0.5, 0.5, 0.5))"""
ORACLES = {
    "paired_bootstrap": f"""WITH {_PAIRS}, w AS (SELECT count(*) AS n, round(avg(d), 12) AS observed FROM p),
x AS (SELECT b, CAST('0x' || left(md5('42#' || b || '#' || i), 8) AS BIGINT) % n AS k FROM range(1000) r(b), (SELECT n, unnest(range(n)) AS i FROM w)),
m AS (SELECT b, round(avg(d), 12) AS mean FROM x JOIN p USING (k) GROUP BY b), o AS (SELECT mean, row_number() OVER (ORDER BY mean, b) - 1 AS place FROM m)
SELECT n, round(observed, 6) AS observed, round((SELECT mean FROM o WHERE place = 25), 6) AS lo, round((SELECT mean FROM o WHERE place = 975), 6) AS hi, round((SELECT avg((round(mean - observed, 12) >= observed)::int) FROM m), 6) AS p FROM w""",
    "paired_t_test": f"""WITH {_PAIRS}, s AS (SELECT count(*) AS n, avg(d) AS mean, avg(d) / stddev_samp(d) * sqrt(count(*)) AS t FROM p), v AS (SELECT *, 1 / (1 + 0.2316419 * abs(t)) AS u FROM s), q AS (SELECT *, {_PHI("t")} AS f FROM v)
SELECT n, round(mean, 6) AS mean, round(t, 4) AS t, round({_TAIL("t")}, 5) AS p_normal, round(0.5 - sign(t) * (SELECT sum(CASE WHEN j IN (0, {_SIMPSON}) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(abs(t) * j / {_SIMPSON}, 2) / (n - 1), -n / 2)) FROM range({_SIMPSON} + 1) r(j)) * abs(t) / {_SIMPSON} / 3 * exp(lgamma(n / 2) - lgamma((n - 1) / 2)) / sqrt((n - 1) * pi()), 5) AS p_student FROM q""",
    "one_sample_z_test": f"""{_Z}, e AS (SELECT *, p - ref AS delta, sqrt(pow((hi - lo) / 3.92, 2) + p * (1 - p) / n) AS e FROM r), z AS (SELECT *, CASE WHEN e > 0 THEN delta / e END AS z FROM e), v AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS u FROM z), q AS (SELECT *, {_PHI("z")} AS f FROM v)
SELECT name, round(delta, 6) AS delta, round(CASE WHEN z IS NOT NULL THEN z WHEN delta > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END, 4) AS z, round(CASE WHEN z IS NOT NULL THEN {_TAIL("z")} WHEN delta > 0 THEN 0 ELSE 1 END, 5) AS p, round(delta - 1.96 * e, 6) AS lo, round(delta + 1.96 * e, 6) AS hi FROM q""",
    "published_check": f"""{_Z} SELECT name, round(p, 4) AS value, v AS published, round(abs(p - v), 4) AS gap FROM r JOIN (VALUES ('click', 0.5), ('error', 0.9), ('signup', 0.2), ('absent', 0.1)) k(name, v) USING (name) WHERE abs(p - v) > 0.05""",
}
