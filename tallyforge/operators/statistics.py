"""Agreement, interval, cross-tab and run-over-run statistics as functions on DataFrames.

Every function takes the columns it reads by name. The queries at the end apply them to the driver's
tables; the SQL they are held against is written by hand and run by the other engine alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def kappa(rows: DataFrame, dimension: str, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters' 0/1 labels for each dimension and ``all``; null labels are left out."""
    hit = lambda x, y: F.count_if((F.col(a) == x) & (F.col(b) == y))
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("d", F.coalesce(F.col(dimension), F.lit("none")))
    c = known.rollup("d").agg(F.count("*").alias("n"), hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), F.grouping("d").alias("g"))
    f = lambda x: F.col(x).cast("double")
    po = (F.col("tp") + F.col("tn")) / f("n")
    pe = ((f("tp") + f("fp")) * (f("tp") + f("fn")) + (f("tn") + f("fn")) * (f("tn") + f("fp"))) / (f("n") * f("n"))
    same = F.abs(1 - F.col("pe")) < 1e-9
    value = F.when(same, F.when(F.abs(1 - F.col("po")) < 1e-9, 1.0).otherwise(0.0)).otherwise((F.col("po") - F.col("pe")) / F.when(~same, 1 - F.col("pe")))
    c = c.where("n > 0").withColumn("po", po).withColumn("pe", pe)
    return c.select(F.when(F.col("g") == 1, "all").otherwise(F.col("d")).alias("dimension"), "n", "tp", "tn", "fp", "fn", F.round("po", 4).alias("po"), F.round("pe", 4).alias("pe"), F.round(value, 4).alias("kappa"))


def wilson(rows: DataFrame, by: str, hit: Column, z: float = 1.96) -> DataFrame:
    """n, rate and Wilson interval of a condition for each group."""
    r = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("p"))
    n, p = F.col("n"), F.col("p")
    spread = z * F.sqrt(p * (1 - p) / n + z * z / 4 / n / n)
    edge = lambda sign: F.round((p + z * z / 2 / n + sign * spread) / (1 + z * z / n), 4)
    return r.select(by, "n", F.round("p", 4).alias("rate"), edge(-1).alias("lo"), edge(1).alias("hi"))


def normal_interval(rows: DataFrame, by: str, value: Column, z: float = 1.96) -> DataFrame:
    """Mean and normal interval within 0 and 1 for each group; one value gives a point."""
    r = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    off = z * F.col("s") / F.sqrt("n")
    lone = lambda c: F.round(F.when(F.col("n") == 1, F.col("m")).otherwise(c), 4)
    return r.select(by, F.round("m", 4).alias("mean"), lone(F.greatest(F.lit(0.0), F.col("m") - off)).alias("lo"), lone(F.least(F.lit(1.0), F.col("m") + off)).alias("hi"))


def crosstab(rows: DataFrame, *axes: str) -> DataFrame:
    """Counts of all combinations of the axes and all their marginals."""
    return rows.cube(*axes).agg(F.count("*").alias("n"))


def crosstab_pivot(rows: DataFrame, down: str, across: str, values: list) -> DataFrame:
    """Counts of ``down`` by the given values of ``across``, 0 where there are none, with a total."""
    table = rows.groupBy(down).pivot(across, values).agg(F.count(F.lit(1))).na.fill(0)
    return table.withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0)))


def shares(rows: DataFrame, by: str, target: float, tolerance: float) -> DataFrame:
    """Share of each group and whether it is near ``target``. One row a group meets in the window."""
    c = rows.groupBy(by).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return c.select(by, "n", F.round(share, 4).alias("share"), (F.abs(share - target) <= tolerance).alias("ok"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing_cells(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Combinations of the values of two axes that no row has. The axes are the few values met."""
    return rows.select(a).distinct().crossJoin(rows.select(b).distinct()).join(rows.select(a, b).distinct(), [a, b], "left_anti").select(a, b)


def run_totals(rows: DataFrame, run: Column, hit: Column, probe: str, cost: str) -> DataFrame:
    total = F.sum(F.when(hit, F.col(cost)).otherwise(0))
    return rows.groupBy(run.alias("run")).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("triggered"), F.countDistinct(probe).alias("probes"), F.round(total, 4).alias("cost"))


def regressions(runs: DataFrame) -> DataFrame:
    """``runs`` (probe, run, triggered): probes that trigger in a run and didn't in the one before.

    A probe that the earlier run lacks counts as passed. Runs are numbered over their distinct values.
    """
    order = runs.select("run").distinct().withColumn("ord", F.row_number().over(Window.orderBy("run")))
    k = runs.join(order, "run").select("probe", "ord", "triggered")
    before = k.select("probe", (F.col("ord") + 1).alias("ord"), F.col("triggered").alias("was"))
    return k.join(before, ["probe", "ord"], "left").where("ord > 1").select("probe", "ord", ((F.coalesce("was", F.lit(0)) == 0) & (F.col("triggered") == 1)).alias("regressed"))


def trend(runs: DataFrame, last: int = 3) -> DataFrame:
    """Whether more than half of a probe's last runs triggered, at every run."""
    w = Window.partitionBy("probe").orderBy("run").rowsBetween(1 - last, 0)
    return runs.select("probe", "run", "triggered", (F.sum("triggered").over(w) * 2 > F.count("*").over(w)).alias("worsening"))


def loss_rank(rows: DataFrame, by: str, rate: str, cost: str) -> DataFrame:
    """Groups by mean rate times mean cost, largest first."""
    c = rows.groupBy(by).agg(F.avg(rate).alias("r"), F.avg(cost).alias("c"))
    place = F.rank().over(Window.orderBy(F.desc(F.round(F.col("r") * F.col("c"), 4))))
    return c.select(by, F.round("r", 6).alias("rate"), F.round("c", 2).alias("cost"), place.alias("place"))


def hash_ranks(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with k, their place from 1 in the order of md5(key), and n, how many they are.

    Rows are ranked within 4096 ranges of the hash, whose counts (a row a range) give each range's
    first place, so that no task has all rows.
    """
    rows = rows.withColumn("h", F.md5(F.col(key).cast("string").cast("binary"))).withColumn("part", F.substring("h", 1, 3))
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("part", before.alias("before"), F.sum("size").over(Window.partitionBy()).alias("n"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("h", key))
    return rows.withColumn("place", place).join(first, "part").withColumn("k", F.col("place") + F.col("before")).drop("h", "part", "place", "before")


def exact_split(rows: DataFrame, key: str, held: float = 0.2, dev: float = 0.3) -> DataFrame:
    """held_out, dev and train of exact sizes in hash order, one row at least in the first two."""
    part = lambda share: F.greatest(F.lit(1), F.floor(F.col("n") * share))
    k = hash_ranks(rows.select(key), key)
    return k.select(key, F.when(F.col("k") <= part(held), "held_out").when(F.col("k") <= part(held) + part(dev), "dev").otherwise("train").alias("split"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows of each stratum in hash order, all where there are fewer."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return rows.select(stratum, key).withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")


def same_family(rows: DataFrame, used: DataFrame, family: str) -> DataFrame:
    """Rows whose family is among ``used``."""
    return rows.join(used.select(family).distinct(), family, "left_semi")


def model_family(model: Column, families: dict[str, str]) -> Column:
    """Family of a model: by its whole name, else by what stands before the first slash; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(model)), F.try_element_at(table, F.split(F.lower(model), "/")[0]))


def calibration(rows: DataFrame, by: str, a: str, b: str, limit: float = 0.5) -> DataFrame:
    """Mean absolute gap of two judges, whether it is over ``limit``, and the share of unlike verdicts."""
    gap = F.avg(F.abs(F.col(a) - F.col(b)).cast("double"))
    flip = F.avg(F.when(F.col(a) != F.col(b), 1.0).otherwise(0.0))
    return rows.groupBy(by).agg(F.round(gap, 3).alias("mae"), (gap > limit).alias("biased"), F.round(flip, 3).alias("flip"))


def calibration_verdict(rows: DataFrame, criteria: dict[str, tuple[str, str]], limit: float = 0.5, most: float = 0.15) -> DataFrame:
    """One row a criterion: means of both judges, their gap, bias, flip rate, and what to do about all."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for k, (a, b) in criteria.items()])).alias("x")).select("x.*")
    gap = F.avg(F.abs(F.col("a") - F.col("b")))
    out = stacked.groupBy("criterion").agg(F.round(F.avg("a"), 3).alias("mean_a"), F.round(F.avg("b"), 3).alias("mean_b"), F.round(gap, 3).alias("mae"), (gap > limit).alias("biased"), F.round(F.avg((F.col("a") != F.col("b")).cast("double")), 3).alias("flip"))
    bad = F.max(F.coalesce(F.col("biased") | (F.col("flip") > most), F.lit(False))).over(Window.partitionBy())
    return out.withColumn("recommendation", F.when(bad, "INVESTIGATE").otherwise("OK"))


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Exact medians and 95th percentiles, interpolated."""
    return rows.groupBy(by).agg(*[F.round(F.percentile(value, q), 4).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95))])


def upsert(old: DataFrame, new: DataFrame, key: str, value: str, overwrite: bool = False) -> DataFrame:
    """Old and new values by key: old ones stay unless null, or unless ``overwrite``; null keys go."""
    a = old.where(F.col(key).isNotNull()).select(key, F.col(value).alias("a"))
    b = new.where(F.col(key).isNotNull()).select(key, F.col(value).alias("b"))
    both = F.coalesce("b", "a") if overwrite else F.coalesce("a", "b")
    return a.join(b, key, "full_outer").select(key, both.alias(value))


def upsert_counts(old: DataFrame, new: DataFrame, key: str, value: str, overwrite: bool = False) -> DataFrame:
    """How many values of ``new`` are written and how many are skipped for one that is there."""
    a = old.where(F.col(key).isNotNull()).select(key, F.col(value).alias("a"))
    b = new.where(F.col(key).isNotNull()).select(key, F.col(value).alias("b"))
    kept = F.col("a").isNotNull() & ~F.lit(overwrite)
    return b.join(a, key, "left").agg(F.count_if(~kept).alias("written"), F.count_if(kept).alias("skipped"))


#: Hand-written SQL that only the other engine runs.
ORACLES: dict[str, str] = {
    "cohen_kappa": """WITH j AS (SELECT coalesce(d.lang, 'none') AS dimension, l.quality AS a, l.toxic AS b FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL),
c AS (SELECT dimension, count(*) AS n, sum(CASE WHEN a = 1 AND b = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN a = 0 AND b = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN a = 1 AND b = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN a = 0 AND b = 1 THEN 1 ELSE 0 END) AS fn FROM j GROUP BY ROLLUP (dimension)),
p AS (SELECT *, (tp + tn) * 1.0e0 / n AS po, ((tp + fp) * 1.0e0 * (tp + fn) + (tn + fn) * 1.0e0 * (tn + fp)) / (n * 1.0e0 * n) AS pe FROM c)
SELECT coalesce(dimension, 'all') AS dimension, n, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(po, 4) AS po, round(pe, 4) AS pe, round(CASE WHEN abs(1 - pe) < 1e-9 THEN CASE WHEN abs(1 - po) < 1e-9 THEN 1.0e0 ELSE 0.0e0 END ELSE (po - pe) / (1 - pe) END, 4) AS kappa FROM p""",
    "wilson_ci": """WITH r AS (SELECT event_type, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0e0 ELSE 0.0e0 END) AS p FROM events GROUP BY event_type)
SELECT event_type, n, round(p, 4) AS rate, round((p + 1.9208e0 / n - 1.96e0 * sqrt(p * (1 - p) / n + 0.9604e0 / n / n)) / (1 + 3.8416e0 / n), 4) AS lo, round((p + 1.9208e0 / n + 1.96e0 * sqrt(p * (1 - p) / n + 0.9604e0 / n / n)) / (1 + 3.8416e0 / n), 4) AS hi FROM r""",
    "normal_ci": """WITH r AS (SELECT event_type, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0e0 ELSE 0.0e0 END) AS m, stddev_samp(CASE WHEN value > 50 THEN 1.0e0 ELSE 0.0e0 END) AS s FROM events GROUP BY event_type)
SELECT event_type, round(m, 4) AS mean, round(CASE WHEN n = 1 THEN m ELSE greatest(0.0e0, m - 1.96e0 * s / sqrt(n)) END, 4) AS lo, round(CASE WHEN n = 1 THEN m ELSE least(1.0e0, m + 1.96e0 * s / sqrt(n)) END, 4) AS hi FROM r""",
    "crosstab_cube": """SELECT d.lang AS lang, d.source AS source, l.quality AS quality, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY CUBE (d.lang, d.source, l.quality)""",
    "share_tolerance": """SELECT lang, count(*) AS n, round(count(*) * 1.0e0 / sum(count(*)) OVER (), 4) AS share, abs(count(*) * 1.0e0 / sum(count(*)) OVER () - 0.25e0) <= 0.05e0 AS ok FROM documents GROUP BY lang""",
    "duplicate_keys": """SELECT url, count(*) AS n FROM pages GROUP BY url HAVING count(*) > 1""",
    "missing_cells": """SELECT a.lang AS lang, b.source AS source FROM (SELECT DISTINCT lang FROM documents) a CROSS JOIN (SELECT DISTINCT source FROM documents) b LEFT JOIN (SELECT DISTINCT lang, source FROM documents) c ON c.lang = a.lang AND c.source = b.source WHERE c.lang IS NULL""",
    "probe_run_totals": """SELECT CAST(ts AS DATE) AS run, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS triggered, count(DISTINCT user_id) AS probes, round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 4) AS cost FROM events GROUP BY CAST(ts AS DATE)""",
    "probe_regression": """WITH r AS (SELECT user_id % 10 AS probe, CAST(ts AS DATE) AS run, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS triggered FROM events GROUP BY user_id % 10, CAST(ts AS DATE)),
o AS (SELECT run, row_number() OVER (ORDER BY run) AS ord FROM (SELECT DISTINCT run FROM r) x), k AS (SELECT probe, ord, triggered FROM r JOIN o ON o.run = r.run)
SELECT c.probe AS probe, c.ord AS ord, coalesce(p.triggered, 0) = 0 AND c.triggered = 1 AS regressed FROM k c LEFT JOIN k p ON p.probe = c.probe AND p.ord = c.ord - 1 WHERE c.ord > 1""",
    "probe_trend": """WITH r AS (SELECT user_id % 10 AS probe, CAST(ts AS DATE) AS run, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS triggered FROM events GROUP BY user_id % 10, CAST(ts AS DATE))
SELECT probe, run, triggered, sum(triggered) OVER w * 2 > count(*) OVER w AS worsening FROM r WINDOW w AS (PARTITION BY probe ORDER BY run ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "expected_loss_rank": """SELECT p_brand, round(avg(l_discount), 6) AS rate, round(avg(l_extendedprice), 2) AS cost, rank() OVER (ORDER BY round(avg(l_discount) * avg(l_extendedprice), 4) DESC) AS place FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand""",
    "exact_split": """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS STRING)), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= greatest(1, floor(n * 0.2e0)) THEN 'held_out' WHEN k <= greatest(1, floor(n * 0.2e0)) + greatest(1, floor(n * 0.3e0)) THEN 'dev' ELSE 'train' END AS split FROM r""",
    "stratified_sample": """SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS STRING)), doc_id) AS k FROM documents) x WHERE k <= 6""",
    "family_separation": """SELECT s.s_suppkey AS s_suppkey, r.r_name AS family FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3)""",
    "calibration_mae": """SELECT d.lang AS lang, round(avg(abs(l.quality - l.toxic) * 1.0e0), 3) AS mae, avg(abs(l.quality - l.toxic) * 1.0e0) > 0.5e0 AS biased, round(avg(CASE WHEN l.quality <> l.toxic THEN 1.0e0 ELSE 0.0e0 END), 3) AS flip FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang""",
    "embargo_filter": """SELECT doc_id, source FROM documents WHERE source <> 'src0'""",
    "latency_percentiles": """SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 4) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 4) AS p95 FROM events GROUP BY event_type""",
    "label_upsert": """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.quality, b.quality) AS quality FROM (SELECT doc_id, quality FROM labels WHERE doc_id IS NOT NULL) a FULL OUTER JOIN (SELECT doc_id, toxic AS quality FROM labels WHERE doc_id IS NOT NULL) b ON a.doc_id = b.doc_id""",
}
ORACLES |= {
    "crosstab_pivot": "SELECT lang, count(*) FILTER (quality = 0) AS \"0\", count(*) FILTER (quality = 1) AS \"1\", count(*) FILTER (quality IN (0, 1)) AS total FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang",
    "calibration_verdict": "WITH r AS (SELECT 'labels' AS criterion, quality AS a, toxic AS b FROM labels UNION ALL SELECT 'itself', toxic, toxic FROM labels), c AS (SELECT criterion, round(avg(a), 3) AS mean_a, round(avg(b), 3) AS mean_b, round(avg(abs(a - b)), 3) AS mae, avg(abs(a - b)) > 0.5 AS biased, round(avg((a <> b)::int), 3) AS flip FROM r GROUP BY 1) SELECT *, CASE WHEN (SELECT bool_or(biased OR flip > 0.15) FROM c) THEN 'INVESTIGATE' ELSE 'OK' END AS recommendation FROM c",
    "upsert_counts": "SELECT count(*) FILTER (a.quality IS NULL) AS written, count(*) FILTER (a.quality IS NOT NULL) AS skipped FROM labels b LEFT JOIN labels a ON a.doc_id = b.doc_id WHERE b.doc_id IS NOT NULL",
    "model_families": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'first' WHEN n_nationkey % 3 = 1 THEN 'second' END AS family FROM nation",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(_table(spark, sf_dir, "labels"), "doc_id")


def _probe_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return _table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("probe"), F.to_date("ts").alias("run")).agg(F.max(hit).alias("triggered"))


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by region, of those regions that the first three nations are in."""
    nation = _table(spark, sf_dir, "nation")
    rows = _table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return same_family(rows.select("s_suppkey", "n_regionkey", F.col("r_name").alias("family")), nation.where("n_nationkey < 3"), "n_regionkey").select("s_suppkey", "family")


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 3 == 0, "One/Large").when(F.col("n_nationkey") % 3 == 1, "special").otherwise("other/x")
    return _table(spark, sf_dir, "nation").select("n_nationkey", model_family(name, {"one": "first", "special": "second"}).alias("family"))


def _big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("big", F.when(F.col("value") > 50, 1.0).otherwise(0.0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cohen_kappa": lambda s, d: kappa(_labelled(s, d), "lang", "quality", "toxic"),
    "wilson_ci": lambda s, d: wilson(_big(s, d), "event_type", F.col("big")),
    "normal_ci": lambda s, d: normal_interval(_big(s, d), "event_type", F.col("big")),
    "crosstab_cube": lambda s, d: crosstab(_labelled(s, d), "lang", "source", "quality"),
    "crosstab_pivot": lambda s, d: crosstab_pivot(_labelled(s, d), "lang", "quality", [0, 1]),
    "share_tolerance": lambda s, d: shares(_table(s, d, "documents"), "lang", 0.25, 0.05),
    "duplicate_keys": lambda s, d: duplicates(_table(s, d, "pages"), "url"),
    "missing_cells": lambda s, d: missing_cells(_table(s, d, "documents"), "lang", "source"),
    "probe_run_totals": lambda s, d: run_totals(_table(s, d, "events"), F.to_date("ts"), F.col("event_type") == "error", "user_id", "value"),
    "probe_regression": lambda s, d: regressions(_probe_runs(s, d)),
    "probe_trend": lambda s, d: trend(_probe_runs(s, d)),
    "expected_loss_rank": lambda s, d: loss_rank(_table(s, d, "lineitem").join(_table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")), "p_brand", "l_discount", "l_extendedprice"),
    "exact_split": lambda s, d: exact_split(_table(s, d, "documents"), "doc_id"),
    "stratified_sample": lambda s, d: stratified_sample(_table(s, d, "documents"), "lang", "doc_id", 6),
    "family_separation": _families,
    "model_families": _models,
    "calibration_mae": lambda s, d: calibration(_labelled(s, d), "lang", "quality", "toxic"),
    "calibration_verdict": lambda s, d: calibration_verdict(_table(s, d, "labels"), {"labels": ("quality", "toxic"), "itself": ("toxic", "toxic")}),
    "embargo_filter": lambda s, d: _table(s, d, "documents").where("source <> 'src0'").select("doc_id", "source"),
    "latency_percentiles": lambda s, d: percentiles(_table(s, d, "events"), "event_type", "value"),
    "label_upsert": lambda s, d: upsert(_table(s, d, "labels"), _table(s, d, "labels").select("doc_id", F.col("toxic").alias("quality")), "doc_id", "quality"),
    "upsert_counts": lambda s, d: upsert_counts(_table(s, d, "labels"), _table(s, d, "labels"), "doc_id", "quality"),
}
