"""Dataset invariants as one table (check, violations, sample) over tasks of the survey's shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

# The enumerations, codes, targets and known gaps of the task format.
DIMENSIONS = {"signal_grounding": "SG", "capacity_honesty": "CH", "tone_preservation": "TP", "consent_coordination": "CC", "gap_framing": "GF"}
MODES = {"trace_derived": ("TR", 0.408), "programmatic": ("PR", 0.192), "multi_llm_synthesis": ("ML", 0.208), "hand_authored": ("HA", 0.192)}
DIFFICULTIES = ("easy", "medium", "hard", "adversarial")
PARTITIONS = {"train": 0.5, "dev": 0.3, "held_out": 0.2}
TASK_ID = r"^TB-[A-Z]{2}-[A-Z]{2}-[0-9]{4}$"


def _grid(spark: SparkSession, **axes) -> DataFrame:
    """All combinations of the values of a few literal axes."""
    return reduce(DataFrame.crossJoin, [spark.createDataFrame([(v,) for v in values], f"{name} string") for name, values in axes.items()])


def invariant_report(tasks: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """check, violations and the smallest violating value, one row a check.

    ``tasks`` has task_id, dimension, source_mode, difficulty, partition, stated_partition, probe_refs
    (array), confidence, max_score, threshold. Nulls violate the checks of their columns. Checks by
    row share one aggregation.
    """
    spark = tasks.sparkSession
    code = F.element_at(F.create_map(*[F.lit(x) for kv in DIMENSIONS.items() for x in kv]), F.col("dimension"))
    mode = F.element_at(F.create_map(*[F.lit(x) for k, v in MODES.items() for x in (k, v[0])]), F.col("source_mode"))
    parts = F.split("task_id", "-")
    by_row = {
        "dimension_enum": F.col("dimension").isin(*DIMENSIONS),
        "source_mode_enum": F.col("source_mode").isin(*MODES),
        "difficulty_enum": F.col("difficulty").isin(*DIFFICULTIES),
        "probe_refs": F.size("probe_refs") > 0,
        "id_pattern": F.col("task_id").rlike(TASK_ID),
        "id_dimension": F.get(parts, 1) == code,
        "id_source": F.get(parts, 2) == mode,
        "stated_partition": F.col("stated_partition") == F.col("partition"),
        "confidence_range": F.col("confidence").between(0, 1),
        "max_score": F.col("max_score") == F.when(F.col("dimension") == "tone_preservation", 5).otherwise(3),
        "threshold_range": (F.col("threshold") > 0) & (F.col("threshold") <= 1),
    }
    bad = {n: ~F.coalesce(c, F.lit(False)) for n, c in by_row.items()}
    sums = tasks.agg(*[x for n, c in bad.items() for x in (F.count_if(c).alias(n), F.min(F.when(c, F.coalesce("task_id", F.lit("null")))).alias(f"{n}_at"))])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations"), F.col(f"{n}_at").alias("sample")) for n in bad])
    out = [sums.select(F.explode(rows).alias("x")).select("x.*")]

    def violating(name: str, found: DataFrame, sample) -> None:
        out.append(found.agg(F.lit(name).alias("check"), F.count("*").alias("violations"), F.min(sample).alias("sample")).select("check", "violations", "sample"))

    violating("unique_id", tasks.groupBy("task_id").agg(F.count("*").alias("n")).where("n > 1"), F.col("task_id"))
    cells = tasks.groupBy("partition", "dimension", "source_mode", "difficulty").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"))
    for axis, target in (("partition", PARTITIONS), ("dimension", dict.fromkeys(DIMENSIONS, 0.2)), ("source_mode", {k: v[1] for k, v in MODES.items()})):
        want = spark.createDataFrame(list(target.items()), f"{axis} string, target double")
        share = want.join(cells.groupBy(axis).agg(F.sum("n").alias("n")), axis, "left").crossJoin(total)
        found = F.coalesce("n", F.lit(0)) / F.col("total")
        violating(f"{axis}_share", share.where(F.abs(found - F.col("target")) > tolerance + 1e-9), F.col(axis))
        violating(f"{axis}_present", want.join(cells, axis, "left_anti"), F.col(axis))
    joined = F.concat_ws("/", *[F.col(c) for c in ("x", "y")])
    for name, axes in (("mode_in_partition", {"source_mode": MODES, "partition": PARTITIONS}), ("cell_filled", {"dimension": DIMENSIONS, "source_mode": MODES})):
        (a, _), (b, _) = axes.items()
        lacking = _grid(spark, **axes).join(cells, [a, b], "left_anti").select(F.col(a).alias("x"), F.col(b).alias("y"))
        violating(name, lacking, joined)
    held = cells.where("partition = 'held_out'")
    violating("held_out_cover", _grid(spark, dimension=DIMENSIONS).join(held, "dimension", "left_anti").select("dimension").unionByName(_grid(spark, dimension=DIFFICULTIES).join(held.select(F.col("difficulty").alias("dimension")), "dimension", "left_anti")), F.col("dimension"))
    return reduce(DataFrame.unionByName, out)


def pair_structure(pairs: DataFrame) -> DataFrame:
    """Of preference pairs: rows, and rows without pair_id, dimension, chosen or rejected output."""
    lacks = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(f"no_{c}")
    return pairs.agg(F.count("*").alias("rows"), *map(lacks, ("pair_id", "dimension", "chosen", "rejected")))


def claim_check(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """``claims`` (claim, source, field, value) with the value at (source, field) and whether they agree."""
    known = facts.select("source", "field", F.col("value").alias("found"))
    return claims.join(known, ["source", "field"], "left").select("claim", "value", "found", F.coalesce(F.col("value") == F.col("found"), F.lit(False)).alias("verified"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as tasks: language as dimension, number of the source as mode and difficulty."""
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars", F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(0)).alias("s"))
    docs = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    lang = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    kind, mode = pick(DIMENSIONS, lang), pick(MODES, F.col("s") % 4)
    part = pick(PARTITIONS, F.when(F.col("doc_id") % 10 < 5, 0).when(F.col("doc_id") % 10 < 8, 1).otherwise(2))
    return docs.select(
        F.concat_ws("-", F.lit("TB"), pick(DIMENSIONS.values(), lang), pick([v[0] for v in MODES.values()], (F.col("s") % 5) % 4), F.lpad(F.col("doc_id").cast("string"), 4, "0")).alias("task_id"),
        kind.alias("dimension"), mode.alias("source_mode"), pick(DIFFICULTIES, F.col("s") % 3).alias("difficulty"), part.alias("partition"),
        F.when(F.col("quality").isNull(), F.lit("train")).otherwise(part).alias("stated_partition"),
        F.when(F.col("n_chars") > 200, F.array(F.lit("P-01"))).otherwise(F.array().cast("array<string>")).alias("probe_refs"),
        (F.col("n_chars") / 5000).alias("confidence"), F.when(F.col("quality") == 0, 4).otherwise(3).alias("max_score"), F.col("quality").cast("double").alias("threshold"),
    )


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invariant_report(_tasks(spark, sf_dir))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated numbers of nations by region against the table."""
    facts = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy(F.col("n_regionkey").cast("string").alias("field")).agg(F.count("*").cast("string").alias("value")).withColumn("source", F.lit("nation"))
    stated = spark.createDataFrame([("c0", "nation", "0", "5"), ("c1", "nation", "1", "4"), ("c2", "nation", "99", "1")], "claim string, source string, field string, value string")
    return claim_check(stated, facts)


_T = """WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
d AS (SELECT doc_id, n_chars, quality, coalesce(try_cast(regexp_extract(source, '(\\d+)$', 1) AS INT), 0) AS s, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS l, CASE WHEN doc_id % 10 < 5 THEN 'train' WHEN doc_id % 10 < 8 THEN 'dev' ELSE 'held_out' END AS partition FROM documents LEFT JOIN q USING (doc_id)),
t AS (SELECT 'TB-' || (['SG', 'CH', 'TP', 'CC'])[l] || '-' || (['TR', 'PR', 'ML', 'HA'])[s % 5 % 4 + 1] || '-' || lpad(left(CAST(doc_id AS VARCHAR), 4), 4, '0') AS task_id, (['SG', 'CH', 'TP', 'CC'])[l] AS dc, (['signal_grounding', 'capacity_honesty', 'tone_preservation', 'consent_coordination'])[l] AS dimension,
(['TR', 'PR', 'ML', 'HA'])[s % 4 + 1] AS mc, (['trace_derived', 'programmatic', 'multi_llm_synthesis', 'hand_authored'])[s % 4 + 1] AS source_mode, (['easy', 'medium', 'hard'])[s % 3 + 1] AS difficulty, partition,
CASE WHEN quality IS NULL THEN 'train' ELSE partition END AS stated, n_chars > 200 AS refs, n_chars / 5000 AS confidence, CASE WHEN quality = 0 THEN 4 ELSE 3 END AS max_score, quality AS threshold FROM d)""".replace("\\\\", "\\")
_ROW_CHECKS = {
    "dimension_enum": "false", "source_mode_enum": "false", "difficulty_enum": "false", "probe_refs": "NOT coalesce(refs, false)", "id_pattern": "NOT regexp_matches(task_id, '^TB-[A-Z]{2}-[A-Z]{2}-[0-9]{4}$')",
    "id_dimension": "split_part(task_id, '-', 2) <> dc", "id_source": "split_part(task_id, '-', 3) <> mc", "stated_partition": "stated <> partition", "confidence_range": "NOT coalesce(confidence BETWEEN 0 AND 1, false)",
    "max_score": "max_score <> CASE WHEN dimension = 'tone_preservation' THEN 5 ELSE 3 END", "threshold_range": "NOT coalesce(threshold > 0 AND threshold <= 1, false)",
}
_DIMS = "(VALUES ('signal_grounding'), ('capacity_honesty'), ('tone_preservation'), ('consent_coordination'), ('gap_framing')) a(x)"
_MODES = "(VALUES ('trace_derived', 0.408), ('programmatic', 0.192), ('multi_llm_synthesis', 0.208), ('hand_authored', 0.192)) b(y, g)"
_PARTS = "(VALUES ('train', 0.5), ('dev', 0.3), ('held_out', 0.2)) c(z, g)"
_SHARE = lambda axis, values, name, goal: f"SELECT '{axis}_share', count(*), min({name}) FROM {values} WHERE abs((SELECT count(*) FROM t WHERE {axis} = {name}) / (SELECT count(*) FROM t) - {goal}) > 0.05 UNION ALL SELECT '{axis}_present', count(*), min({name}) FROM {values} WHERE {name} NOT IN (SELECT {axis} FROM t)"
ORACLES = {
    "invariant_report": _T + " " + " UNION ALL ".join([
        *[f"SELECT '{n}' AS \"check\", count(*) AS violations, min(task_id) AS sample FROM t WHERE {c}" for n, c in _ROW_CHECKS.items()],
        "SELECT 'unique_id', count(*), min(task_id) FROM (SELECT task_id FROM t GROUP BY 1 HAVING count(*) > 1)",
        _SHARE("partition", _PARTS, "z", "g"), _SHARE("dimension", _DIMS, "x", "0.2"), _SHARE("source_mode", _MODES, "y", "g"),
        f"SELECT 'mode_in_partition', count(*), min(y || '/' || z) FROM {_MODES}, {_PARTS} WHERE NOT EXISTS (SELECT 1 FROM t WHERE source_mode = y AND partition = z)",
        f"SELECT 'cell_filled', count(*), min(x || '/' || y) FROM {_DIMS}, {_MODES} WHERE NOT EXISTS (SELECT 1 FROM t WHERE source_mode = y AND dimension = x)",
        f"SELECT 'held_out_cover', count(*), min(v) FROM (SELECT x AS v FROM {_DIMS} WHERE x NOT IN (SELECT dimension FROM t WHERE partition = 'held_out') UNION ALL SELECT e FROM (VALUES ('easy'), ('medium'), ('hard'), ('adversarial')) f(e) WHERE e NOT IN (SELECT difficulty FROM t WHERE partition = 'held_out'))",
    ]),
    "claim_check": "SELECT claim, k.value, CAST(n AS VARCHAR) AS found, coalesce(k.value = CAST(n AS VARCHAR), false) AS verified FROM (VALUES ('c0', 0, '5'), ('c1', 1, '4'), ('c2', 99, '1')) k(claim, r, value) LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) ON n_regionkey = r",
}
QUERIES = {"invariant_report": invariants, "claim_check": claims}
