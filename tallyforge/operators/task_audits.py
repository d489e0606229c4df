"""Audits of tasks, judged rows, pairs and traces that take a whole report of one table: fields, cells, keys, losses, costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyforge.functions.json_schema import kind, parsed
from tallyforge.operators.evaluation import filter_verdict
from tallyforge.operators.generation import pair_audit
from tallyforge.operators.invariants import DIMENSIONS, MODES, PARTITIONS, pair_structure
from tallyforge.storage import kept

# Keys that a task's input must have, highest scores, and cells that are known to be empty.
INPUT_KEYS = ("hiring_signal_brief", "bench_summary_snapshot", "prospect_context")
MAX_SCORES = {"signal_grounding": 3, "capacity_honesty": 3, "tone_preservation": 5, "consent_coordination": 3, "gap_framing": 3}
KNOWN_GAPS = (("signal_grounding", "hand_authored"), ("capacity_honesty", "programmatic"), ("gap_framing", "programmatic"))
DEDUP_PATHS = ("$.hiring_signal_brief.company", "$.hiring_signal_brief.open_role", "$.hiring_signal_brief.signal_source", "$.prospect_context.company", "$.prospect_context.sector")


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def field_checks(tasks: DataFrame, gaps: tuple[tuple[str, str], ...] = KNOWN_GAPS) -> DataFrame:
    """check, violations and the smallest violating value, of the fields of tasks and of the cells that they fill.

    ``tasks`` has task_id, dimension, source_mode, partition, input_keys (array), confidence, roles
    (whether the list is there), max_score, threshold and scored (array). Nulls violate the checks of
    their columns, but a dimension that isn't known has no fixed highest score. Empty cells among
    ``gaps`` are known and no violation: the row ``known_gap`` names the first that is empty.
    ``partition_sum`` counts the tasks outside the known partitions. An empty table has no violation by row and all those by cell.
    """
    fixed = _lookup(MAX_SCORES, F.col("dimension"))
    by_row = {
        "input_keys": F.size(F.array_except(F.array(*map(F.lit, INPUT_KEYS)), F.col("input_keys"))) == 0,
        "confidence_range": F.col("confidence").between(0, 1),
        "available_roles": F.col("roles"),
        "max_score_least": F.col("max_score") >= 1,
        "max_score_fixed": fixed.isNull() | (F.coalesce("max_score", F.lit(-1)) == fixed),
        "threshold_range": (F.col("threshold") > 0) & (F.col("threshold") <= 1),
        "dimensions_scored": F.size("scored") > 0,
        "partition_sum": F.col("partition").isin(*PARTITIONS),
    }
    bad = {n: ~F.coalesce(c, F.lit(False)) for n, c in by_row.items()}
    # one aggregation for the rows' checks and the cells
    cells = kept(tasks.groupBy("partition", "dimension", "source_mode").agg(F.count("*").alias("n"), *[x for n, c in bad.items() for x in (F.count_if(c).alias(n), F.min(F.when(c, F.coalesce("task_id", F.lit("null")))).alias(f"{n}_at"))]))
    sums = cells.agg(*[x for n in bad for x in (F.coalesce(F.sum(n), F.lit(0)).alias(n), F.min(f"{n}_at").alias(f"{n}_at"))])
    out = [sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations"), F.col(f"{n}_at").alias("sample")) for n in bad])).alias("x")).select("x.*")]
    spark = tasks.sparkSession

    def lacking(name: str, wanted: list[tuple], *axes: str, known: bool = False) -> None:
        grid = spark.createDataFrame(wanted, ", ".join(f"{a} string" for a in axes))
        rest = grid.join(cells, list(axes), "left_anti").select(F.concat_ws("/", *axes).alias("v"))
        count = F.lit(0).cast("bigint") if known else F.count("*")
        out.append(rest.agg(F.lit(name).alias("check"), count.alias("violations"), F.min("v").alias("sample")))

    lacking("partition_present", [(p,) for p in PARTITIONS], "partition")
    lacking("cell_filled", [(d, m) for d in DIMENSIONS for m in MODES if (d, m) not in gaps], "dimension", "source_mode")
    lacking("known_gap", list(gaps), "dimension", "source_mode", known=True)
    return reduce(DataFrame.unionByName, out)


def decoded_ids(rows: DataFrame, id_: str = "task_id") -> DataFrame:
    """``rows`` with the dimension's code and name and the source mode that the id stands for.

    The second and third part of the id between hyphens; codes that aren't known, and ids that are
    null or lack the part, have the name Unknown.
    """
    part = lambda i: F.get(F.split(id_, "-"), i)
    names, modes = {v: k for k, v in DIMENSIONS.items()}, {v[0]: k for k, v in MODES.items()}
    known = lambda table, c: F.coalesce(_lookup(table, c), F.lit("Unknown"))
    return rows.withColumns({"dimension_code": part(1), "decoded_dimension": known(names, part(1)), "decoded_mode": known(modes, part(2))})


def dedup_key(body: Column, paths: tuple[str, ...] = DEDUP_PATHS) -> Column:
    """The fields of a JSON text that tell whether two tasks are about the same, joined by a space.

    An absent field is an empty text, a null is ``None`` and true is ``True``, as in Python; numbers are
    as JSON has them. A text that is no JSON has the key of one without fields.
    """
    value = parsed(body)

    def shown(path: str) -> Column:
        v = F.try_variant_get(value, path, "variant")
        return F.when(v.isNull(), "").when(kind(v) == "null", "None").when(kind(v) == "boolean", F.initcap(F.to_json(v))).when(kind(v) == "string", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))

    return F.concat_ws(" ", *map(shown, paths))


def judged(rows: DataFrame, model: str, threshold: float = 7) -> DataFrame:
    """``rows`` (id, stated, total) with the verdict, and for those that pass a struct of the judge's fields.

    The verdict is what the judge states, else whether the total reaches ``threshold``; null where
    neither is known.
    """
    verdict = filter_verdict(F.col("stated"), F.col("total"), threshold)
    judge = F.struct(F.lit(model).alias("model"), F.col("total").alias("score"), F.coalesce("stated", F.lit(True)).alias("passed"))
    return rows.withColumn("verdict", verdict).withColumn("judge", F.when(F.col("verdict"), judge))


def trace_summary(rows: DataFrame, by: str, duration: str, cost: str, passed: Column) -> DataFrame:
    """Per group: runs, pass rate, mean cost, and exact median and 95th percentile of the duration, interpolated.

    Null durations and costs don't count in theirs; a null outcome is none that passed.
    """
    rate = F.avg(F.when(passed, 1.0).otherwise(0.0))
    at = lambda q, n: F.round(F.percentile(duration, q), 4).alias(n)
    return rows.groupBy(by).agg(F.count("*").alias("runs"), F.round(rate, 4).alias("pass_rate"), F.round(F.avg(cost), 4).alias("mean_cost"), at(0.5, "p50"), at(0.95, "p95"))


def loss_report(rows: DataFrame, by: str, rate: str, cost: str, top: int = 3) -> DataFrame:
    """Groups by expected loss, which is mean rate times mean cost: place, whether among the ``top``, share, and the total.

    Equal losses, at four decimals, share a place. Groups without a rate or cost have a null loss, the
    last place and no share. A row a group is ranked in one task.
    """
    loss = F.round(F.avg(rate) * F.avg(cost), 4)
    groups = rows.groupBy(by).agg(F.count("*").alias("rows"), loss.alias("loss"))
    whole = F.sum("loss").over(Window.partitionBy())
    place = F.rank().over(Window.orderBy(F.desc_nulls_last("loss")))
    return groups.select(by, "rows", "loss", place.alias("place"), (place <= top).alias("in_top"), F.round(F.try_divide(F.col("loss"), whole), 4).alias("share"), F.round(whole, 4).alias("total_loss"))


def cost_table(conditions: DataFrame, tasks: int, trials: int, baseline: str) -> DataFrame:
    """``conditions`` (name, cost, quality) with cost per task, the difference to the baseline's and that in percent, and quality per dollar.

    Tasks times trials share the cost; 1 stands for it if either is 0. A baseline that costs nothing
    makes every percentage 0; without a baseline differences are null. Quality per dollar is null for
    a condition without cost.
    """
    shares = float(tasks * trials or 1)
    rows = conditions.withColumn("per_task", F.col("cost") / shares)
    base = rows.where(F.col("name") == baseline).agg(F.max("per_task").alias("base"))
    delta = F.col("per_task") - F.col("base")
    percent = F.when(F.col("base") == 0, 0.0).otherwise(F.try_divide(delta, F.col("base")) * 100)
    return rows.crossJoin(base).select("name", "cost", "quality", *[F.round(c, 6).alias(n) for n, c in (("per_task", F.col("per_task")), ("delta", delta), ("delta_pct", percent), ("quality_per_dollar", F.try_divide("quality", "cost")))])


def pair_content(pairs: DataFrame, required: dict[str, str], forbidden: dict[str, str]) -> DataFrame:
    """Per dimension: pairs, chosen texts without the required pattern, chosen and rejected ones with the forbidden one.

    A rejected text that has no forbidden pattern teaches nothing: ``rejected_clean`` counts those. A
    dimension without a pattern has no violation of it; null texts lack every pattern.
    """
    hit = lambda text, table: reduce(lambda out, kv: F.when(F.col("dimension") == kv[0], F.coalesce(F.col(text).rlike(kv[1]), F.lit(False))).otherwise(out), table.items(), F.lit(None).cast("boolean"))
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return pairs.groupBy("dimension").agg(F.count("*").alias("pairs"), n(~hit("chosen", required), "chosen_lacks"), n(hit("chosen", forbidden), "chosen_forbidden"), n(~hit("rejected", forbidden), "rejected_clean"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a task, whose fields follow from its id, length and language."""
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("i"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n"), F.col("lang"))
    pick = lambda c, values: F.get(F.array(*map(F.lit, values)), F.pmod(c, F.lit(len(values))).cast("int"))
    i, n = F.col("i"), F.col("n")
    return d.select(
        F.concat(F.lit("T"), i.cast("string")).alias("task_id"), pick(i, [*DIMENSIONS, "other"]).alias("dimension"), F.when(i % 6 != 1, pick(n, MODES)).otherwise("trace_derived").alias("source_mode"),
        pick(i, [*PARTITIONS, "spare"]).alias("partition"), F.when(n % 5 == 0, F.array(F.lit(INPUT_KEYS[0]))).otherwise(F.array(*map(F.lit, [*INPUT_KEYS, "more"]))).alias("input_keys"),
        F.when(F.col("lang").isNotNull(), n / 4000.0).alias("confidence"), (n % 3 != 0).alias("roles"), (n % 7).cast("int").alias("max_score"), (n % 4 / 2.0).alias("threshold"),
        F.when(n % 11 == 0, F.array().cast("array<string>")).when(n % 13 != 0, F.array(F.lit("x"))).alias("scored"),
    )


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("long")
    codes = F.array(*map(F.lit, [*DIMENSIONS.values(), "ZZ"]))
    modes = F.array(*[F.lit(v[0]) for v in MODES.values()], F.lit("tr"))
    whole = F.concat_ws("-", F.lit("TB"), F.get(codes, F.pmod(i, F.lit(6)).cast("int")), F.get(modes, F.pmod(i, F.lit(5)).cast("int")), F.lpad(i.cast("string"), 6, "0"))
    return _read(spark, sf_dir, "documents").select(F.when(i % 9 == 0, F.lit("nothing")).when(i % 9 != 1, whole).alias("task_id"))


def decoded_id_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded_ids(_ids(spark, sf_dir)).groupBy("dimension_code", "decoded_dimension", "decoded_mode").agg(F.count("*").alias("n"))


def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tasks in JSON: how many have each key, by nation, and by balance in whole thousands."""
    s = _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("nation"), F.floor(F.col("s_acctbal") / 1000).alias("b"))
    role = F.when(F.col("b") < 0, "").when(F.col("b") % 3 == 0, ', "open_role": null').when(F.col("b") % 3 == 1, ', "open_role": true').otherwise(F.concat(F.lit(', "open_role": '), F.col("b").cast("string")))
    body = F.concat(F.lit('{"hiring_signal_brief": {"company": "n'), F.col("nation"), F.lit('"'), role, F.lit('}, "prospect_context": {"sector": "é"}}'))
    text = F.when(F.col("k") == "7", F.lit("broken")).when(F.col("k") != "8", body)
    return s.select(dedup_key(text).alias("key")).groupBy("key").agg(F.count("*").alias("tasks"))


def judged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judged rows: quality is what the judge states where toxic is 0, and the total is from 5 on by id."""
    rows = _read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("id"), F.when(F.col("toxic") == 0, F.col("quality") == 1).alias("stated"), F.when(F.col("doc_id") % 6 > 0, F.col("doc_id") % 6 + 4).cast("int").alias("total"))
    out = judged(rows, "judge-1")
    return out.select("id", "verdict", F.col("judge.model").alias("judge_model"), F.col("judge.score").alias("judge_score"), F.col("judge.passed").alias("judge_passed"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pairs: the first assistant turn is chosen, the last one rejected if it is another."""
    turns = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[f(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias(n) for n, f in (("first", F.min), ("last", F.max))])
    names = F.array(*map(F.lit, [*DIMENSIONS, ""]))
    return turns.select(F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("pair_id"), F.get(names, F.pmod("conv_id", F.lit(6)).cast("int")).alias("dimension"), F.col("first.text").alias("chosen"), F.when(F.col("last.turn") > F.col("first.turn"), F.col("last.text")).alias("rejected"))


REQUIRED = {"signal_grounding": "e", "capacity_honesty": "th", "gap_framing": "er"}
FORBIDDEN = {"signal_grounding": "an", "tone_preservation": "on", "gap_framing": "zz"}


def cost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    rows = events.groupBy(F.col("event_type").alias("name")).agg(F.round(F.sum("value"), 4).alias("cost"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("quality"))
    users = events.agg(F.countDistinct("user_id")).first()[0]  # one number
    return cost_table(rows, users, 3, "error")


QUERIES = {
    "field_checks": lambda s, d: field_checks(_tasks(s, d)),
    "decoded_id_counts": decoded_id_counts,
    "dedup_keys": dedup_keys,
    "judged_rows": judged_rows,
    "trace_summary": lambda s, d: trace_summary(_read(s, d, "events").withColumn("cost", F.col("value") / 1000), "event_type", "value", "cost", F.col("value") > 50),
    "loss_report": lambda s, d: loss_report(_read(s, d, "lineitem").withColumn("flags", F.concat("l_returnflag", "l_linestatus")), "flags", "l_discount", "l_extendedprice"),
    "cost_table": cost_rows,
    "pair_structure": lambda s, d: pair_structure(_pairs(s, d)),
    "pair_content": lambda s, d: pair_content(_pairs(s, d), REQUIRED, FORBIDDEN),
    "pair_words": lambda s, d: pair_audit(_pairs(s, d)),
}

_T = """WITH d AS (SELECT doc_id AS i, coalesce(n_chars, 0) AS n, lang FROM documents),
t AS (SELECT 'T' || i AS task_id, (['signal_grounding', 'capacity_honesty', 'tone_preservation', 'consent_coordination', 'gap_framing', 'other'])[i % 6 + 1] AS dimension,
CASE WHEN i % 6 <> 1 THEN (['trace_derived', 'programmatic', 'multi_llm_synthesis', 'hand_authored'])[n % 4 + 1] ELSE 'trace_derived' END AS mode, (['train', 'dev', 'held_out', 'spare'])[i % 4 + 1] AS part, i, n, lang FROM d)"""
_CHECKS = {
    "input_keys": "n % 5 = 0", "confidence_range": "lang IS NULL OR n > 4000", "available_roles": "n % 3 = 0", "max_score_least": "n % 7 < 1",
    "max_score_fixed": "dimension <> 'other' AND n % 7 <> CASE WHEN dimension = 'tone_preservation' THEN 5 ELSE 3 END", "threshold_range": "n % 4 NOT IN (1, 2)", "dimensions_scored": "n % 11 = 0 OR n % 13 = 0", "partition_sum": "part = 'spare'",
}
_ROW_CHECKS = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) AS violations, min(task_id) AS sample FROM t WHERE {c}" for n, c in _CHECKS.items())
_GRID = "(VALUES ('signal_grounding'), ('capacity_honesty'), ('tone_preservation'), ('consent_coordination'), ('gap_framing')) a(x), (VALUES ('trace_derived'), ('programmatic'), ('multi_llm_synthesis'), ('hand_authored')) b(y) WHERE NOT EXISTS (SELECT 1 FROM t WHERE dimension = x AND mode = y)"
_GAPS = "(x, y) IN (('signal_grounding', 'hand_authored'), ('capacity_honesty', 'programmatic'), ('gap_framing', 'programmatic'))"
_P = """WITH a AS (SELECT conv_id, arg_min(text, turn) AS chosen, arg_max(text, turn) AS last, min(turn) AS f, max(turn) AS l FROM conversations WHERE role = 'assistant' GROUP BY 1),
p AS (SELECT 'p' || c.conv_id AS pair_id, (['signal_grounding', 'capacity_honesty', 'tone_preservation', 'consent_coordination', 'gap_framing', ''])[c.conv_id % 6 + 1] AS dimension, chosen, CASE WHEN l > f THEN last END AS rejected FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a USING (conv_id))"""
_HIT = lambda c, table: "CASE dimension " + " ".join(f"WHEN '{d}' THEN coalesce(regexp_matches({c}, '{p}'), false)" for d, p in table.items()) + " END"
_WORDS = lambda c: f"len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"
ORACLES = {
    "field_checks": f"""{_T} {_ROW_CHECKS}
UNION ALL SELECT 'partition_present', count(*), min(z) FROM (VALUES ('train'), ('dev'), ('held_out')) c(z) WHERE z NOT IN (SELECT part FROM t)
UNION ALL SELECT 'cell_filled', count(*), min(x || '/' || y) FROM {_GRID} AND NOT {_GAPS} UNION ALL SELECT 'known_gap', 0, min(x || '/' || y) FROM {_GRID} AND {_GAPS}""",
    "decoded_id_counts": """WITH i AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'nothing' WHEN doc_id % 9 <> 1 THEN 'TB-' || (['SG', 'CH', 'TP', 'CC', 'GF', 'ZZ'])[doc_id % 6 + 1] || '-' || (['TR', 'PR', 'ML', 'HA', 'tr'])[doc_id % 5 + 1] || '-' || doc_id END AS id FROM documents),
s AS (SELECT string_split(id, '-') AS s FROM i)
SELECT s[2] AS dimension_code, CASE s[2] WHEN 'SG' THEN 'signal_grounding' WHEN 'CH' THEN 'capacity_honesty' WHEN 'TP' THEN 'tone_preservation' WHEN 'CC' THEN 'consent_coordination' WHEN 'GF' THEN 'gap_framing' ELSE 'Unknown' END AS decoded_dimension,
CASE s[3] WHEN 'TR' THEN 'trace_derived' WHEN 'PR' THEN 'programmatic' WHEN 'ML' THEN 'multi_llm_synthesis' WHEN 'HA' THEN 'hand_authored' ELSE 'Unknown' END AS decoded_mode, count(*) AS n FROM s GROUP BY ALL""",
    "dedup_keys": """WITH s AS (SELECT s_suppkey % 50 AS k, s_nationkey AS n, CAST(floor(s_acctbal / 1000) AS BIGINT) AS b FROM supplier)
SELECT CASE WHEN k IN (7, 8) THEN '    ' ELSE 'n' || n || ' ' || CASE WHEN b < 0 THEN '' WHEN b % 3 = 0 THEN 'None' WHEN b % 3 = 1 THEN 'True' ELSE CAST(b AS VARCHAR) END || '   é' END AS key, count(*) AS tasks FROM s GROUP BY ALL""",
    "judged_rows": """WITH r AS (SELECT doc_id AS id, CASE WHEN toxic = 0 THEN quality = 1 END AS stated, CASE WHEN doc_id % 6 > 0 THEN doc_id % 6 + 4 END AS total FROM labels), v AS (SELECT *, coalesce(stated, total >= 7) AS verdict FROM r)
SELECT id, verdict, CASE WHEN verdict THEN 'judge-1' END AS judge_model, CASE WHEN verdict THEN total END AS judge_score, CASE WHEN verdict THEN coalesce(stated, true) END AS judge_passed FROM v""",
    "trace_summary": "SELECT event_type, count(*) AS runs, round(avg(CASE WHEN value > 50 THEN 1.0e0 ELSE 0 END), 4) AS pass_rate, round(avg(value / 1000), 4) AS mean_cost, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1",
    "loss_report": """WITH g AS (SELECT l_returnflag || l_linestatus AS flags, count(*) AS rows, round(avg(l_discount) * avg(l_extendedprice), 4) AS loss FROM lineitem GROUP BY 1)
SELECT *, rank() OVER (ORDER BY loss DESC NULLS LAST) AS place, rank() OVER (ORDER BY loss DESC NULLS LAST) <= 3 AS in_top, round(loss / sum(loss) OVER (), 4) AS share, round(sum(loss) OVER (), 4) AS total_loss FROM g""",
    "cost_table": """WITH r AS (SELECT event_type AS name, round(sum(value), 4) AS cost, round(avg((value > 50)::int), 6) AS quality FROM events GROUP BY 1), n AS (SELECT 3 * count(DISTINCT user_id) AS n FROM events),
p AS (SELECT r.*, cost / n AS per_task FROM r, n), b AS (SELECT max(per_task) AS base FROM p WHERE name = 'error')
SELECT name, cost, quality, round(per_task, 6) AS per_task, round(per_task - base, 6) AS delta, round((per_task - base) / base * 100, 6) AS delta_pct, round(quality / cost, 6) AS quality_per_dollar FROM p, b""",
    "pair_structure": f"{_P} SELECT count(*) AS rows, count(*) FILTER (coalesce(trim(pair_id), '') = '') AS no_pair_id, count(*) FILTER (coalesce(trim(dimension), '') = '') AS no_dimension, count(*) FILTER (coalesce(trim(chosen), '') = '') AS no_chosen, count(*) FILTER (coalesce(trim(rejected), '') = '') AS no_rejected FROM p",
    "pair_content": f"{_P} SELECT dimension, count(*) AS pairs, count(*) FILTER (NOT {_HIT('chosen', REQUIRED)}) AS chosen_lacks, count(*) FILTER ({_HIT('chosen', FORBIDDEN)}) AS chosen_forbidden, count(*) FILTER (NOT {_HIT('rejected', FORBIDDEN)}) AS rejected_clean FROM p GROUP BY 1",
    "pair_words": f"{_P}, w AS (SELECT dimension, {_WORDS('chosen')} AS a, {_WORDS('rejected')} AS b FROM p) SELECT dimension, count(*) AS pairs, round(avg(a), 4) AS chosen_mean, round(stddev_samp(a), 4) AS chosen_sd, round(avg(b), 4) AS rejected_mean, round(stddev_samp(b), 4) AS rejected_sd FROM w GROUP BY 1",
}
