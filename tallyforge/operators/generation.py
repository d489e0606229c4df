"""Generated tasks, pairs and prompts, run matrices, and rendering, as functions on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyforge.operators.invariants import DIFFICULTIES, DIMENSIONS, MODES


def hashed(n: int, *key) -> Column:
    """A number from 0 to n - 1 that depends on the key alone, and is the same in other engines."""
    return (F.conv(F.substring(F.md5(F.concat_ws("#", *key).cast("binary")), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def pick(values, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at)


def task_id(dimension: Column, source: Column, number: Column) -> Column:
    """``TB-XX-YY-0001`` of a dimension, a source mode and a number."""
    code = lambda table, c: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    return F.format_string("TB-%s-%s-%04d", code(DIMENSIONS, dimension), code({k: v[0] for k, v in MODES.items()}, source), number)


def sweep(spark: SparkSession, per_dimension: int, seed: int = 42) -> DataFrame:
    """``per_dimension`` tasks of each dimension, spread over the difficulties, the rest by hash.

    A cell of dimension and difficulty has one source mode. Hard and adversarial tasks have a turn of
    1 to 5, adversarial ones a confidence of 0.3.
    """
    each = per_dimension // len(DIFFICULTIES)
    rows = spark.range(per_dimension * len(DIMENSIONS)).select((F.col("id") % per_dimension).alias("k"), pick(DIMENSIONS, (F.col("id") / per_dimension).cast("int")).alias("dimension"), (F.col("id") + 1).alias("number"))
    at = F.when(F.col("k") < each * len(DIFFICULTIES), (F.col("k") / max(each, 1)).cast("int")).otherwise(hashed(len(DIFFICULTIES), F.lit(seed), "dimension", "k"))
    rows = rows.withColumn("difficulty", pick(DIFFICULTIES, at)).withColumn("source_mode", pick(MODES, hashed(len(MODES), F.lit(seed), "dimension", "difficulty")))
    turn = F.when(F.col("difficulty").isin("hard", "adversarial"), 1 + hashed(5, F.lit(seed), F.lit("turn"), "number"))
    sure = F.when(F.col("difficulty") == "adversarial", 0.3).otherwise(F.round(0.4 + hashed(60, F.lit(seed), F.lit("sure"), "number") / 100, 2))
    return rows.select(task_id(F.col("dimension"), F.col("source_mode"), F.col("number")).alias("task_id"), "dimension", "difficulty", "source_mode", sure.alias("confidence"), turn.alias("turn"))


def swept(prospects: DataFrame, pools: dict[str, DataFrame], seed: int = 42) -> DataFrame:
    """Tasks for every prospect (id): each dimension and difficulty, with an entry of each pool.

    ``pools`` have a column ``entry`` and few rows, numbered by it; each task takes one of each by the
    hash of its place. A cell of dimension and difficulty has one source mode. Adversarial tasks have
    a confidence of 0.3, hard and adversarial ones a turn of 1 to 5. An empty pool gives null entries.
    Prospects without an id, and rows that repeat one, give their tasks all the same.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("difficulty")) for d in DIMENSIONS for k in DIFFICULTIES]))
    rows = prospects.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("prospect"), cells.alias("c")).select("prospect", "c.*")
    rows = rows.withColumn("source_mode", pick(MODES, hashed(len(MODES), F.lit(seed), "dimension", "difficulty")))
    hard = F.col("difficulty").isin("hard", "adversarial")
    own = lambda n, name: hashed(n, F.lit(seed), F.lit(name), "prospect", "dimension", "difficulty")
    rows = rows.withColumn("turn", F.when(hard, 1 + own(5, "turn")))
    rows = rows.withColumn("confidence", F.when(F.col("difficulty") == "adversarial", 0.3).otherwise(F.round(0.4 + own(60, "sure") / 100, 2)))
    for name, pool in pools.items():
        # a pool is a short list
        numbered = pool.select((F.row_number().over(Window.orderBy("entry")) - 1).alias("place"), F.col("entry").alias(name))
        size = pool.agg(F.count("*").alias("n")).first()["n"]
        rows = rows.withColumn("place", own(max(size, 1), name)).join(numbered, "place", "left").drop("place")
    return rows


def run_matrix(tasks: DataFrame, trials: int, conditions: list[str]) -> DataFrame:
    """Every task under every condition, ``trials`` times: an explode a row, no join."""
    return tasks.withColumn("condition", F.explode(F.array(*map(F.lit, conditions)))).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))


def in_order(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``rows`` for each id of ``ids`` (place, id); ids without a row have found = false."""
    return ids.join(rows.withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def preview(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def token_cost(tokens: Column, price: float = 0.40) -> Column:
    """Cost in dollars at ``price`` a million tokens; 300 tokens where the number isn't known."""
    return F.coalesce(tokens, F.lit(300)) * price / 1e6


def prompt(company: Column, role: Column, confidence: Column, roles: Column, dimension: Column) -> Column:
    """The lines of a prompt: what is known, its confidence, free roles (an array of structs), and a task."""
    level = F.when(confidence < 0.5, "low").otherwise("high")
    free = F.when(F.size(roles) > 0, F.array_join(F.transform(roles, lambda r: F.format_string("- %s: %d", r["stack"], r["count"])), "\n")).otherwise("- none")
    tail = F.when(dimension == "capacity_honesty", "State only what is free.").when(dimension == "signal_grounding", "Ask where you are not sure.").otherwise("Write a short reply.")
    return F.concat_ws("\n", F.concat(F.lit("Company: "), company), F.concat(F.lit("Role: "), role), F.concat(F.lit("Confidence: "), F.format_string("%.2f", confidence), F.lit(" ("), level, F.lit(")")), F.lit("Free:"), free, tail)


def stub_response(text: Column, dimension: Column) -> Column:
    """A fixed answer by what the prompt holds, else by dimension."""
    return F.when(F.contains(text, F.lit("HARD RULES")), "rules").when(F.contains(text, F.lit("bench")), "bench").when(dimension == "capacity_honesty", "capacity").otherwise("plain")


def preference_pairs(tasks: DataFrame, n: int, shares: tuple[tuple[str, float], ...], templates: tuple[str, ...], seed: int = 42) -> DataFrame:
    """``n`` pairs dealt to dimensions by ``shares`` (the first gets the rest), each from a task by hash.

    ``tasks`` has dimension, k (0 to its number of tasks less one) and name. Templates hold ``{name}``.
    A dimension without tasks gives the name ``unknown``.
    """
    spark, counts = tasks.sparkSession, [int(n * share) for _, share in shares]
    counts[0] += n - sum(counts)
    dealt = spark.createDataFrame([(d, c) for (d, _), c in zip(shares, counts, strict=True)], "dimension string, c int").where("c > 0")
    dealt = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    sizes = tasks.groupBy("dimension").agg(F.count("*").alias("size"))
    number = F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(seed), "dimension", "i").cast("binary")), 1, 8), 16, 10).cast("bigint")
    rows = dealt.join(sizes, "dimension", "left").withColumn("k", F.when(F.col("size") > 0, number % F.col("size"))).join(tasks, ["dimension", "k"], "left")
    name = F.coalesce("name", F.lit("unknown"))
    fill = lambda salt: F.replace(pick(templates, hashed(len(templates), F.lit(salt), "dimension", "i")), F.lit("{name}"), name)
    return rows.select(F.format_string("PAIR-%s-%04d", F.upper(F.substring("dimension", 1, 2)), F.col("i")).alias("pair_id"), "dimension", fill("chosen").alias("chosen"), fill("rejected").alias("rejected"))


def training_rows(pairs: DataFrame, system: str | None = None) -> DataFrame:
    """pair_id, prompt, text and split (80/20 by hash) of pairs with an input column."""
    asked = F.col("input") if system is None else F.concat(F.lit(system + "\n"), F.col("input"))
    return pairs.select("pair_id", asked.alias("prompt"), F.concat(asked, F.lit("\n"), F.col("chosen")).alias("text"), F.when(hashed(5, "pair_id") == 0, "eval").otherwise("train").alias("split"))


def pair_audit(pairs: DataFrame) -> DataFrame:
    """Per dimension: pairs, and mean and deviation of the words of chosen and rejected texts."""
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    both = pairs.withColumn("a", words("chosen")).withColumn("b", words("rejected"))
    number = lambda f, c: F.round(f(c), 4)
    return both.groupBy("dimension").agg(F.count("*").alias("pairs"), number(F.avg, "a").alias("chosen_mean"), number(F.stddev_samp, "a").alias("chosen_sd"), number(F.avg, "b").alias("rejected_mean"), number(F.stddev_samp, "b").alias("rejected_sd"))


def regression_gate(rows: DataFrame, tolerance: float = -0.02) -> DataFrame:
    """``rows`` (dimension, base, changed, target) with delta, whether it regressed, and whether the target is met."""
    delta = F.round(F.col("changed") - F.col("base"), 6)
    return rows.withColumn("delta", delta).withColumn("regressed", F.coalesce(delta < tolerance, F.lit(False))).withColumn("met", F.coalesce(F.col("changed") >= F.col("target"), F.lit(False)))


def winner(text: Column) -> Column:
    """A, B or TIE; everything else is a tie."""
    said = F.upper(F.trim(text))
    return F.when(said.isin("A", "B"), said).otherwise("TIE")


def compare_two(rows: DataFrame) -> DataFrame:
    """Elo-like sums of judged pairs (a, b, winner, preference): one pair, or many."""
    who, pref = winner(F.col("winner")), F.coalesce("preference", F.lit(0))
    gain = F.when(who == "A", pref).when(who == "B", -pref).otherwise(0)
    signed = F.explode(F.array(F.struct(F.col("a").alias("task"), gain.alias("d")), F.struct(F.col("b").alias("task"), (-gain).alias("d")))).alias("x")
    return rows.select(signed).groupBy("x.task").agg(F.sum("x.d").cast("bigint").alias("score"), F.count_if(F.col("x.d") > 0).alias("wins"), F.count_if(F.col("x.d") < 0).alias("losses"))


def enriched(rows: DataFrame, model: str) -> DataFrame:
    """Passing rows with a struct of the judge's fields beside them."""
    return rows.where(F.coalesce("passed", F.col("total") >= 7)).withColumn("judge", F.struct(F.lit(model).alias("model"), F.col("total").alias("score"), F.coalesce("passed", F.lit(True)).alias("passed")))


def quota_sample(rows: DataFrame, n: int, key: str = "id", stratum: str = "dimension", seed: str = "42") -> DataFrame:
    """``n`` rows with a score: max(1, n // strata) of each stratum in hash order, topped up in hash order.

    Ranks within a stratum are windows over it; the top-up is a sort with a limit of ``n``.
    """
    rows = rows.where("score is not null").withColumn("h", F.md5(F.concat_ws("#", F.lit(seed), key).cast("binary")))
    strata = rows.agg(F.countDistinct(stratum).alias("strata"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(stratum).orderBy("h", key))).crossJoin(strata)
    over = (F.col("r") > F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("strata")))).cast("int")
    return ranked.withColumn("over", over).orderBy("over", "h", key).limit(n).select(key, stratum, "score")


def accepted(rows: DataFrame, n: int) -> DataFrame:
    """Attempts of each task up to the one at which ``n`` have passed; task, attempt, passed are read."""
    before = F.coalesce(F.sum(F.col("passed").cast("int")).over(Window.partitionBy("task").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where(F.col("before") < n).drop("before")


_SHARES = (("en", 0.6), ("fr", 0.2), ("zz", 0.2))
_TEMPLATES = ("Ask {name} first.", "Tell {name} all of it now.", "Wait.")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null")
    return docs.select(F.col("lang").alias("dimension"), F.concat(F.lit("d"), "doc_id").alias("name"), (F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1).cast("bigint").alias("k"))


def swept_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as prospects, nations as signals and regions as snapshots."""
    read = lambda t, c, n: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias(n))
    return swept(read("customer", "c_custkey", "id"), {"signal": read("nation", "n_name", "entry"), "snapshot": read("region", "r_name", "entry")})


def pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_pairs(_tasks(spark, sf_dir), 100, _SHARES, _TEMPLATES)


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as prospects: balance as confidence, segment as role, and every other one with a free role."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    # as in SQL the double product is rounded, which tells 0.145 from its decimal form
    sure = F.round(F.abs("c_acctbal") / 10000 * 100, 0) / 100
    roles = F.when(F.col("c_custkey") % 2 == 0, F.array(F.struct(F.lit("go").alias("stack"), (F.col("c_custkey") % 7).cast("int").alias("count")))).otherwise(F.array().cast("array<struct<stack:string,count:int>>"))
    kind = pick(("capacity_honesty", "signal_grounding", "gap_framing"), (F.col("c_custkey") % 3).cast("int"))
    text = prompt(F.col("c_name"), F.col("c_mktsegment"), sure, roles, kind)
    return rows.select("c_custkey", text.alias("prompt"), preview(text).alias("preview"), stub_response(text, kind).alias("answer"), F.round(token_cost(F.when(F.col("c_custkey") % 5 != 0, F.length(text))), 8).alias("cost"))


def run_matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_matrix(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id")), 3, ["base", "changed"])
    return rows.select("item_id", "condition", "trial")


def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(0, 7), (1, 3), (2, -1), (3, 3)], "place int, id long")
    return in_order(ids, spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), "n_name"))


def regression_gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("dimension"))
    rate = lambda low: F.avg(F.when((F.dayofmonth("ts") <= 15) == F.lit(low), (F.col("value") > 50).cast("double")))
    return regression_gate(rows.agg(rate(True).alias("a"), rate(False).alias("b")).select("dimension", F.round("a", 6).alias("base"), F.round("b", 6).alias("changed"), F.lit(0.4).alias("target")))


def quota_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("none")).alias("dimension"))
    return quota_sample(docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("score")), "id"), 30)


def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 20).alias("a"), (F.col("event_id") % 20 + 20).alias("b"), F.when(F.col("event_type") == "error", "b ").when(F.col("event_type") == "signup", "A").otherwise("neither").alias("winner"), (F.col("event_id") % 3).alias("preference"))
    return compare_two(rows)


def accepted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("task"), F.col("turn").alias("attempt"), (F.coalesce(F.length("text"), F.lit(0)) > 100).alias("passed"))
    return accepted(rows, 2)


_H = lambda *key: "(CAST('0x' || left(md5(" + " || '#' || ".join(key) + "), 8) AS BIGINT))"
QUERIES = {
    "swept_tasks": swept_query,
    "generated_tasks": lambda spark, sf_dir: sweep(spark, 50), "preference_pairs": pairs_query, "pair_audit": lambda spark, sf_dir: pair_audit(pairs_query(spark, sf_dir)),
    "training_rows": lambda spark, sf_dir: training_rows(pairs_query(spark, sf_dir).withColumn("input", F.concat(F.lit("about "), "dimension")), "Rules."),
    "prompt_render": prompt_render, "run_matrix": run_matrix_query, "ordered_lookup": ordered_lookup, "regression_gate": regression_gate_query,
    "quota_sample": quota_query, "judged_pairs": judged_pairs, "accepted_attempts": accepted_query,
}
_PAIR = f"""WITH t AS (SELECT lang AS dimension, 'd' || doc_id AS name, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents WHERE lang IS NOT NULL), z AS (SELECT dimension, count(*) AS size FROM t GROUP BY 1),
d AS (SELECT dimension, unnest(range(c)) AS i FROM (VALUES ('en', 60), ('fr', 20), ('zz', 20)) v(dimension, c)), r AS (SELECT d.*, {_H("'42'", "dimension", "i")} % size AS k FROM d LEFT JOIN z USING (dimension)),
n AS (SELECT r.dimension, i, coalesce(name, 'unknown') AS name FROM r LEFT JOIN t ON t.dimension = r.dimension AND t.k = r.k),
p AS (SELECT printf('PAIR-%s-%04d', upper(left(dimension, 2)), i) AS pair_id, dimension, replace((['Ask {{name}} first.', 'Tell {{name}} all of it now.', 'Wait.'])[{_H("'chosen'", "dimension", "i")} % 3 + 1], '{{name}}', name) AS chosen, replace((['Ask {{name}} first.', 'Tell {{name}} all of it now.', 'Wait.'])[{_H("'rejected'", "dimension", "i")} % 3 + 1], '{{name}}', name) AS rejected FROM n)"""
_WORDS = lambda c: f"len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"
ORACLES = {
    "swept_tasks": f"""WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS prospect, dimension, difficulty FROM customer, (VALUES ('signal_grounding'), ('capacity_honesty'), ('tone_preservation'), ('consent_coordination'), ('gap_framing')) d(dimension), (VALUES ('easy'), ('medium'), ('hard'), ('adversarial')) k(difficulty)),
s AS (SELECT n_name AS signal, row_number() OVER (ORDER BY n_name) - 1 AS i FROM nation), p AS (SELECT r_name AS snapshot, row_number() OVER (ORDER BY r_name) - 1 AS j FROM region),
x AS (SELECT *, {_H("'42'", "'signal'", "prospect", "dimension", "difficulty")} % (SELECT count(*) FROM nation) AS i, {_H("'42'", "'snapshot'", "prospect", "dimension", "difficulty")} % (SELECT count(*) FROM region) AS j FROM r)
SELECT prospect, dimension, difficulty, (['trace_derived', 'programmatic', 'multi_llm_synthesis', 'hand_authored'])[{_H("'42'", "dimension", "difficulty")} % 4 + 1] AS source_mode, CASE WHEN difficulty IN ('hard', 'adversarial') THEN 1 + {_H("'42'", "'turn'", "prospect", "dimension", "difficulty")} % 5 END AS turn,
CASE WHEN difficulty = 'adversarial' THEN 0.3 ELSE round(0.4 + {_H("'42'", "'sure'", "prospect", "dimension", "difficulty")} % 60 / 100, 2) END AS confidence, signal, snapshot FROM x LEFT JOIN s USING (i) LEFT JOIN p USING (j)""",
    "generated_tasks": f"""WITH r AS (SELECT g % 50 AS k, g // 50 + 1 AS d, g + 1 AS number FROM range(250) t(g)), n AS (SELECT *, (['signal_grounding', 'capacity_honesty', 'tone_preservation', 'consent_coordination', 'gap_framing'])[d] AS dimension, (['SG', 'CH', 'TP', 'CC', 'GF'])[d] AS code FROM r),
f AS (SELECT *, (['easy', 'medium', 'hard', 'adversarial'])[CASE WHEN k < 48 THEN k // 12 ELSE {_H("'42'", "dimension", "k")} % 4 END + 1] AS difficulty FROM n), s AS (SELECT *, {_H("'42'", "dimension", "difficulty")} % 4 + 1 AS m FROM f)
SELECT printf('TB-%s-%s-%04d', code, (['TR', 'PR', 'ML', 'HA'])[m], number) AS task_id, dimension, difficulty, (['trace_derived', 'programmatic', 'multi_llm_synthesis', 'hand_authored'])[m] AS source_mode, CASE WHEN difficulty = 'adversarial' THEN 0.3 ELSE round(0.4 + {_H("'42'", "'sure'", "number")} % 60 / 100, 2) END AS confidence, CASE WHEN difficulty IN ('hard', 'adversarial') THEN 1 + {_H("'42'", "'turn'", "number")} % 5 END AS turn FROM s""",
    "preference_pairs": f"{_PAIR} SELECT * FROM p",
    "pair_audit": f"{_PAIR} SELECT dimension, count(*) AS pairs, round(avg({_WORDS('chosen')}), 4) AS chosen_mean, round(stddev_samp({_WORDS('chosen')}), 4) AS chosen_sd, round(avg({_WORDS('rejected')}), 4) AS rejected_mean, round(stddev_samp({_WORDS('rejected')}), 4) AS rejected_sd FROM p GROUP BY 1",
    "training_rows": f"{_PAIR} SELECT pair_id, 'Rules.' || chr(10) || 'about ' || dimension AS prompt, 'Rules.' || chr(10) || 'about ' || dimension || chr(10) || chosen AS text, CASE WHEN {_H('pair_id')} % 5 = 0 THEN 'eval' ELSE 'train' END AS split FROM p",
    "prompt_render": """WITH a AS (SELECT c_custkey, c_custkey % 3 AS d, 'Company: ' || c_name || chr(10) || 'Role: ' || c_mktsegment || chr(10) || 'Confidence: ' || printf('%.2f', round(abs(c_acctbal) / 10000, 2)) || CASE WHEN round(abs(c_acctbal) / 10000, 2) < 0.5 THEN ' (low)' ELSE ' (high)' END || chr(10) || 'Free:' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '- go: ' || (c_custkey % 7) ELSE '- none' END || chr(10) || CASE c_custkey % 3 WHEN 0 THEN 'State only what is free.' WHEN 1 THEN 'Ask where you are not sure.' ELSE 'Write a short reply.' END AS prompt FROM customer)
SELECT c_custkey, prompt, CASE WHEN length(prompt) > 80 THEN left(prompt, 80) || '...' ELSE prompt END AS preview, CASE d WHEN 0 THEN 'capacity' ELSE 'plain' END AS answer, round(CASE WHEN c_custkey % 5 = 0 THEN 300 ELSE length(prompt) END * 0.4 / 1e6, 8) AS cost FROM a""",
    "run_matrix": "SELECT CAST(item_id AS VARCHAR) AS item_id, condition, CAST(trial AS INT) AS trial FROM benchmark, (VALUES ('base'), ('changed')) c(condition), range(1, 4) t(trial)",
    "ordered_lookup": "SELECT place, k.id, n_name, n_name IS NOT NULL AS found FROM (VALUES (0, 7), (1, 3), (2, -1), (3, 3)) k(place, id) LEFT JOIN nation ON n_nationkey = id",
    "regression_gate": "WITH r AS (SELECT event_type AS dimension, round(avg((value > 50)::int) FILTER (day(ts) <= 15), 6) AS base, round(avg((value > 50)::int) FILTER (day(ts) > 15), 6) AS changed, 0.4 AS target FROM events GROUP BY 1) SELECT *, round(changed - base, 6) AS delta, coalesce(round(changed - base, 6) < -0.02, false) AS regressed, coalesce(changed >= target, false) AS met FROM r",
    "quota_sample": "WITH l AS (SELECT doc_id, max(quality) AS score FROM labels GROUP BY 1), r AS (SELECT doc_id AS id, coalesce(lang, 'none') AS dimension, score, md5('42#' || doc_id) AS h FROM documents JOIN l USING (doc_id) WHERE score IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY h, id) > greatest(1, 30 // (SELECT count(DISTINCT dimension) FROM r)) AS late FROM r) SELECT id, dimension, score FROM k ORDER BY late, h, id LIMIT 30",
    "judged_pairs": "WITH r AS (SELECT user_id % 20 AS a, event_id % 20 + 20 AS b, CASE event_type WHEN 'error' THEN -1 WHEN 'signup' THEN 1 ELSE 0 END * (event_id % 3) AS d FROM events), s AS (SELECT a AS task, d FROM r UNION ALL SELECT b, -d FROM r) SELECT task, CAST(sum(d) AS BIGINT) AS score, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses FROM s GROUP BY 1",
    "accepted_attempts": "WITH r AS (SELECT conv_id AS task, turn AS attempt, coalesce(length(text), 0) > 100 AS passed FROM conversations) SELECT * FROM r QUALIFY coalesce(sum(passed::int) OVER (PARTITION BY task ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2",
}
