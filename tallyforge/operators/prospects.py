"""Rules that the survey has from specifications alone: labels, capacity, channels, stages and losses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Stages in order, signals with their actions, and words that name a stack.
STAGES = ("new", "outbound_sent", "email_opened", "replied", "qualified", "scheduled", "call_booked")
ACTIONS = {"email_opened": ("send_followup_email", "email_opened"), "email_replied": ("qualify_prospect", "replied"), "qualified": ("send_calcom_link", "qualified")}
STACKS = {
    "data": ("dbt", "snowflake", "databricks", "data engineer", "analytics"),
    "python": ("python", "django", "fastapi", "flask"),
    "go": ("golang", "go ", " go,", "microservices"),
    "infra": ("devops", "kubernetes", "terraform", "aws", "infrastructure"),
    "frontend": ("react", "next.js", "typescript", "frontend", "vue"),
}


def velocity_label(now: Column, before: Column) -> Column:
    """(label, confidence) of a count and an earlier one. From 0 to 2, which is stated nowhere, counts as doubled."""
    ratio = now / F.nullif(before, F.lit(0))
    label = (
        F.when(before.isNull() | now.isNull(), "insufficient_signal")
        .when(before == 0, F.when(now == 0, "flat").when(now == 1, "increased_modestly").when(now == 2, "doubled").otherwise("tripled_or_more"))
        .when(now == 0, "declined")
        .when(ratio >= 3, "tripled_or_more")
        .when(ratio >= 2, "doubled")
        .when(ratio >= 1.2, "increased_modestly")
        .when(ratio >= 0.8, "flat")
        .otherwise("declined")
    )
    sure = F.when(before.isNull() | now.isNull(), 0.3).when((before == 0) | (now == 0), 0.6).otherwise(0.8)
    return F.struct(label.alias("label"), sure.alias("confidence"))


def count_before(rows: DataFrame, entity: str, day: str, count: str, days: int) -> DataFrame:
    """``rows`` with before: the entity's latest count that is at least ``days`` days old, else null."""
    number = F.unix_date(F.col(day))
    w = Window.partitionBy(entity).orderBy("number").rangeBetween(Window.unboundedPreceding, -days)
    return rows.withColumn("number", number).withColumn("before", F.last(count).over(w)).drop("number")


def capacity(available: Column, wanted: Column) -> Column:
    """(free, gap, tier): sufficient, ramp (some are free, the rest later) or escalate."""
    free = F.coalesce(available, F.lit(0))
    tier = F.when(free >= wanted, "sufficient").when(free > 0, "ramp").otherwise("escalate")
    return F.struct((tier != "escalate").alias("free"), (free - wanted).alias("gap"), tier.alias("tier"))


def stacks(text: Column, maturity: Column, ai_roles: Column) -> Column:
    """Stacks that a text names, in a fixed order; ml for maturity of 2 or AI roles; python for none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    ml = F.when((F.coalesce(maturity, F.lit(0)) >= 2) | (F.coalesce(ai_roles, F.lit(0)) > 0), F.lit("ml"))
    named = [F.when(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words]), F.lit(stack)) for stack, words in STACKS.items()]
    found = F.array_compact(F.array(ml, *named))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("python")))


def constraint(roles: Column, open_roles: Column, bench: Column) -> Column:
    """(escalate, reason) of a need for ML, data and python people; a null bench always escalates.

    ``roles`` is a text, ``bench`` a struct of ml, data, python and python_capacity.
    """
    low, free = F.lower(F.coalesce(roles, F.lit(""))), lambda c: F.coalesce(bench[c], F.lit(0))
    issues = F.array_compact(
        F.array(
            F.when((F.contains(low, F.lit("ml")) | F.contains(low, F.lit("machine learning"))) & (free("ml") < 1), "ml not confirmed"),
            F.when(F.contains(low, F.lit("data")) & (free("data") < 1), "data not confirmed"),
            F.when((open_roles > 3) & (free("python") / F.greatest(F.coalesce(bench["python_capacity"], F.lit(1)), F.lit(1)) > 0.75), "python near its limit"),
        )
    )
    reason = F.when(bench.isNull(), "bench_summary_unavailable").when(F.size(issues) > 0, F.array_join(issues, "; ")).otherwise("capacity confirmed")
    return F.struct((bench.isNull() | (F.size(issues) > 0)).alias("escalate"), reason.alias("reason"))


def _rank(stage: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STAGES)), stage)


def channels(stage: Column) -> Column:
    """Channels at a stage: email unless disqualified, sms from opened mail on, calendar from qualified on, crm always."""
    rank = _rank(stage)
    return F.array_compact(F.array(F.when(rank > 0, F.lit("email")), F.when(rank >= 3, F.lit("sms")), F.when(rank >= 5, F.lit("calcom")), F.lit("crm")))


def valid_step(before: Column, after: Column) -> Column:
    """One stage forward, from sent to replied, or to disqualified from any other stage; nothing else."""
    a, b = _rank(before), _rank(after)
    forward = (a > 0) & (b == a + 1)
    return F.coalesce(forward | ((before == "outbound_sent") & (after == "replied")) | ((after == "disqualified") & (a > 0)), F.lit(False))


def next_action(signal: Column) -> Column:
    """(action, next_stage, channels) of a signal; nulls and no channel for others."""
    pick = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in ACTIONS.items() for x in (k, v[i])]), signal)
    return F.struct(pick(0).alias("action"), pick(1).alias("next_stage"), F.when(pick(1).isNotNull(), channels(pick(1))).alias("channels"))


def expected_loss(value: Column, rate: Column, proposal: float = 0.4, closing: float = 0.3, walks: float = 0.04) -> Column:
    """Loss per 100 leads: what a lead is worth, the chance that it walks, and how often the fault occurs."""
    return 100 * rate * value * proposal * closing * walks


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.groupBy((F.col("user_id") % 10).cast("int").alias("probe"), F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("n"))


def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = count_before(_daily(spark, sf_dir), "probe", "day", "n", 7)
    return rows.select("probe", "day", "n", "before", velocity_label(F.col("n"), F.col("before")).alias("x")).select("probe", "day", "n", "before", "x.label", "x.confidence")


def stage_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as stages by number; how many steps of each kind there are, and whether they are valid."""
    stage = F.get(F.array(*map(F.lit, (*STAGES, "disqualified"))), (F.col("event_id") % 8).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", stage.alias("after"))
    rows = rows.withColumn("before", F.lag("after").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("before is not null")
    steps = rows.groupBy("before", "after").agg(F.count("*").alias("n"))
    return steps.select("before", "after", "n", valid_step(F.col("before"), F.col("after")).alias("valid"), F.array_join(channels(F.col("after")), ",").alias("channels"))


def supply_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stacks: sizes as what is free, the digits of the key as what is wanted; and what their names need."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    free, wanted = (F.col("p_size") % 5).cast("int"), (F.col("p_partkey") % 7).cast("int")
    bench = F.when(F.col("p_partkey") % 3 != 0, F.struct(free.alias("ml"), wanted.alias("data"), free.alias("python"), F.lit(4).alias("python_capacity")))
    rows = p.select("p_partkey", capacity(free, wanted).alias("c"), constraint(F.concat_ws(" ", "p_brand", F.when(F.col("p_partkey") % 2 == 0, F.lit("ML and data"))), wanted, bench).alias("e"), stacks(F.concat_ws(" ", "p_brand", F.when(F.col("p_partkey") % 5 == 0, F.lit("Terraform, React"))), free, F.lit(0)).alias("s"))
    return rows.select("p_partkey", "c.gap", "c.tier", "e.escalate", "e.reason", F.array_join("s", ",").alias("stacks"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = F.when(F.col("event_type") == "error", "email_opened").when(F.col("event_type") == "signup", "qualified").when(F.col("event_type") == "purchase", "email_replied").otherwise("other")
    x = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", next_action(signal).alias("x"))
    return x.select("event_id", "x.action", "x.next_stage", F.array_join("x.channels", ",").alias("channels"))


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.round(F.avg((F.col("value") > 50).cast("double")), 4).alias("rate"))
    return rows.select("event_type", "rate", F.round(expected_loss(F.lit(360000), F.col("rate")), 2).alias("loss"))


_ST = "['new', 'outbound_sent', 'email_opened', 'replied', 'qualified', 'scheduled', 'call_booked']"
_CH = lambda r: f"CASE WHEN {r} = 0 THEN 'crm' WHEN {r} < 3 THEN 'email,crm' WHEN {r} < 5 THEN 'email,sms,crm' ELSE 'email,sms,calcom,crm' END"
QUERIES = {"velocity_label": velocity, "stage_steps": stage_steps, "supply_check": supply_check, "next_actions": actions, "expected_loss": losses}
ORACLES = {
    "velocity_label": """WITH d AS (SELECT CAST(user_id % 10 AS INT) AS probe, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1, 2), b AS (SELECT a.probe, a.day, a.n, e.n AS before FROM d a ASOF LEFT JOIN d e ON a.probe = e.probe AND a.day - 7 >= e.day)
SELECT *, CASE WHEN before IS NULL THEN 'insufficient_signal' WHEN before = 0 AND n < 3 THEN (['flat', 'increased_modestly', 'doubled'])[n + 1] WHEN before = 0 THEN 'tripled_or_more' WHEN n = 0 THEN 'declined' WHEN n >= 3 * before THEN 'tripled_or_more' WHEN n >= 2 * before THEN 'doubled' WHEN n / before >= 1.2 THEN 'increased_modestly' WHEN n / before >= 0.8 THEN 'flat' ELSE 'declined' END AS label,
CASE WHEN before IS NULL THEN 0.3 WHEN before = 0 OR n = 0 THEN 0.6 ELSE 0.8 END AS confidence FROM b""",
    "stage_steps": f"""WITH r AS (SELECT user_id, event_id % 8 + 1 AS b, lag(event_id % 8 + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events), s AS (SELECT a, b, count(*) AS n FROM r WHERE a IS NOT NULL GROUP BY ALL)
SELECT coalesce(({_ST})[a], 'disqualified') AS before, coalesce(({_ST})[b], 'disqualified') AS after, n, a < 8 AND (b = 8 OR b = a + 1 OR (a = 2 AND b = 4)) AS valid, {_CH("(CASE WHEN b = 8 THEN 0 ELSE b END)")} AS channels FROM s""",
    "supply_check": """WITH p AS (SELECT p_partkey, lower(p_brand) AS b, CAST(p_size % 5 AS INT) AS f, CAST(p_partkey % 7 AS INT) AS w, p_partkey % 3 = 0 AS no, p_partkey % 2 = 0 AS need, p_partkey % 5 = 0 AS more FROM part),
i AS (SELECT *, concat_ws('; ', CASE WHEN need AND f < 1 THEN 'ml not confirmed' END, CASE WHEN need AND w < 1 THEN 'data not confirmed' END, CASE WHEN w > 3 AND f / 4 > 0.75 THEN 'python near its limit' END) AS issues, concat_ws(',', CASE WHEN f >= 2 THEN 'ml' END, CASE WHEN more THEN 'infra' END, CASE WHEN more THEN 'frontend' END) AS s FROM p)
SELECT p_partkey, f - w AS gap, CASE WHEN f >= w THEN 'sufficient' WHEN f > 0 THEN 'ramp' ELSE 'escalate' END AS tier, no OR issues <> '' AS escalate, CASE WHEN no THEN 'bench_summary_unavailable' WHEN issues <> '' THEN issues ELSE 'capacity confirmed' END AS reason, CASE WHEN s = '' THEN 'python' ELSE s END AS stacks FROM i""",
    "next_actions": "SELECT event_id, CASE event_type WHEN 'error' THEN 'send_followup_email' WHEN 'signup' THEN 'send_calcom_link' WHEN 'purchase' THEN 'qualify_prospect' END AS action, CASE event_type WHEN 'error' THEN 'email_opened' WHEN 'signup' THEN 'qualified' WHEN 'purchase' THEN 'replied' END AS next_stage, CASE event_type WHEN 'error' THEN 'email,sms,crm' WHEN 'signup' THEN 'email,sms,calcom,crm' WHEN 'purchase' THEN 'email,sms,crm' END AS channels FROM events",
    "expected_loss": "WITH r AS (SELECT event_type, round(avg((value > 50)::int), 4) AS rate FROM events GROUP BY 1) SELECT *, round(100 * rate * 360000 * 0.4 * 0.3 * 0.04, 2) AS loss FROM r",
}
