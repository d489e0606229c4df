"""Scores of tasks by dimension, with error rows, as queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.functions import scoring as s
from tallyforge.functions.rules import Rules, merged, rules_of
from tallyforge.operators.evaluation import _CONSENT, _GAP, RULES, _sql, _sql_any, consent_score, consent_trouble, gap_score, gap_trouble

#: (dimension, text, first expected behaviour, open role, stack, count): the tables' invented words
#: reach few branches of the scores.
FIXTURES = [
    ("signal_grounding", "It appears to be early. Are you open to a call?", "Asks about hiring when unsure", "Backend", "python", 2),
    ("signal_grounding", "We know their AI plans.", "Hedges", None, None, None),
    ("signal_grounding", "Your team likely grew; curious whether hiring slowed", "Mention hiring velocity", None, None, None),
    ("capacity_honesty", "We can place 5 engineers tomorrow.", "Escalates", "MLOps Engineer", "go", 3),
    ("capacity_honesty", "We will staff 3 data people; let me confirm python capacity.", "Checks", "Python Developer", "python", 4),
    ("capacity_honesty", "I will verify and escalate to the lead.", None, "Software Engineer", "", 0),
    ("tone_preservation", "However, pending a check, this is fine.", None, None, None, None),
    ("tone_preservation", "We just literally have the BESTEST best people.", None, None, None, None),
    ("tone_preservation", "Our world-class bench", None, None, None, None),
    ("tone_preservation", "As I said, no.", None, None, None, None),
    ("consent_coordination", "Would you be flexible?", None, None, None, None),
    ("gap_framing", "Have you considered it?", None, None, None, None),
    ("no_such_dimension", "words", None, None, None, None),
    (None, "words", None, None, None, None),
    ("tone_preservation", "  ", None, None, None, None),
]
_TYPES = "dimension string, text string, behaviour string, role string, stack string, count bigint"


@dataclass(frozen=True)
class Dimension:
    """The highest score of a dimension, and how score and trouble follow from the columns of a task and the rules."""

    highest: int
    score: Callable[[Rules], Column]
    trouble: Callable[[Rules], Column]


_CAPACITY_OF = ("text", "role", "behaviours", "roles")

#: The dimensions that tasks may name. A caller passes its own dictionary to add or replace some.
DIMENSIONS: dict[str, Dimension] = {
    "signal_grounding": Dimension(3, lambda r: s.signal_score(F.col("text"), F.col("behaviours"), r), lambda r: s.signal_trouble(F.col("text"), r)),
    "capacity_honesty": Dimension(3, lambda r: s.capacity_score(*map(F.col, _CAPACITY_OF), r), lambda r: s.capacity_trouble(*map(F.col, _CAPACITY_OF), r)),
    "tone_preservation": Dimension(5, lambda r: s.tone_score(F.col("text"), rules=r), lambda r: s.tone_trouble(F.col("text"), r)),
    "consent_coordination": Dimension(3, lambda r: consent_score(F.col("text"), r), lambda r: consent_trouble(F.col("text"), r)),
    "gap_framing": Dimension(3, lambda r: gap_score(F.col("text"), r), lambda r: gap_trouble(F.col("text"), r)),
}
DEFAULT_RULES = merged(s.RULES, RULES)


def score_tasks(tasks: DataFrame, settings: DataFrame | Rules | None = None, threshold: float | Column = 0.7, dimensions: dict[str, Dimension] | None = None) -> DataFrame:
    """``tasks`` with error, score, norm and passed.

    Columns read: dimension, text, behaviours (array), role, roles (array of stack and count). Tasks
    with an error have no score and don't pass. ``settings`` is a table (section, place, entry), as
    ``read_settings`` gives it, or compiled rules; sections that it doesn't name are empty then.
    Without it the built-in values hold. A task whose score meets a pattern that can't be compiled
    has the error ``bad_pattern: section: pattern``. ``threshold`` may be a column; null means 0.7.
    """
    known = dimensions or DIMENSIONS
    rules = DEFAULT_RULES if settings is None else settings if isinstance(settings, Rules) else rules_of(settings)
    text, kind = F.col("text"), F.col("dimension")
    pick = lambda get, type_="int": reduce(lambda out, kv: F.when(kind == kv[0], get(kv[1])).otherwise(out), known.items(), F.lit(None).cast(type_))
    rows = tasks.withColumn("error", F.coalesce(s.task_error(kind, text, tuple(known)), pick(lambda d: d.trouble(rules), "string")))
    rows = rows.withColumn("score", F.when(F.col("error").isNull(), pick(lambda d: d.score(rules))))
    rows = rows.withColumn("norm", F.round(F.col("score") / pick(lambda d: F.lit(d.highest)), 4))
    limit = F.round(F.coalesce(threshold if isinstance(threshold, Column) else F.lit(float(threshold)), F.lit(0.7)), 2)
    return rows.withColumn("passed", F.coalesce(F.round("norm", 2) >= limit, F.lit(False)))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns, dealt to the five dimensions by conversation, and the fixtures with negative ids."""
    names = F.array(*map(F.lit, s.HIGHEST))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    turns = turns.select("conv_id", "turn", F.get(names, F.pmod(F.col("conv_id"), F.lit(5)).cast("int")).alias("dimension"), "text", *[F.lit(None).cast(t).alias(n) for n, t in (("behaviour", "string"), ("role", "string"), ("stack", "string"), ("count", "bigint"))])
    extra = spark.createDataFrame([(-1 - i, 0, *row) for i, row in enumerate(FIXTURES)], "conv_id bigint, turn bigint, " + _TYPES)
    both = turns.unionByName(extra)
    roles = F.when(F.col("stack").isNotNull(), F.array(F.struct("stack", "count")))
    behaviours = F.when(F.col("behaviour").isNotNull(), F.array("behaviour"))
    return both.select("conv_id", "turn", "dimension", "text", "role", behaviours.alias("behaviours"), roles.alias("roles"))


def score_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_tasks(tasks(spark, sf_dir)).select("conv_id", "turn", "dimension", "error", "score", "norm", "passed")


def dispatch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dimension: tasks, errors, passes, and the share of passes among tasks without an error."""
    fine = F.count_if(F.col("error").isNull())
    passed = F.count_if("passed")
    return score_tasks(tasks(spark, sf_dir)).groupBy("dimension").agg(F.count("*").alias("tasks"), F.count_if(F.col("error").isNotNull()).alias("errors"), passed.alias("passes"), F.round(F.try_divide(passed, fine), 4).alias("pass_at_1"))


def _value(x) -> str:
    return "NULL" if x is None else _sql(x) if isinstance(x, str) else str(x)


_NAMES = "[" + ", ".join(map(_sql, s.HIGHEST)) + "]"
_ROWS = f"""WITH c AS (SELECT conv_id, turn, ({_NAMES})[conv_id % 5 + 1] AS dimension, text, NULL AS behaviour, NULL AS role, NULL AS stack, NULL AS count FROM conversations WHERE role = 'assistant'
UNION ALL SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(_value, (-1 - i, 0, *row))) + ")" for i, row in enumerate(FIXTURES))}) f(conv_id, turn, dimension, text, behaviour, role, stack, count)),
h AS (SELECT *, lower(coalesce(role, '') || ' ' || coalesce(behaviour, '')) AS hint, coalesce(lower(stack), '') AS name,
list_slice(list_filter(list_transform(regexp_extract_all(coalesce(behaviour, ''), '\\w{{4,}}'), lambda w: lower(w)), lambda w: w NOT IN ('with', 'when', 'that', 'from', 'this')), 1, 3) AS keys FROM c),
k AS (SELECT *, name <> '' AND (contains(hint, name) OR NOT ({" OR ".join(f"contains(hint, {_sql(w)})" for w in s.SPECIALIST)})) AS fits FROM h)"""
_SIGNAL = f"CASE WHEN {_sql_any(s.CERTAIN)} THEN 0 ELSE {_sql_any(s.HEDGES)}::int + {_sql_any(s.INTERROGATIVE)}::int + (len(list_filter(keys, lambda w: contains(lower(text), w))) > 0)::int END"
_CAPACITY = f"CASE WHEN {_sql_any([s.HARD_COMMIT])} AND (coalesce(count, 0) = 0 OR NOT fits) THEN 0 ELSE 2 * {_sql_any(s.ESCALATION)}::int + (fits AND contains(lower(text), name))::int END"
_TONE = f"CASE WHEN {' OR '.join(f'contains(lower(text), {_sql(p.lower())})' for p in s.BANNED)} OR {_sql_any([s.BANNED_WORD, *s.CONDESCENDING])} THEN 0 ELSE (len(regexp_extract_all(text, {_sql('(?i)' + s.FILLERS)})) / greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')), 1) < 0.03)::int + (NOT {_sql_any([s.SUPERLATIVES])})::int + {_sql_any(s.HONEST)}::int + (NOT regexp_matches(text, {_sql(s.SHOUTING)}))::int + 1 END"
_SCORES = f"""{_ROWS}, e AS (SELECT *, CASE WHEN dimension IS NULL THEN 'missing_dimension' WHEN dimension NOT IN (SELECT unnest({_NAMES})) THEN 'unknown_dimension: ' || dimension WHEN NOT coalesce(regexp_matches(text, '\\S'), false) THEN 'empty_candidate' END AS error FROM k),
t AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN dimension = 'signal_grounding' THEN {_SIGNAL} WHEN dimension = 'capacity_honesty' THEN {_CAPACITY} WHEN dimension = 'tone_preservation' THEN {_TONE} WHEN dimension = 'consent_coordination' THEN {_CONSENT} ELSE {_GAP} END AS score FROM e),
r AS (SELECT conv_id, turn, dimension, error, score, round(score / CASE WHEN dimension = 'tone_preservation' THEN 5 ELSE 3 END, 4) AS norm FROM t),
v AS (SELECT *, coalesce(round(norm, 2) >= 0.7, false) AS passed FROM r)"""

QUERIES = {"score_dispatch": score_dispatch, "dispatch_report": dispatch_report}
ORACLES = {
    "score_dispatch": f"{_SCORES} SELECT * FROM v",
    "dispatch_report": f"{_SCORES} SELECT dimension, count(*) AS tasks, count(error) AS errors, count(*) FILTER (passed) AS passes, round(count(*) FILTER (passed) / nullif(count(*) - count(error), 0), 4) AS pass_at_1 FROM v GROUP BY dimension",
}
for _kind in s.HIGHEST:
    _name = {"signal_grounding": "score_signal", "capacity_honesty": "score_capacity", "tone_preservation": "score_tone"}.get(_kind)
    if _name:
        QUERIES[_name] = lambda spark, sf_dir, kind=_kind: score_dispatch(spark, sf_dir).where(F.col("dimension") == kind).drop("dimension")
        ORACLES[_name] = f"{_SCORES} SELECT * EXCLUDE (dimension) FROM v WHERE dimension = {_sql(_kind)}"
