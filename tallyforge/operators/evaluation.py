"""Text scores, judge results, tournaments and run comparisons, each a query and its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyforge.functions.rules import Rules, searched
from tallyforge.operators import cosine_index
from tallyforge.operators.contamination import WORDS, _CONTAIN, containment, tokens

# Patterns that decide the scores, searched without regard to case.
CONSENT = [r"\bwould you\b", r"\bare you open\b", r"\bdoes.{0,20}work for you\b", r"\bhappy to schedule\b", r"\blet me know if\b"]
BOOKED = r"\b(I.ve booked|I scheduled|I sent.*invite|you.re booked|calendar invite sent)\b"
OTHER_TIMES = r"\balternative(s)?\b|\bother time\b|\bflexible\b"
ACCUSING = [
    r"\byou.re (falling|behind|losing)\b",
    r"\byour (competitor|rival).{0,30}(ahead|winning|beating you)\b",
    r"\byou (lack|don.t have|are missing)\b",
    r"\byour team (can.t|doesn.t|won.t)\b",
]
ASKING = [
    r"\bhave you considered\b",
    r"\bour research (suggests?|shows?|indicates?)\b",
    r"\bwe noticed\b",
    r"\bwhat.s your (current|existing|approach)\b",
    r"\b(opportunity|gap) we (identified|see|noticed)\b",
]
NET_ACCUSING = r"(our research suggests?|we noticed|have you considered|we identified)(?:\W+\w+){0,15}(you.re (missing|behind|falling|losing)|you (lack|don.t have|are missing))"
HOSTILE = r"\b(attack|expose|destroy|crush|dominate)\b"

#: Texts that reach every branch of the scores; the tables' invented words reach few.
FIXTURES = [
    "I scheduled a call for us on Monday.",
    "Would you like a call? We are flexible.",
    "you're booked, and let me know if an alternative suits",
    "Are you open to it at some other time?",
    "You are missing the point.",
    "We noticed that you're behind on hiring.",
    "Have you considered a smaller team? The gap we identified is small.",
    "We can crush it. What's your current plan?",
    "   ",
    "",
]


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, [text.rlike(searched(p)) for p in patterns])


#: The sections that settings name, with the values above.
RULES = Rules({"consent_patterns": tuple(CONSENT), "accusatory_patterns": tuple(ACCUSING), "question_framing_patterns": tuple(ASKING)})


def consent_score(text: Column, rules: Rules = RULES) -> Column:
    """0 to 3; null for blank texts, which have no score."""
    asks = rules.any_of(text, "consent_patterns")
    points = F.when(asks, 2).otherwise(0) + F.when(_any(text, [OTHER_TIMES]), 1).otherwise(0)
    return F.when(text.rlike(searched(r"\S")), F.when(_any(text, [BOOKED]) & ~asks, 0).otherwise(points))


def consent_trouble(text: Column, rules: Rules = RULES) -> Column:
    return rules.trouble(text, "consent_patterns")


def gap_score(text: Column, rules: Rules = RULES) -> Column:
    """0 to 3; null for blank texts, which have no score."""
    points = F.when(rules.any_of(text, "question_framing_patterns"), 2).otherwise(0) + F.when(_any(text, [HOSTILE]), 0).otherwise(1)
    return F.when(text.rlike(searched(r"\S")), F.when(rules.any_of(text, "accusatory_patterns") | _any(text, [NET_ACCUSING]), 0).otherwise(points))


def gap_trouble(text: Column, rules: Rules = RULES) -> Column:
    """The broken pattern that a gap score meets; questions are only looked for where nothing accuses."""
    blamed = rules.any_of(text, "accusatory_patterns") | _any(text, [NET_ACCUSING])
    return F.coalesce(rules.trouble(text, "accusatory_patterns"), F.when(~blamed, rules.trouble(text, "question_framing_patterns")))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns and, with negative ids, the fixtures."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'").select("conv_id", "turn", "text")
    extra = spark.createDataFrame([(-1 - i, 0, t) for i, t in enumerate(FIXTURES)], "conv_id long, turn long, text string")
    return turns.unionByName(extra)


def _scored(score):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        norm = F.round(F.col("score") / 3, 4)
        rows = candidates(spark, sf_dir).select("conv_id", "turn", score(F.col("text")).alias("score"))
        return rows.select("conv_id", "turn", "score", norm.alias("norm"), (F.round(norm, 2) >= 0.7).alias("passed"))

    return query


def batch_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(gap_score)(spark, sf_dir)
    n, passed = F.count("score"), F.count_if("passed")
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("score").isNull()).alias("skipped"), passed.alias("passed"), F.round(F.try_divide(passed, n), 4).alias("pass_at_1"))


def first_match_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pattern of the question framings that a text has, cut to 50 characters."""
    text = F.col("text")
    note = F.coalesce(*[F.when(text.rlike(searched(p)), F.lit(p[:50])) for p in ASKING])
    return candidates(spark, sf_dir).select("conv_id", "turn", note.alias("note"))


def judge_score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first integer from 0 to 50 in a judge's answer; null where there is none."""
    found = F.transform(F.regexp_extract_all("props", F.lit(searched(r"\b(\d+)\b")), 1), lambda x: x.try_cast("bigint"))
    score = F.get(F.filter(found, lambda x: x.between(0, 50)), 0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", score.alias("score"))


def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number read from JSON inside a code fence, which is taken off first."""
    fence = "`" * 3
    raw = F.concat(F.lit(f"{fence}json\n"), "props", F.lit(f"\n{fence}"))
    bare = F.regexp_replace(F.regexp_replace(raw, rf"^{fence}(json)?\s*", ""), rf"\s*{fence}$", "")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object(bare, "$.k").try_cast("bigint").alias("k"))


def tournament_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of a language are paired; the longer text wins its lead in thousands of characters.

    Each pair adds to one row and takes from the other, so scores are one sum; the best 20 of a
    language are kept.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), "n_chars")
    order = Window.partitionBy("lang").orderBy("doc_id")
    pairs = docs.select("lang", F.col("doc_id").alias("a"), F.lead("doc_id").over(order).alias("b"), ((F.col("n_chars") - F.lead("n_chars").over(order)) / 1000).cast("int").alias("lead")).where("b is not null")
    signed = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("lead").alias("d")), F.struct(F.col("b").alias("doc_id"), (-F.col("lead")).alias("d")))).alias("x")).select("lang", "x.*")
    scores = signed.groupBy("lang", "doc_id").agg(F.sum("d").alias("score"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank).where("rank <= 20")


def cosines(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id and doc_id as strings and the cosine of the TF-IDF weights of every pair that shares a token."""
    left = items.select(F.col("item_id").cast("string").alias("id"), F.lit(True).alias("item"), tokens(F.col("text")).alias("w"))
    right = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit(False).alias("item"), tokens(F.col("text")).alias("w"))
    both = left.unionByName(right).where(F.size("w") > 0)
    counts = both.select("id", "item", F.explode("w").alias("token")).groupBy("id", "item", "token").agg(F.count("*").alias("n"))
    idf = counts.groupBy("token").agg(F.count("*").alias("df"))
    total = both.agg(F.count("*").alias("total"))
    weight = F.col("n") * (F.ln((F.col("total") + 1) / (F.col("df") + 1)) + 1)
    weights = counts.join(idf, "token").join(F.broadcast(total)).select("id", "item", "token", weight.alias("x"))
    norms = weights.groupBy("id", "item").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    a = weights.where("item").select(F.col("id").alias("item_id"), "token", F.col("x").alias("xa"))
    b = weights.where("not item").select(F.col("id").alias("doc_id"), "token", F.col("x").alias("xb"))
    dots = a.join(b, "token").groupBy("item_id", "doc_id").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    dots = dots.join(norms.where("item").select(F.col("id").alias("item_id"), F.col("norm").alias("na")), "item_id")
    dots = dots.join(norms.where("not item").select(F.col("id").alias("doc_id"), F.col("norm").alias("nb")), "doc_id")
    return dots.select("item_id", "doc_id", (F.col("dot") / F.col("na") / F.col("nb")).alias("cosine"))


def tfidf_cosine_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of each item by cosine of TF-IDF weights, the smallest id in a tie, else -1."""
    items, docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    best = cosine_index.top1(items, docs).select("item_id", F.round("cosine", 4).alias("cosine"), F.col("doc_id").cast("long").alias("doc_id"))
    out = items.select("item_id").join(best, "item_id", "left")
    cosine = F.coalesce("cosine", F.lit(0.0))
    return out.select(F.col("item_id").cast("string").alias("item_id"), cosine.alias("max_cosine"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), (cosine >= 0.85).alias("contaminated"))


def verdicts(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Each item's highest 8-gram share and cosine, a flag for each, and whether either is set.

    Values are rounded after they are compared.
    """
    grams = containment(items, docs).groupBy("item_id").agg(F.max("share").alias("share"))
    close = cosine_index.top1(items, docs).select("item_id", "cosine")
    rows = items.select("item_id").join(grams, "item_id", "left").join(close, "item_id", "left").na.fill(0.0, ["share", "cosine"])
    exact, near = F.col("share") >= 1.0, F.col("cosine") >= 0.85
    return rows.select(F.col("item_id").cast("string").alias("item_id"), F.round("share", 4).alias("max_ngram"), F.round("cosine", 4).alias("max_cosine"), exact.alias("ngram_flag"), near.alias("cosine_flag"), (exact | near).alias("contaminated"))


def contamination_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def contamination_verdict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.count_if("contaminated")
    return contamination_verdicts(spark, sf_dir).agg(F.count("*").alias("items"), F.count_if("ngram_flag").alias("ngram_violations"), F.count_if("cosine_flag").alias("cosine_violations"), bad.alias("violations"), F.round(bad / F.greatest(F.count("*"), F.lit(1)), 4).alias("contamination_rate"), (bad == 0).alias("clean"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_any(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(text, {_sql('(?i)' + p)})" for p in patterns) + ")"


_ROWS = "WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, 0, {_sql(t)})" for i, t in enumerate(FIXTURES)) + ") f(conv_id, turn, text))"
_BLANK = r"regexp_matches(text, '\S')"
_CONSENT = f"CASE WHEN {_BLANK} THEN CASE WHEN {_sql_any([BOOKED])} AND NOT {_sql_any(CONSENT)} THEN 0 ELSE 2 * {_sql_any(CONSENT)}::int + {_sql_any([OTHER_TIMES])}::int END END"
_GAP = f"CASE WHEN {_BLANK} THEN CASE WHEN {_sql_any([*ACCUSING, NET_ACCUSING])} THEN 0 ELSE 2 * {_sql_any(ASKING)}::int + 1 - {_sql_any([HOSTILE])}::int END END"
_SCORED = "{rows}, s AS (SELECT conv_id, turn, {score} AS score FROM c), r AS (SELECT *, round(score / 3, 4) AS norm, round(round(score / 3, 4), 2) >= 0.7 AS passed FROM s)"
_NOTE = " ".join(f"WHEN regexp_matches(text, {_sql('(?i)' + p)}) THEN {_sql(p[:50])}" for p in ASKING)

ORACLES = {
    "score_consent": _SCORED.format(rows=_ROWS, score=_CONSENT) + " SELECT * FROM r",
    "score_gap": _SCORED.format(rows=_ROWS, score=_GAP) + " SELECT * FROM r",
    "batch_pass_rate": _SCORED.format(rows=_ROWS, score=_GAP) + " SELECT count(*) AS total, count(*) FILTER (score IS NULL) AS skipped, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / nullif(count(score), 0), 4) AS pass_at_1 FROM r",
    "first_match_note": f"{_ROWS} SELECT conv_id, turn, CASE {_NOTE} END AS note FROM c",
    "judge_score_parse": r"SELECT event_id, list_filter(list_transform(regexp_extract_all(props, '\b(\d+)\b', 1), lambda x: try_cast(x AS BIGINT)), lambda x: x BETWEEN 0 AND 50)[1] AS score FROM events",
    "fenced_json": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "tournament_top": """WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, n_chars FROM documents),
p AS (SELECT lang, doc_id AS a, lead(doc_id) OVER w AS b, CAST(trunc((n_chars - lead(n_chars) OVER w) / 1000) AS BIGINT) AS d FROM d WINDOW w AS (PARTITION BY lang ORDER BY doc_id)),
s AS (SELECT lang, a AS doc_id, d FROM p WHERE b IS NOT NULL UNION ALL SELECT lang, b, -d FROM p WHERE b IS NOT NULL),
t AS (SELECT lang, doc_id, CAST(sum(d) AS BIGINT) AS score, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties FROM s GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS INT) AS rank FROM t QUALIFY rank <= 20""",
    "tfidf_cosine_top1": f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS id, true AS item, {WORDS} AS w FROM benchmark UNION ALL SELECT CAST(doc_id AS VARCHAR), false, {WORDS} FROM documents),
c AS (SELECT id, item, token, count(*) AS n FROM (SELECT id, item, unnest(w) AS token FROM b) GROUP BY ALL),
i AS (SELECT token, count(*) AS df FROM c GROUP BY 1), t AS (SELECT count(*) AS total FROM b WHERE len(w) > 0),
x AS MATERIALIZED (SELECT id, item, token, n * (ln((total + 1) / (df + 1)) + 1) AS x FROM c JOIN i USING (token), t),
m AS (SELECT id, item, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
d AS (SELECT a.id AS item_id, b.id AS doc_id, sum(a.x * b.x) AS dot FROM x a JOIN x b USING (token) WHERE a.item AND NOT b.item GROUP BY ALL),
r AS (SELECT item_id, CAST(doc_id AS BIGINT) AS doc_id, round(dot / m.norm / n.norm, 4) AS cosine FROM d JOIN m ON m.id = item_id AND m.item JOIN m n ON n.id = doc_id AND NOT n.item),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) = 1)
SELECT CAST(k.item_id AS VARCHAR) AS item_id, coalesce(cosine, 0) AS max_cosine, coalesce(doc_id, -1) AS doc_id, coalesce(cosine, 0) >= 0.85 AS contaminated FROM benchmark k LEFT JOIN o ON o.item_id = CAST(k.item_id AS VARCHAR)""",
}
QUERIES = {
    "score_consent": _scored(consent_score),
    "score_gap": _scored(gap_score),
    "batch_pass_rate": batch_pass_rate,
    "first_match_note": first_match_note,
    "judge_score_parse": judge_score_parse,
    "fenced_json": fenced_json,
    "tournament_top": tournament_top,
    "tfidf_cosine_top1": tfidf_cosine_top1,
}

_VERDICTS = f"""{_CONTAIN}, b AS (SELECT CAST(item_id AS VARCHAR) AS id, true AS item, {WORDS} AS w FROM benchmark UNION ALL SELECT CAST(doc_id AS VARCHAR), false, {WORDS} FROM documents),
c AS (SELECT id, item, token, count(*) AS n FROM (SELECT id, item, unnest(w) AS token FROM b) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM c GROUP BY 1), t AS (SELECT count(*) AS total FROM b WHERE len(w) > 0),
x AS MATERIALIZED (SELECT id, item, token, n * (ln((total + 1) / (df + 1)) + 1) AS x FROM c JOIN f USING (token), t),
l AS (SELECT id, item, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
p AS (SELECT a.id AS item_id, b.id AS doc_id, sum(a.x * b.x) AS dot FROM x a JOIN x b USING (token) WHERE a.item AND NOT b.item GROUP BY ALL),
o AS (SELECT item_id, max(dot / l.norm / k.norm) AS cosine FROM p JOIN l ON l.id = item_id AND l.item JOIN l k ON k.id = doc_id AND NOT k.item GROUP BY 1),
v AS (SELECT CAST(r.item_id AS VARCHAR) AS item_id, r.max_ngram, round(coalesce(cosine, 0), 4) AS max_cosine, r.contaminated AS ngram_flag, coalesce(cosine, 0) >= 0.85 AS cosine_flag, r.contaminated OR coalesce(cosine, 0) >= 0.85 AS contaminated FROM r LEFT JOIN o ON o.item_id = CAST(r.item_id AS VARCHAR))"""
ORACLES |= {
    "contamination_verdicts": f"{_VERDICTS} SELECT * FROM v",
    "contamination_verdict_report": f"{_VERDICTS} SELECT count(*) AS items, count(*) FILTER (ngram_flag) AS ngram_violations, count(*) FILTER (cosine_flag) AS cosine_violations, count(*) FILTER (contaminated) AS violations, round(count(*) FILTER (contaminated) / greatest(count(*), 1), 4) AS contamination_rate, count(*) FILTER (contaminated) = 0 AS clean FROM v",
}
QUERIES |= {"contamination_verdicts": contamination_verdicts, "contamination_verdict_report": contamination_verdict_report}

ORACLES |= {
    "pass_at_1_rollup": """WITH r AS (SELECT conv_id % 5 AS dimension, turn AS trial, CASE WHEN length(text) > 200 THEN 1.0e0 ELSE 0.0e0 END AS ok FROM conversations)
SELECT dimension, trial, count(*) AS n, round(avg(ok), 4) AS rate FROM r GROUP BY GROUPING SETS ((dimension), (trial), ())""",
    "pointwise_filter": "SELECT count(*) AS total, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS passed, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS failed, sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS errors, round(sum(CASE WHEN quality = 1 THEN 1.0e0 ELSE 0.0e0 END) / count(*), 4) AS pass_rate FROM labels",
    "preference_loss": "SELECT l_linestatus, round(avg(ln(1 + exp(-(2.0e0 * (l_discount - l_tax) - 0.5e0)))), 6) AS loss FROM lineitem GROUP BY l_linestatus",
    "synthetic_score": "SELECT event_id, round(least(1.0e0, greatest(0.0e0, CASE event_type WHEN 'error' THEN 0.4e0 WHEN 'purchase' THEN 0.8e0 ELSE 0.6e0 END + ((7 * event_id + 3) % 11 - 5) * 0.01e0)), 3) AS score FROM events",
    "paired_t": """WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'error' THEN 1.0e0 ELSE 0.0e0 END) / count(*) - sum(CASE WHEN event_type = 'signup' THEN 1.0e0 ELSE 0.0e0 END) / count(*) AS d FROM events GROUP BY CAST(ts AS DATE)),
s AS (SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM d) SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean / (sd / sqrt(n)), 4) AS t FROM s WHERE sd > 0""",
    "one_sample_z": """WITH r AS (SELECT event_type, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0e0 ELSE 0.0e0 END) AS p FROM events GROUP BY event_type),
s AS (SELECT *, (0.55e0 - 0.45e0) / 3.92e0 AS ref, sqrt(p * (1 - p) / n) AS own FROM r)
SELECT event_type, n, round(p - 0.5e0, 4) AS delta, round((p - 0.5e0) / sqrt(ref * ref + own * own), 4) AS z, round(p - 0.5e0 - 1.96e0 * sqrt(ref * ref + own * own), 4) AS lo, round(p - 0.5e0 + 1.96e0 * sqrt(ref * ref + own * own), 4) AS hi FROM s""",
    "condition_deltas": """WITH r AS (SELECT CAST(ts AS DATE) AS day, avg(CASE WHEN event_type = 'error' THEN value END) AS a, avg(CASE WHEN event_type = 'signup' THEN value END) AS b FROM events GROUP BY CAST(ts AS DATE))
SELECT day, round(a, 6) AS base, round(b, 6) AS changed, round(b - a, 6) AS delta, coalesce(b - a < -0.02e0, false) AS regressed FROM r""",
    "cost_per_task": "SELECT event_type, count(*) AS trials, round(sum(value), 4) AS cost, round(sum(value) / CASE WHEN count(DISTINCT user_id) = 0 THEN 1 ELSE count(DISTINCT user_id) END, 4) AS cost_per_task FROM events GROUP BY event_type",
    "kept_runs": "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k <= 50",
    "channel_transitions": """WITH r AS (SELECT event_type AS now, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT before, now, count(*) AS n FROM r WHERE before IS NOT NULL GROUP BY before, now""",
    "dimension_union": """WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), b AS (SELECT d.lang, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang)
SELECT coalesce(a.lang, b.lang) AS lang, a.n AS all_rows, b.n AS labelled FROM a FULL OUTER JOIN b ON a.lang IS NOT DISTINCT FROM b.lang""",
}


def pass_rates(rows: DataFrame, ok: Column, *axes: str) -> DataFrame:
    """Rates for each value of each axis, and over all rows."""
    sets = rows.withColumn("ok", ok.cast("double")).groupingSets([*([F.col(a)] for a in axes), []], *map(F.col, axes))
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("ok"), 4).alias("rate"))


def filter_counts(rows: DataFrame, verdict: Column) -> DataFrame:
    """total, passed, failed, errors (null verdicts) and pass_rate, in which errors count."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.agg(F.count("*").alias("total"), n(verdict).alias("passed"), n(~verdict).alias("failed"), n(verdict.isNull()).alias("errors"), F.round(n(verdict) / F.count("*"), 4).alias("pass_rate"))


def filter_verdict(stated: Column, total: Column, threshold: float = 7) -> Column:
    """What the judge says, else whether the total reaches ``threshold``; null where neither is known."""
    return F.coalesce(stated, total >= threshold)


def margin_loss(rows: DataFrame, by: str, chosen: str, rejected: str, beta: float = 2.0, gamma: float = 0.5) -> DataFrame:
    """Mean of -log sigmoid(beta (chosen - rejected) - gamma)."""
    return rows.groupBy(by).agg(F.round(F.avg(F.log1p(F.exp(-(beta * (F.col(chosen) - F.col(rejected)) - gamma)))), 6).alias("loss"))


def synthetic_scores(kind: Column, number: Column, base: dict[str, float], other: float = 0.6) -> Column:
    start = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), kind), F.lit(other))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), start + ((7 * number + 3) % 11 - 5) * 0.01)), 3)


def transitions(rows: DataFrame, entity: str, state: str, *order: str) -> DataFrame:
    """How often each state follows each other one of the same entity."""
    before = F.lag(state).over(Window.partitionBy(entity).orderBy(*order))
    return rows.select(F.col(state).alias("now"), before.alias("before")).where("before is not null").groupBy("before", "now").agg(F.count("*").alias("n"))


def last_runs(rows: DataFrame, by: str, n: int, *newest: str) -> DataFrame:
    """The newest ``n`` rows of each group."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(*map(F.desc, newest)))).where(F.col("k") <= n).drop("k")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.sum(F.when(F.col("event_type") == kind, 1.0).otherwise(0.0)) / F.count("*")
    days = _read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg((n("error") - n("signup")).alias("d"))
    row = days.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).where("sd > 0")
    return row.select("n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(F.col("mean") / (F.col("sd") / F.sqrt("n")), 4).alias("t"))


def published_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates against a published rate of 0.5 with the interval 0.45 to 0.55."""
    r = _read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("p"))
    delta, e = F.col("p") - 0.5, F.sqrt(F.lit((0.55 - 0.45) / 3.92) ** 2 + F.col("p") * (1 - F.col("p")) / F.col("n"))
    return r.select("event_type", "n", F.round(delta, 4).alias("delta"), F.round(delta / e, 4).alias("z"), F.round(delta - 1.96 * e, 4).alias("lo"), F.round(delta + 1.96 * e, 4).alias("hi"))


def condition_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    r = _read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(mean("error").alias("a"), mean("signup").alias("b"))
    delta = F.col("b") - F.col("a")
    return r.select("day", F.round("a", 6).alias("base"), F.round("b", 6).alias("changed"), F.round(delta, 6).alias("delta"), F.coalesce(delta < -0.02, F.lit(False)).alias("regressed"))


def cost_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, tasks = F.sum("value"), F.greatest(F.countDistinct("user_id"), F.lit(1))
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("trials"), F.round(whole, 4).alias("cost"), F.round(whole / tasks, 4).alias("cost_per_task"))


def dimension_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang")
    a = docs.groupBy("lang").agg(F.count("*").alias("all_rows"))
    b = docs.join(_read(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("lang").alias("other")).agg(F.count("*").alias("labelled"))
    return a.join(b, F.col("lang").eqNullSafe(F.col("other")), "full_outer").select(F.coalesce("lang", "other").alias("lang"), "all_rows", "labelled")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("dimension"), F.col("turn").alias("trial"), "text")


QUERIES |= {
    "pass_at_1_rollup": lambda s, d: pass_rates(_turns(s, d), F.coalesce(F.length("text") > 200, F.lit(False)), "dimension", "trial"),
    "pointwise_filter": lambda s, d: filter_counts(_read(s, d, "labels"), F.col("quality") == 1),
    "preference_loss": lambda s, d: margin_loss(_read(s, d, "lineitem"), "l_linestatus", "l_discount", "l_tax"),
    "synthetic_score": lambda s, d: _read(s, d, "events").select("event_id", synthetic_scores(F.col("event_type"), F.col("event_id"), {"error": 0.4, "purchase": 0.8}).alias("score")),
    "paired_t": paired_t,
    "one_sample_z": published_z,
    "condition_deltas": condition_deltas,
    "cost_per_task": cost_per_task,
    "kept_runs": lambda s, d: last_runs(_read(s, d, "events").select("event_id", "user_id", "ts"), "user_id", 50, "ts", "event_id").select("event_id", "user_id"),
    "channel_transitions": lambda s, d: transitions(_read(s, d, "events"), "user_id", "event_type", "ts", "event_id"),
    "dimension_union": dimension_union,
}
