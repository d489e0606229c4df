"""A company's maturity from weighted signals, by a configuration, from the prose of a test description.

The description gives some cells by example only. Chosen here: signals found by keywords have the
confidence 0.7, leadership 0.9; a signal of high weight adds a point (roles two from the upper number
on), one of medium weight a point, one of low weight none; the score is 3 at most; and the rules of
confidence that aren't in the examples are the last four of ``CONFIDENCE``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The signals and their weights, and the rules that the examples state.
WEIGHTS = {
    "ai_adjacent_roles": "high",
    "named_ai_leadership": "high",
    "ai_industry_classification": "medium",
    "executive_commentary": "medium",
    "ml_stack_keywords": "low",
    "strategic_ai_communications": "low",
}
KEYWORDS = {
    "ai_industry_classification": ("artificial intelligence", "machine learning"),
    "executive_commentary": ("ai", "machine learning", "llm", "automation"),
    "ml_stack_keywords": ("mlops", "model deployment"),
    "strategic_ai_communications": ("ai-powered", "ai platform"),
}
#: The column that each signal's keywords are looked for in.
COLUMNS = {"ai_industry_classification": "industry", "executive_commentary": "recent_news", "ml_stack_keywords": "description", "strategic_ai_communications": "description"}
#: (high, medium, low signals at least, confidence): the first rule that holds.
CONFIDENCE = ((2, 0, 0, 0.85), (1, 2, 0, 0.70), (1, 0, 0, 0.65), (0, 2, 0, 0.60), (0, 1, 0, 0.55), (0, 0, 1, 0.50))


@dataclass(frozen=True)
class Config:
    """What may be changed without code: keywords, numbers of roles, the longest tenure of a new leader, and the rules."""

    keywords: dict[str, tuple[str, ...]] = field(default_factory=lambda: KEYWORDS)
    some_roles: int = 1
    many_roles: int = 3
    tenure_days: int = 90
    rules: tuple[tuple[int, int, int, float], ...] = CONFIDENCE
    otherwise: float = 0.3


def signals(config: Config) -> Column:
    """An array of (signal_name, weight, detected, confidence, points) in the order of ``WEIGHTS``.

    Columns read: roles (array), cto_name, cto_tenure_days, description, industry, recent_news. Nulls
    detect nothing. Keywords are looked for as whole words, whatever their case.
    """
    roles = F.coalesce(F.size("roles"), F.lit(0))
    many, some = roles >= config.many_roles, roles >= config.some_roles
    leads = (F.trim("cto_name") != "") & (F.col("cto_tenure_days") <= config.tenure_days)
    found = {"ai_adjacent_roles": (some, F.when(many, 0.9).otherwise(0.7), F.when(many, 2).otherwise(1)), "named_ai_leadership": (leads, F.lit(0.9), F.lit(1))}
    for name, column in COLUMNS.items():
        words = config.keywords.get(name, ())
        # what stands beside a keyword is no letter or digit
        padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}-]+", " "), F.lit(" "))
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(padded, F.lit(f" {w.lower()} "))
        found[name] = (hit, F.lit(0.7), F.lit(0 if WEIGHTS[name] == "low" else 1))
    out = []
    for name, weight in WEIGHTS.items():
        detected, confidence, points = found[name]
        detected = F.coalesce(detected, F.lit(False))
        out.append(F.struct(F.lit(name).alias("signal_name"), F.lit(weight).alias("weight"), detected.alias("detected"), F.when(detected, confidence).otherwise(0.0).alias("confidence"), F.when(detected, points).otherwise(0).alias("points")))
    return F.array(*out)


def score_maturity(companies: DataFrame, config: Config = Config()) -> DataFrame:
    """``companies`` with score (0 to 3), confidence and signal_breakdown, by one fold over the signals."""
    rows = companies.withColumn("signal_breakdown", signals(config))
    one = lambda s, w: (s["detected"] & (s["weight"] == w)).cast("int")
    start = F.struct(*[F.lit(0).alias(n) for n in ("points", "high", "medium", "low")])
    step = lambda a, s: F.struct((a["points"] + s["points"]).alias("points"), *[(a[w] + one(s, w)).alias(w) for w in ("high", "medium", "low")])
    rows = rows.withColumn("_sum", F.aggregate("signal_breakdown", start, step))
    confidence = F.lit(config.otherwise)
    for high, medium, low, value in reversed(config.rules):
        holds = (F.col("_sum.high") >= high) & (F.col("_sum.medium") >= medium) & (F.col("_sum.low") >= low)
        confidence = F.when(holds, value).otherwise(confidence)
    return rows.withColumns({"score": F.least("_sum.points", F.lit(3)), "confidence": confidence}).drop("_sum")


def maturity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies: the market segment as industry and news, the key's remainders as roles and tenure."""
    key = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key, F.array_repeat(F.lit("role"), (key % 5).cast("int")).alias("roles"), F.when(key % 3 > 0, "Jane").otherwise(" ").alias("cto_name"), F.when(key % 7 > 0, (key % 7).cast("int") * 30).alias("cto_tenure_days"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("An AI-powered "), "c_mktsegment", F.lit(", MLOps!"))).alias("description"), F.lower("c_mktsegment").alias("industry"), F.concat("c_mktsegment", F.lit(" and automation")).alias("recent_news"),
    )
    config = Config(keywords=KEYWORDS | {"ai_industry_classification": ("machinery", "building"), "executive_commentary": ("automobile", "household")})
    flags = F.array_join(F.transform("signal_breakdown", lambda s: F.when(s["detected"], "1").otherwise("0")), "")
    return score_maturity(rows, config).select("c_custkey", "score", "confidence", flags.alias("detected"))


QUERIES = {"maturity_scores": maturity_scores}
ORACLES = {
    "maturity_scores": """WITH s AS (SELECT c_custkey, (c_custkey % 5 >= 1)::int AS a, (c_custkey % 5 >= 3)::int AS many, (c_custkey % 3 > 0 AND c_custkey % 7 > 0 AND c_custkey % 7 * 30 <= 90)::int AS b,
coalesce(c_mktsegment IN ('MACHINERY', 'BUILDING'), false)::int AS c, coalesce(c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD'), false)::int AS d, coalesce(c_acctbal > 0 AND c_mktsegment IS NOT NULL, false)::int AS e FROM customer)
SELECT c_custkey, least(a + many + b + c + d, 3) AS score, CASE WHEN a + b >= 2 THEN 0.85 WHEN a + b >= 1 AND c + d >= 2 THEN 0.7 WHEN a + b >= 1 THEN 0.65 WHEN c + d >= 2 THEN 0.6 WHEN c + d >= 1 THEN 0.55 WHEN e >= 1 THEN 0.5 ELSE 0.3 END AS confidence,
concat(a, b, c, d, e, e) AS detected FROM s""",
}
