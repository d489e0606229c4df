"""Dense similarity, time-shift audits, and duplicates by pair similarity, as functions on DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.operators.contamination import tokens

#: Bytes of item vectors that are sent to all tasks at once; more items take more passes.
MATRIX_BYTES = 32_000_000
#: Rows of items and of references whose products are held at once.
TILE = 1000


def _unit(rows: pd.Series) -> np.ndarray:
    """Vectors of length 1, scaled before they are squared."""
    x = np.stack(rows.to_list()).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def best_references(ids: np.ndarray, x: np.ndarray | None, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, cosine and ref_id of the best reference in ``batches`` of each item, a tile of products at a time."""
    top, ref = np.full(len(ids), -np.inf), np.zeros(len(ids), dtype=np.int64)
    for pdf in batches if len(ids) else ():
        for at in range(0, len(pdf), TILE):
            part = pdf.iloc[at : at + TILE].sort_values("id", kind="stable")
            y, names = _unit(part["v"]).T, part["id"].to_numpy()
            for start in range(0, len(ids), TILE):
                to = slice(start, start + TILE)
                dots = x[to] @ y
                np.round(dots, 12, out=dots)
                place = dots.argmax(1)
                value, own = dots[np.arange(len(dots)), place], names[place]
                better = (value > top[to]) | ((value == top[to]) & (own < ref[to]))
                top[to][better], ref[to][better] = value[better], own[better]
    seen = top > -np.inf
    yield pd.DataFrame({"id": ids[seen], "cosine": top[seen], "ref_id": ref[seen]})


def dense_top1(items: DataFrame, references: DataFrame, threshold: float = 0.85) -> DataFrame:
    """id, max_cosine, ref_id and contaminated of every item with a usable vector.

    Both have columns id (long) and v (array of doubles). Vectors that are null or zero, or have
    null or non-finite parts, match nothing; the smallest reference wins a tie. Items are dealt into
    blocks of at most about MATRIX_BYTES by a hash of their id, with one pass over the references for
    each; a task keeps the best of each item over all its references and gives it once. Products are
    made a tile at a time, so that a task holds a block and one tile, whatever the number of items.
    """
    width = references.select(F.max(F.size("v"))).first()[0] or 0
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False)) & (F.size("v") == width)
    items, references = items.where(usable).select("id", "v"), references.where(usable).select("id", "v")
    blocks = -(-items.count() * 8 * max(width, 1) // MATRIX_BYTES) or 1

    def one_pass(block: pd.DataFrame) -> DataFrame:
        ids, x = block["id"].to_numpy(), _unit(block["v"]) if len(block) else None
        found = references.mapInPandas(lambda batches: best_references(ids, x, batches), "id long, cosine double, ref_id long")
        return found.groupBy("id").agg(F.max(F.struct("cosine", (-F.col("ref_id")).alias("low"))).alias("top"))

    out = None
    for k in range(blocks):
        part = one_pass(items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toPandas())
        out = part if out is None else out.unionByName(part)
    return out.select("id", F.round("top.cosine", 4).alias("max_cosine"), (-F.col("top.low")).alias("ref_id"), (F.col("top.cosine") >= threshold).alias("contaminated"))


def embedding_max_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even vectors are items, odd ones references; an item without any match has cosine 0 and reference -1."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    items, refs = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    out = items.select("id").join(dense_top1(items, refs), "id", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("max_cosine", F.lit(0.0)).alias("max_cosine"), F.coalesce("ref_id", F.lit(-1)).alias("ref_id"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))


def time_shift_violations(tasks: DataFrame, cutoff: str) -> DataFrame:
    """One row for each broken rule: task_id, split, violation, severity, days_stale.

    ``tasks`` has task_id, split, created and locked (strings that begin with a date), and jittered.
    A date that can't be read breaks the first rule and no other.
    """
    created, locked = (F.try_to_date(F.substring(c, 1, 10)) for c in ("created", "locked"))
    absent = F.coalesce(F.col("created"), F.lit("")) == ""
    first = F.when(absent, "missing_created_at").when(created.isNull(), "invalid_created_at").when(created < F.lit(cutoff).cast("date"), "created_before_cutoff")
    second = F.when((F.col("split") == "held_out") & ~F.coalesce("jittered", F.lit(False)), "held_out_not_jittered")
    third = F.when(locked < created, "stale_snapshot")
    kinds = F.array_compact(F.array(first, second, third))
    rows = tasks.select("task_id", "split", F.datediff(created, locked).alias("days"), F.explode(kinds).alias("violation"))
    severity = F.when(F.col("violation") == "held_out_not_jittered", "warning").when(F.col("violation") == "stale_snapshot", "stale").otherwise("hard")
    return rows.select("task_id", "split", "violation", severity.alias("severity"), F.when(F.col("violation") == "stale_snapshot", F.col("days")).alias("days_stale"))


def time_shift_summary(tasks: DataFrame, cutoff: str) -> DataFrame:
    """One row: tasks, hard violations, warnings, stale snapshots, held_out_jitter_ok and status."""
    found = time_shift_violations(tasks, cutoff).agg(*[F.count_if(F.col("severity") == k).alias(n) for k, n in (("hard", "hard"), ("warning", "warnings"), ("stale", "stale"))])
    held = F.when(F.col("split") == "held_out", F.coalesce("jittered", F.lit(False)))
    whole = tasks.agg(F.count("*").alias("tasks"), F.coalesce(F.bool_and(held), F.lit(False)).alias("held_out_jitter_ok"))
    return whole.crossJoin(found).withColumn("status", F.when((F.col("hard") == 0) & (F.col("stale") == 0), "CLEAN").otherwise("VIOLATIONS"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: split by priority, locked until the first shipping date; and three fixtures."""
    first = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("locked"))
    split = F.when(F.startswith("o_orderpriority", F.lit("1")), "held_out").when(F.startswith("o_orderpriority", F.lit("2")), "dev").otherwise("train")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").join(first, "o_orderkey", "left")
    rows = rows.select(F.col("o_orderkey").cast("string").alias("task_id"), split.alias("split"), F.col("o_orderdate").cast("string").alias("created"), F.col("locked").cast("string").alias("locked"), (F.col("o_orderstatus") == "F").alias("jittered"))
    extra = [("x1", "train", "", "2020-01-01", None), ("x2", "held_out", "no date", "2020-01-01", True), ("x3", "held_out", "2020-05-05T10:00:00", "2020-05-01", None)]
    return rows.unionByName(spark.createDataFrame(extra, rows.schema))


def time_shift_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_shift_violations(_dated(spark, sf_dir), "1995-01-01")


def time_shift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_shift_summary(_dated(spark, sf_dir), "1995-01-01")


#: ln(3/2) + 1: the weight of a word that only one of two texts has.
OWN = 1.4054651081081644


def similar_pairs(rows: DataFrame, key: Column, least: float = 0.9) -> DataFrame:
    """i < j and the TF-IDF cosine, fitted on the two texts alone, of all pairs at ``least`` or more.

    ``rows`` has id, block and score. Words have two characters or more. In the pair's weights, words
    of both texts weigh 1 and others OWN, so a word of one text alone lowers the cosine: with every
    word of weight 1, the cosine is no smaller. By the prefix filter on those weights, only words that
    come first, rarest first, until the rest of a text's squared counts is below ``least`` squared of
    the whole, are joined.
    """
    words = F.regexp_extract_all(F.lower(key), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    counts = rows.select("id", "block", F.explode(words).alias("word")).groupBy("block", "id", "word").agg(F.count("*").alias("tf"))
    df = counts.groupBy("block", "word").agg(F.count("*").alias("df"))
    bags = counts.join(df, ["block", "word"]).groupBy("block", "id").agg(F.sort_array(F.collect_list(F.struct("df", "word", "tf"))).alias("bag"))
    square = lambda bag: F.aggregate(bag, F.lit(0).cast("bigint"), lambda a, x: a + x["tf"] * x["tf"])
    bags = bags.withColumn("whole", square(F.col("bag")))
    # a text shares at least least**2 of its squared counts with a text at the threshold
    place = F.posexplode("bag").alias("at", "x")
    prefix = bags.select("block", "id", "whole", "bag", place).select("block", "id", F.col("x.word").alias("word"), (F.col("whole") - square(F.slice("bag", F.lit(1), F.col("at")))).alias("rest"), "whole")
    prefix = prefix.where(F.col("rest") >= least * least * F.col("whole")).select("block", "id", "word")
    pairs = prefix.select("block", "word", F.col("id").alias("i")).join(prefix.select("block", "word", F.col("id").alias("j")), ["block", "word"]).where("i < j").select("i", "j").distinct()
    side = lambda n, m: bags.select(F.col("id").alias(n), F.map_from_entries(F.transform("bag", lambda x: F.struct(x["word"], x["tf"]))).alias(m), F.col("whole").alias("w" + n))
    both = pairs.join(side("i", "a"), "i").join(side("j", "b"), "j")
    shared = F.filter(F.map_keys("a"), lambda w: F.map_contains_key("b", w))
    total = lambda f: F.aggregate(shared, F.lit(0).cast("bigint"), lambda s, w: s + f(w))
    dot = total(lambda w: F.element_at("a", w) * F.element_at("b", w))
    norm = lambda m, n: F.sqrt(total(lambda w: F.element_at(m, w) * F.element_at(m, w)) + OWN * OWN * (F.col(n) - total(lambda w: F.element_at(m, w) * F.element_at(m, w))))
    return both.select("i", "j", (dot / norm("a", "wi") / norm("b", "wj")).alias("similarity")).where(F.col("similarity") >= least)


def losers(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Ids that lose a pair: the lower score, the larger id in a tie. A loser still beats others."""
    a = rows.select(F.col("id").alias("i"), F.col("score").alias("si"))
    b = rows.select(F.col("id").alias("j"), F.col("score").alias("sj"))
    lost = F.when(F.coalesce("si", F.lit(0)) < F.coalesce("sj", F.lit(0)), F.col("i")).otherwise(F.col("j"))
    return pairs.join(a, "i").join(b, "j").select(lost.alias("id")).distinct()


def _short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with their text as key, all in one block."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    twice = items.select(F.col("item_id").cast("long").alias("id"), "text", (F.length("text") % 7).alias("score"))
    again = twice.select((F.col("id") + 1_000_000).alias("id"), F.concat("text", F.lit(" extra word")).alias("text"), F.lit(3).alias("score"))
    return twice.unionByName(again).withColumn("block", F.lit(0))


def dedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item and a changed copy of it, as short texts to be deduplicated."""
    return similar_pairs(_short_texts(spark, sf_dir), F.concat_ws(" ", F.coalesce("text", F.lit("")))).select("i", "j", F.round("similarity", 6).alias("similarity"))


def dedup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short_texts(spark, sf_dir)
    lost = losers(similar_pairs(rows, F.coalesce("text", F.lit(""))), rows)
    return rows.join(lost, "id", "left_anti").select("id", "score")


_DATED = """WITH l AS (SELECT l_orderkey, min(l_shipdate) AS locked FROM lineitem GROUP BY 1),
t AS (SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'held_out' WHEN '2' THEN 'dev' ELSE 'train' END AS split, CAST(o_orderdate AS VARCHAR) AS created, CAST(locked AS VARCHAR) AS locked, o_orderstatus = 'F' AS jittered FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
UNION ALL VALUES ('x1', 'train', '', '2020-01-01', NULL), ('x2', 'held_out', 'no date', '2020-01-01', true), ('x3', 'held_out', '2020-05-05T10:00:00', '2020-05-01', NULL)),
d AS (SELECT *, try_cast(left(created, 10) AS DATE) AS c, try_cast(left(locked, 10) AS DATE) AS k FROM t),
v AS (SELECT task_id, split, CASE WHEN created IS NULL OR created = '' THEN 'missing_created_at' WHEN c IS NULL THEN 'invalid_created_at' ELSE 'created_before_cutoff' END AS violation, 'hard' AS severity, CAST(NULL AS INT) AS days_stale FROM d WHERE created IS NULL OR created = '' OR c IS NULL OR c < DATE '1995-01-01'
UNION ALL SELECT task_id, split, 'held_out_not_jittered', 'warning', NULL FROM d WHERE split = 'held_out' AND NOT coalesce(jittered, false)
UNION ALL SELECT task_id, split, 'stale_snapshot', 'stale', CAST(date_diff('day', k, c) AS INT) FROM d WHERE k < c)"""
_SHORT = r"""WITH t AS (SELECT CAST(item_id AS BIGINT) AS id, text, length(text) % 7 AS score FROM benchmark UNION ALL SELECT CAST(item_id AS BIGINT) + 1000000, text || ' extra word', 3 FROM benchmark),
w AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM t) GROUP BY ALL),
n AS (SELECT id, sum(tf * tf) AS whole FROM w GROUP BY 1),
p AS (SELECT a.id AS i, b.id AS j, sum(a.tf * b.tf) AS dot, sum(a.tf * a.tf) AS sa, sum(b.tf * b.tf) AS sb FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY ALL),
s AS (SELECT i, j, dot / sqrt(sa + pow(1 + ln(1.5), 2) * (x.whole - sa)) / sqrt(sb + pow(1 + ln(1.5), 2) * (y.whole - sb)) AS similarity FROM p JOIN n x ON x.id = i JOIN n y ON y.id = j),
f AS (SELECT * FROM s WHERE similarity >= 0.9)"""
QUERIES = {"embedding_max_similarity": embedding_max_similarity, "time_shift_rows": time_shift_rows, "time_shift_report": time_shift_report, "dedup_pairs": dedup_pairs, "dedup_kept": dedup_kept}
ORACLES = {
    "embedding_max_similarity": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS ref_id, round(list_cosine_similarity(a.v, b.v), 12) AS c FROM e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) SELECT CAST(vec_id AS BIGINT) AS vec_id, round(c, 4) AS max_cosine, CAST(ref_id AS BIGINT) AS ref_id, c >= 0.85 AS contaminated FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, ref_id) = 1",
    "time_shift_rows": f"{_DATED} SELECT * FROM v",
    "time_shift_report": f"{_DATED} SELECT (SELECT count(*) FROM t) AS tasks, (SELECT bool_and(coalesce(jittered, false)) FROM t WHERE split = 'held_out') AS held_out_jitter_ok, count(*) FILTER (severity = 'hard') AS hard, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'stale') AS stale, CASE WHEN count(*) FILTER (severity <> 'warning') = 0 THEN 'CLEAN' ELSE 'VIOLATIONS' END AS status FROM v",
    "dedup_pairs": f"{_SHORT} SELECT i, j, round(similarity, 6) AS similarity FROM f",
    "dedup_kept": f"{_SHORT}, x AS (SELECT CASE WHEN a.score < b.score THEN i ELSE j END AS id FROM f JOIN t a ON a.id = i JOIN t b ON b.id = j) SELECT id, score FROM t WHERE id NOT IN (SELECT id FROM x)",
}
