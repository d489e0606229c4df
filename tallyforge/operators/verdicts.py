"""The whole contamination verdict of an item: shared grams, sparse and dense cosine, worst references, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.operators import audits, cosine_index
from tallyforge.operators.contamination import containment
from tallyforge.operators.evaluation import _VERDICTS

KINDS = ("ngram", "cosine", "embedding")
FLAGS = {"ngram": "ngram_exact_match", "cosine": "high_tfidf_cosine", "embedding": "high_embedding_similarity"}


def contamination_cases(items: DataFrame, docs: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None, n: int = 8, cosine: float = 0.85, embedding: float = 0.85) -> DataFrame:
    """One row for each item that has words.

    item_id, and for each kind of check (ngram, cosine, embedding) the highest value ``max_<kind>``,
    rounded to four places after it is compared, the worst reference ``<kind>_ref`` (-1 without one)
    and a flag; ``violations``, the names of the flags that are set; ``contaminated`` and ``status``.
    ``vectors`` are the items' and the references' (id, v); without them, or for an item without a
    usable vector, ``max_embedding`` is null. Of equal references the smallest id is the worst.
    Null and empty texts have no row. Items and documents have unique ids.
    """
    items, docs = items.select("item_id", "text"), docs.select("doc_id", "text")
    shape = lambda kind, value, ref: (F.lit(kind).alias("kind"), F.col(value).alias("value"), F.col(ref).cast("long").alias("ref"))
    found = containment(items, docs, n).select("item_id", *shape("ngram", "share", "doc_id"))
    found = found.unionByName(cosine_index.top1(items, docs).select("item_id", *shape("cosine", "cosine", "doc_id")))
    if vectors is not None:
        dense = audits.dense_top1(*vectors, embedding).withColumnRenamed("id", "item_id")
        found = found.unionByName(dense.select("item_id", *shape("embedding", "max_cosine", "ref_id"), "contaminated"), allowMissingColumns=True)
    else:
        found = found.withColumn("contaminated", F.lit(None).cast("boolean"))
    own = lambda kind, c: F.when(F.col("kind") == kind, c)
    tops = found.groupBy("item_id").agg(
        *[F.max(own(k, F.struct("value", (-F.col("ref")).alias("low")))).alias(k) for k in KINDS],
        F.bool_or("contaminated").alias("flagged"),
    )
    spoken = items.where(F.col("text").rlike(r"(?U)\S")).select("item_id")
    rows = spoken.join(tops, "item_id", "left")
    value = {k: F.col(f"{k}.value") if k == "embedding" else F.coalesce(F.col(f"{k}.value"), F.lit(0.0)) for k in KINDS}
    flag = {"ngram": value["ngram"] >= 1.0, "cosine": value["cosine"] >= cosine, "embedding": F.coalesce("flagged", F.lit(False))}
    out = [F.col("item_id")]
    for k in KINDS:
        out += [F.round(value[k], 4).alias(f"max_{k}"), F.coalesce(-F.col(f"{k}.low"), F.lit(-1).cast("long")).alias(f"{k}_ref"), flag[k].alias(f"{k}_flag")]
    rows = rows.select(*out)
    names = F.array_compact(F.array(*[F.when(F.col(f"{k}_flag"), FLAGS[k]) for k in KINDS]))
    rows = rows.withColumn("violations", names).withColumn("contaminated", F.size("violations") > 0)
    return rows.withColumn("status", F.when(F.col("contaminated"), "CONTAMINATED").otherwise("CLEAN"))


def case_report(cases: DataFrame, items: DataFrame, docs: DataFrame, embedded: bool) -> DataFrame:
    """One row: tasks checked, reference documents, clean, violations by kind and in all, rate, checks run and status.

    Items without words are checked, but are neither clean nor a violation.
    """
    bad = F.count_if("contaminated")
    sums = cases.agg(F.count_if(~F.col("contaminated")).alias("clean"), bad.alias("violations"), *[F.count_if(f"{k}_flag").alias(f"{k}_violations") for k in KINDS])
    counts = items.agg(F.count("*").alias("tasks_checked")).crossJoin(docs.agg(F.count("*").alias("reference_docs"))).crossJoin(sums)
    checks = ["ngram_overlap", "tfidf_cosine", *(["embedding_similarity"] if embedded else [])]
    rate = F.round(F.col("violations") / F.greatest("tasks_checked", F.lit(1)), 4)
    return counts.withColumns({"contamination_rate": rate, "checks_run": F.lit(",".join(checks)), "status": F.when(F.col("violations") == 0, "CLEAN").otherwise("CONTAMINATED")})


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """Items, documents, and vectors: those whose id is an item's, and all others as references."""
    items, docs, rows = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "documents", "embeddings"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    ids = items.select(F.col("item_id").alias("id"))
    return items, docs, (rows.join(ids, "id", "left_semi"), rows.join(ids, "id", "left_anti"))


def contamination_cases_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_cases(*_tables(spark, sf_dir)).withColumn("violations", F.array_join("violations", ","))


def contamination_case_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs, vectors = _tables(spark, sf_dir)
    return case_report(contamination_cases(items, docs, vectors), items, docs, True)


_CASES = f"""{_VERDICTS}, gr AS (SELECT item_id, doc_id AS ref, hits / grams AS share FROM h JOIN s USING (item_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hits / grams DESC, doc_id) = 1),
cr AS (SELECT item_id, CAST(doc_id AS BIGINT) AS ref FROM (SELECT item_id, doc_id, round(dot / l.norm / k.norm, 4) AS cosine FROM p JOIN l ON l.id = item_id AND l.item JOIN l k ON k.id = doc_id AND NOT k.item) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, CAST(doc_id AS BIGINT)) = 1),
ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), ek AS (SELECT item_id FROM benchmark),
er AS (SELECT a.vec_id, b.vec_id AS ref, round(list_cosine_similarity(a.v, b.v), 12) AS c FROM ev a JOIN ev b ON a.vec_id IN (SELECT item_id FROM ek) AND b.vec_id NOT IN (SELECT item_id FROM ek) QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY c DESC, b.vec_id) = 1),
z AS (SELECT m.item_id, v.max_ngram, coalesce(gr.ref, -1) AS ngram_ref, v.ngram_flag, v.max_cosine, coalesce(cr.ref, -1) AS cosine_ref, v.cosine_flag, round(er.c, 4) AS max_embedding, coalesce(er.ref, -1) AS embedding_ref, coalesce(er.c >= 0.85, false) AS embedding_flag
FROM benchmark m JOIN v ON v.item_id = CAST(m.item_id AS VARCHAR) LEFT JOIN gr ON gr.item_id = m.item_id LEFT JOIN cr ON cr.item_id = v.item_id LEFT JOIN er ON er.vec_id = m.item_id WHERE regexp_matches(m.text, '\\S')),
y AS (SELECT *, concat_ws(',', CASE WHEN ngram_flag THEN 'ngram_exact_match' END, CASE WHEN cosine_flag THEN 'high_tfidf_cosine' END, CASE WHEN embedding_flag THEN 'high_embedding_similarity' END) AS violations, ngram_flag OR cosine_flag OR embedding_flag AS contaminated FROM z)"""

QUERIES = {"contamination_cases": contamination_cases_query, "contamination_case_report": contamination_case_report}
ORACLES = {
    "contamination_cases": f"{_CASES} SELECT *, CASE WHEN contaminated THEN 'CONTAMINATED' ELSE 'CLEAN' END AS status FROM y",
    "contamination_case_report": f"{_CASES} SELECT (SELECT count(*) FROM benchmark) AS tasks_checked, (SELECT count(*) FROM documents) AS reference_docs, count(*) FILTER (NOT contaminated) AS clean, count(*) FILTER (contaminated) AS violations, count(*) FILTER (ngram_flag) AS ngram_violations, count(*) FILTER (cosine_flag) AS cosine_violations, count(*) FILTER (embedding_flag) AS embedding_violations, round(count(*) FILTER (contaminated) / greatest((SELECT count(*) FROM benchmark), 1), 4) AS contamination_rate, 'ngram_overlap,tfidf_cosine,embedding_similarity' AS checks_run, CASE WHEN count(*) FILTER (contaminated) = 0 THEN 'CLEAN' ELSE 'CONTAMINATED' END AS status FROM y",
}
