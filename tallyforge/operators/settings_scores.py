"""Scores by a settings file, and tasks that go through files: written, read back, scored, reported."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.functions import scoring as s
from tallyforge.operators.evaluation import BOOKED, HOSTILE, NET_ACCUSING, OTHER_TIMES, _sql, _sql_any
from tallyforge.operators.scorer import _ROWS, score_tasks, tasks
from tallyforge.sources import documents, readers, writers
from tallyforge.storage import folder

#: The sections that the benchmark's items are dealt to, by their id.
SECTIONS = ("hedge_patterns", "interrogative_patterns", "escalation_patterns", "banned_phrases", "condescending_patterns", "accusatory_patterns", "consent_patterns", "honest_patterns", "question_framing_patterns")
#: An entry that is no pattern, after all others of its section.
BROKEN = ("question_framing_patterns", "(unclosed")
#: Ids of items lie below it.
LAST = 2**40


def batch_report(scored: DataFrame) -> DataFrame:
    """One row over scored tasks: total_files, json_errors, skipped_no_output, errors, scored, passed, failed and pass_at_1.

    A file that is no JSON and a task without an output are neither errors nor scored; a blank
    output is an error. Without a scored task ``pass_at_1`` is null.
    """
    broken = F.coalesce(F.col("file_error").isNotNull(), F.lit(False))
    silent = ~broken & (F.coalesce("text", F.lit("")) == "")
    live = ~broken & ~silent
    fine = live & F.col("error").isNull()
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    sums = scored.agg(F.count("*").alias("total_files"), n(broken).alias("json_errors"), n(silent).alias("skipped_no_output"), n(live & F.col("error").isNotNull()).alias("errors"), n(fine).alias("scored"), n(fine & F.col("passed")).alias("passed"))
    return sums.withColumn("failed", F.col("scored") - F.col("passed")).withColumn("pass_at_1", F.round(F.try_divide("passed", "scored"), 4))


def file_columns(read: DataFrame) -> DataFrame:
    """Tasks as ``read_tasks`` gives them, with the columns that scores are made of."""
    brief, bench = F.col("input.hiring_signal_brief"), F.col("input.bench_summary_snapshot")
    return read.select(
        "file", F.col("error").alias("file_error"), F.coalesce("task_id", F.regexp_replace("file", r"\.json$", "")).alias("task_id"), "dimension", F.col("candidate_output").alias("text"),
        F.col("ground_truth.expected_behaviors").alias("behaviours"), brief["open_role"].alias("role"), bench["available_roles"].alias("roles"), F.col("rubric.pass_threshold").alias("threshold"),
    )


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of four or more letters of each item, as an entry of the section that its id deals it to."""
    names = F.array(*map(F.lit, SECTIONS))
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.get(names, F.pmod(F.col("item_id"), F.lit(len(SECTIONS))).cast("int")).alias("section"), F.col("item_id").cast("long").alias("place"), F.regexp_extract("text", r"([A-Za-z]{4,})", 1).alias("entry"))
    return rows.where("entry <> ''").unionByName(spark.createDataFrame([(BROKEN[0], LAST, BROKEN[1]), ("bench_external_ban", 0, "bench")], "section string, place long, entry string"))


def settings_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of ``score_dispatch`` by a settings file that is made from the benchmark, written and read back."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    writers.write_settings(_settings(spark, sf_dir), path)
    scored = score_tasks(tasks(spark, sf_dir), readers.read_settings(spark, path))
    return scored.select("conv_id", "turn", "dimension", "error", "score", "norm", "passed")


def _task_json(item: Column, text: Column) -> Column:
    """An item as a task: its dimension, output, behaviour, stacks and threshold follow from its id."""
    dims = F.array(*[F.lit(d) for d in s.HIGHEST], F.lit("no_such_dimension"))
    name = F.concat(F.lit("item-"), item.cast("string"))
    out = F.when(item % 11 == 0, F.lit("")).when(item % 13 == 0, F.lit("  ")).otherwise(text)
    return F.to_json(F.struct(
        name.alias("task_id"), F.get(dims, F.pmod(item, F.lit(len(s.HIGHEST) + 1)).cast("int")).alias("dimension"), out.alias("candidate_output"),
        F.struct(F.array(F.regexp_extract(text, r"([A-Za-z]{4,})", 1)).alias("expected_behaviors")).alias("ground_truth"),
        F.struct((F.pmod(item, F.lit(4)) / 4.0).alias("pass_threshold")).alias("rubric"),
    ))


def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark written as one JSON file each, and read back with their scores' columns."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("long").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    documents.write_documents(items.select(F.concat(F.lit("item-"), F.col("item").cast("string")).alias("name"), _task_json(F.col("item"), F.col("text")).alias("body")), path)
    return file_columns(readers.read_tasks(spark, path))


def task_file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_tasks(task_files(spark, sf_dir), threshold=F.col("threshold"))
    return scored.select("file", "task_id", "dimension", "error", "score", "norm", "passed")


def task_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_report(score_tasks(task_files(spark, sf_dir), threshold=F.col("threshold")))


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines and read back in one form: how often each text occurs."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.struct("event_type", F.col("value").cast("int").alias("value")).alias("x")).select("x.*").write.json(path)
    return readers.read_corpus(spark, path).groupBy("text").agg(F.count("*").alias("n"))


def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as a CSV file of two raters and a comment for each row without a verdict, read back and compared."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic")
    mark = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws(",", F.concat(F.lit("t"), F.col("id").cast("string")), F.lit("quality"), mark("quality"), F.when(F.col("id") % 50 == 0, "7").otherwise(mark("toxic")), mark("quality"))
    comment = F.when(F.col("id") % 10 == 0, F.concat(F.lit("# seen "), F.col("id").cast("string")))
    lines = rows.select("id", F.explode(F.array_compact(F.array(line, comment))).alias("line"))
    head = spark.createDataFrame([(-1, "task_id,dimension,rater_a1,rater_b,rater_a2")], "id long, line string")
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    writers.write_lines(head.unionByName(lines), path, "id", "line")
    read = readers.read_annotations(spark, path)
    return read.groupBy("rater_a1", "rater_b").agg(F.count("*").alias("tasks"), F.sum(F.size("missing_cols")).alias("missing"), F.max(F.array_join("missing_cols", ";")).alias("worst"))


def _hit(section: str) -> str:
    return f"(len(list_filter(coalesce(l.m['{section}'], []), lambda x: contains(lower(text), lower(x)))) > 0)"


_HARD = f"{_sql_any([s.HARD_COMMIT])} AND (coalesce(count, 0) = 0 OR NOT fits)"
_SOFT = f"(len(regexp_extract_all(text, {_sql('(?i)' + s.FILLERS)})) / greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')), 1) < 0.03)::int + (NOT {_sql_any([s.SUPERLATIVES])})::int + {{honest}}::int + (NOT regexp_matches(text, {_sql(s.SHOUTING)}))::int + 1"
_BLAMED = f"({_hit('accusatory_patterns')} OR {_sql_any([NET_ACCUSING])})"
_SCORES = f"""{_ROWS},
st AS (SELECT ({list(SECTIONS)!r})[item_id % {len(SECTIONS)} + 1] AS section, item_id, regexp_extract(text, '([A-Za-z]{{4,}})', 1) AS entry FROM benchmark),
l AS (SELECT map_from_entries(list((section, es))) AS m FROM (SELECT section, list(entry) AS es FROM st WHERE entry <> '' GROUP BY section)),
e AS (SELECT k.*, l.m, CASE WHEN dimension IS NULL THEN 'missing_dimension' WHEN dimension NOT IN {tuple(s.HIGHEST)!r} THEN 'unknown_dimension: ' || dimension WHEN NOT coalesce(regexp_matches(text, '\\S'), false) THEN 'empty_candidate'
 WHEN dimension = 'gap_framing' AND NOT {_BLAMED} AND NOT {_hit('question_framing_patterns')} THEN 'bad_pattern: {BROKEN[0]}: {BROKEN[1]}' END AS error FROM k, l),
t AS (SELECT l.*, CASE WHEN error IS NOT NULL THEN NULL
 WHEN dimension = 'signal_grounding' THEN CASE WHEN {_sql_any(s.CERTAIN)} THEN 0 ELSE {_hit('hedge_patterns')}::int + {_hit('interrogative_patterns')}::int + (len(list_filter(keys, lambda w: contains(lower(text), w))) > 0)::int END
 WHEN dimension = 'capacity_honesty' THEN CASE WHEN {_HARD} THEN 0 ELSE 2 * {_hit('escalation_patterns')}::int + (fits AND contains(lower(text), name))::int END
 WHEN dimension = 'tone_preservation' THEN CASE WHEN {_hit('banned_phrases')} OR {_sql_any([s.BANNED_WORD])} OR {_hit('condescending_patterns')} THEN 0 ELSE {_SOFT.replace('{honest}', _hit('honest_patterns'))} END
 WHEN dimension = 'consent_coordination' THEN CASE WHEN {_sql_any([BOOKED])} AND NOT {_hit('consent_patterns')} THEN 0 ELSE 2 * {_hit('consent_patterns')}::int + {_sql_any([OTHER_TIMES])}::int END
 ELSE CASE WHEN {_BLAMED} THEN 0 ELSE 2 * {_hit('question_framing_patterns')}::int + 1 - {_sql_any([HOSTILE])}::int END END AS score FROM e l),
r AS (SELECT conv_id, turn, dimension, error, score, round(score / CASE WHEN dimension = 'tone_preservation' THEN 5 ELSE 3 END, 4) AS norm FROM t)
SELECT *, coalesce(round(norm, 2) >= 0.7, false) AS passed FROM r"""

_FILES = f"""WITH b AS (SELECT item_id, coalesce(text, '') AS given, 'item-' || item_id AS task_id, ({[*s.HIGHEST, 'no_such_dimension']!r})[item_id % 6 + 1] AS dimension, item_id % 4 / 4 AS threshold FROM benchmark),
c AS (SELECT *, CASE WHEN item_id % 11 = 0 THEN '' WHEN item_id % 13 = 0 THEN '  ' ELSE given END AS text, lower(regexp_extract(given, '([A-Za-z]{{4,}})', 1)) AS word FROM b),
e AS (SELECT *, CASE WHEN dimension = 'no_such_dimension' THEN 'unknown_dimension: no_such_dimension' WHEN NOT regexp_matches(text, '\\S') THEN 'empty_candidate' END AS error FROM c),
t AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL
 WHEN dimension = 'signal_grounding' THEN CASE WHEN {_sql_any(s.CERTAIN)} THEN 0 ELSE {_sql_any(s.HEDGES)}::int + {_sql_any(s.INTERROGATIVE)}::int + (word <> '' AND word NOT IN {tuple(s.STOP_WORDS)!r} AND contains(lower(text), word))::int END
 WHEN dimension = 'capacity_honesty' THEN CASE WHEN {_sql_any([s.HARD_COMMIT])} THEN 0 ELSE 2 * {_sql_any(s.ESCALATION)}::int END
 WHEN dimension = 'tone_preservation' THEN CASE WHEN {' OR '.join(f'contains(lower(text), {_sql(p.lower())})' for p in s.BANNED)} OR {_sql_any([s.BANNED_WORD, *s.CONDESCENDING])} THEN 0 ELSE {_SOFT.replace('{honest}', _sql_any(s.HONEST))} END
 WHEN dimension = 'consent_coordination' THEN {{consent}} ELSE {{gap}} END AS score FROM e),
r AS (SELECT task_id || '.json' AS file, task_id, dimension, error, score, round(score / CASE WHEN dimension = 'tone_preservation' THEN 5 ELSE 3 END, 4) AS norm, text, threshold FROM t),
v AS (SELECT *, coalesce(round(norm, 2) >= round(threshold, 2), false) AS passed FROM r)"""


def _files_sql() -> str:
    from tallyforge.operators.evaluation import _CONSENT, _GAP

    return _FILES.replace('{consent}', _CONSENT).replace('{gap}', _GAP)


QUERIES = {
    "settings_scores": settings_scores,
    "task_file_scores": task_file_scores,
    "task_file_report": task_file_report,
    "corpus_lines": corpus_lines,
    "annotation_files": annotation_files,
}
ORACLES = {
    "settings_scores": _SCORES,
    "task_file_scores": f"{_files_sql()} SELECT file, task_id, dimension, error, score, norm, passed FROM v",
    "task_file_report": f"""{_files_sql()} SELECT count(*) AS total_files, 0 AS json_errors, count(*) FILTER (text = '') AS skipped_no_output, count(*) FILTER (text <> '' AND error IS NOT NULL) AS errors, count(*) FILTER (text <> '' AND error IS NULL) AS scored,
count(*) FILTER (passed) AS passed, count(*) FILTER (text <> '' AND error IS NULL AND NOT passed) AS failed, round(count(*) FILTER (passed) / nullif(count(*) FILTER (text <> '' AND error IS NULL), 0), 4) AS pass_at_1 FROM v""",
    "corpus_lines": """SELECT '{' || concat_ws(', ', '"event_type": "' || event_type || '"', '"value": ' || CAST(trunc(value) AS INT)) || '}' AS text, count(*) AS n FROM events GROUP BY 1""",
    "annotation_files": """WITH r AS (SELECT CASE WHEN quality IN (0, 1) THEN quality END AS rater_a1, CASE WHEN doc_id % 50 <> 0 THEN toxic END AS rater_b,
CASE WHEN doc_id % 50 = 0 THEN 'rater_b(invalid:''7'')' WHEN toxic IS NULL THEN 'rater_b' END AS b, CASE WHEN quality IS NULL THEN 'rater_a1' END AS a, CASE WHEN quality IS NULL THEN 'rater_a2' END AS c FROM labels),
w AS (SELECT rater_a1, rater_b, (a IS NOT NULL)::int + (b IS NOT NULL)::int + (c IS NOT NULL)::int AS missing, concat_ws(';', a, b, c) AS worst FROM r)
SELECT CAST(rater_a1 AS INT) AS rater_a1, CAST(rater_b AS INT) AS rater_b, count(*) AS tasks, CAST(sum(missing) AS BIGINT) AS missing, max(worst) AS worst FROM w GROUP BY 1, 2""",
}
