"""Readers of the file formats of evaluation data: JSON, JSON lines, CSV with comments, and Markdown.

Files are read by Spark's readers, so that a path may be in any store that Spark opens. Small files
whose lines have numbers (CSV, Markdown) are read a file a row and cut into numbered lines.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ROLE = "array<struct<stack:string,count:bigint>>"
#: Tasks of an evaluation set; fields that it doesn't name are left out.
TASK = (
    "task_id string, dimension string, difficulty string, source_mode string, probe_refs array<string>, trace_refs array<string>, "
    f"input struct<hiring_signal_brief:struct<open_role:string,signal_confidence:double>,bench_summary_snapshot:struct<available_roles:{ROLE},capacity_locked_until:string>,prospect_context:string>, "
    "candidate_output string, ground_truth struct<expected_behaviors:array<string>,forbidden_behaviors:array<string>>, "
    "rubric struct<max_score:int,pass_threshold:double,dimensions_scored:array<string>>, "
    "metadata struct<created_at:string,author_model:string,judge_model:string,judge_score:double,partition:string,bench_snapshot_jittered:boolean>"
)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, place (from 0) and line of text files; a file is one row before it is cut."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("place", "line"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON file, by file name: file, the columns of ``TASK``, and error.

    A file that isn't JSON gives a row with nulls and the error ``invalid_json``.
    """
    rows = spark.read.schema(f"{TASK}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    names = [c for c in rows.columns if c not in ("file", "_corrupt")]
    return rows.select("file", *names, F.when(F.col("_corrupt").isNotNull(), "invalid_json").alias("error")).orderBy("file")


def read_partitions(spark: SparkSession, root: str, names: tuple[str, ...] = ("train", "dev", "held_out")) -> DataFrame:
    """Tasks of the partitions that are there, in this order of names and by file name, with ``partition`` and ``rank``."""
    out = None
    for rank, name in enumerate(names):
        if _exists(spark, f"{root}/{name}"):
            part = read_tasks(spark, f"{root}/{name}").withColumn("partition", F.lit(name)).withColumn("rank", F.lit(rank))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"no partition below {root}")
    return out.orderBy("rank", "file")


def canonical_json(text: Column) -> Column:
    """Valid JSON with one space after commas and colons and ASCII escapes, other texts as they are."""

    @F.pandas_udf("string")
    def dumped(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return json.dumps(json.loads(v))
            except (TypeError, ValueError):
                return v

        return values.map(one)

    return dumped(text)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """text of every line of a JSON lines file that isn't blank, JSON in one form."""
    return spark.read.text(path).where(F.col("value").rlike(r"\S")).select(canonical_json(F.trim("value")).alias("text"))


def read_annotations(spark: SparkSession, path: str, raters: tuple[str, ...] = ("rater_a1", "rater_b", "rater_a2")) -> DataFrame:
    """task_id, dimension, a column a rater (0, 1 or null), row_num and missing_cols of annotated tasks.

    ``row_num`` counts the lines that aren't blank, the header being 1; rows whose task_id begins with
    # are counted and left out. A missing file and missing columns are errors that name them.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    lines = numbered_lines(spark, path).where(F.col("line").rlike(r"\S"))
    lines = lines.withColumn("row_num", F.row_number().over(Window.partitionBy("file").orderBy("place")))
    header = lines.where("row_num = 1").select("line").first()
    names = [c.strip().strip('"') for c in header[0].split(",")] if header else []
    lacking = [c for c in ("task_id", "dimension", *raters) if c not in names]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    made = lines.where("row_num > 1").select("row_num", F.from_csv("line", ", ".join(f"`{n}` string" for n in names)).alias("x")).select("row_num", "x.*")
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    value = lambda c: F.when(text(c).isin("0", "1"), text(c).cast("int"))
    said = lambda c: F.when(text(c) == "", F.lit(c)).when(value(c).isNull(), F.concat(F.lit(f"{c}(invalid:'"), text(c), F.lit("')")))
    rows = made.where(~F.startswith(text("task_id"), F.lit("#")))
    return rows.select(text("task_id").alias("task_id"), text("dimension").alias("dimension"), *[value(c).alias(c) for c in raters], "row_num", F.array_compact(F.array(*map(said, raters))).alias("missing_cols"))


def read_commented(spark: SparkSession, path: str) -> DataFrame:
    """file, place, line and comment of a CSV file; sorted by comment first, place, it is what a rewrite keeps."""
    return numbered_lines(spark, path).where(F.col("line") != "").withColumn("comment", F.startswith(F.ltrim("line"), F.lit("#")))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """section, place and entry of a Markdown file: ``## `` begins a section, other # lines are comments.

    Blank lines and lines before any section are left out; of banned phrases only what stands before
    the first pipe is kept.
    """
    lines = numbered_lines(spark, path).withColumn("line", F.trim("line"))
    begins = F.when(F.startswith("line", F.lit("## ")), F.trim(F.substring("line", 4, 1 << 30)))
    filled = lines.withColumn("section", F.last(begins, ignorenulls=True).over(Window.partitionBy("file").orderBy("place")))
    rows = filled.where("section is not null and line <> ''").where(~F.startswith("line", F.lit("#")))
    return rows.select("section", "place", F.when(F.col("section") == "banned_phrases", F.trim(F.split("line", r"\|")[0])).otherwise(F.col("line")).alias("entry"))


def read_probe_ids(spark: SparkSession, path: str) -> DataFrame:
    """place and probe of the headings that begin with ``## P-``."""
    lines = numbered_lines(spark, path).where(F.startswith("line", F.lit("## P-")))
    return lines.select("place", F.regexp_replace(F.trim("line"), r"^[# ]+|[# ]+$", "").alias("probe"))


def _first_number(text: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(text, p).try_cast("double") for p in paths])


def read_trial_scores(spark: SparkSession, path: str) -> DataFrame:
    """run (a folder) and score of trial results below ``path``, a folder of runs.

    The first of pass_rate, reward, score and pass@1 in results.json, else of the first three in its
    ``results``; else the mean over task_*.json and *_result.json of reward, else score, else 0, a file
    of both patterns twice; else 0.
    """
    files = spark.read.text(f"{path}/*/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    files = files.select(F.element_at(F.split("path", "/"), -2).alias("run"), F.element_at(F.split("path", "/"), -1).alias("name"), "value")
    keys = ("pass_rate", "reward", "score")
    top = F.when(F.col("name") == "results.json", _first_number(F.col("value"), *[f"$.{k}" for k in keys], "$['pass@1']", *[f"$.results.{k}" for k in keys]))
    valid = F.get_json_object("value", "$").isNotNull()
    task = F.when(valid, F.coalesce(_first_number(F.col("value"), "$.reward", "$.score"), F.lit(0.0)))
    times = F.startswith("name", F.lit("task_")).cast("int") + F.endswith("name", F.lit("_result.json")).cast("int")
    sums = files.groupBy("run").agg(F.max(top).alias("top"), F.sum(task * times).alias("sum"), F.sum(F.when(task.isNotNull(), times)).alias("n"))
    return sums.select("run", F.coalesce("top", F.try_divide("sum", "n"), F.lit(0.0)).alias("score"))


def reference_values(text: Column, defaults: dict[str, float]) -> Column:
    """pass_at_1, ci_lower and ci_upper of a reference in one of three shapes, with defaults.

    A list stands for its first element. ``ci`` is looked at first, then ``conditions.baseline``, then
    the object itself; what isn't JSON gives the defaults.
    """
    one = F.coalesce(F.get_json_object(text, "$[0]"), text)
    has = lambda p: F.get_json_object(one, p).isNotNull()

    def value(name: str, ci: str, baseline: str) -> Column:
        found = F.when(has("$.ci"), _first_number(one, ci)).when(has("$.conditions.baseline"), _first_number(one, baseline)).otherwise(_first_number(one, f"$.{name}"))
        return F.coalesce(found, F.lit(defaults[name])).alias(name)

    return F.struct(value("pass_at_1", "$.ci.mean", "$.conditions.baseline.pass_at_1"), value("ci_lower", "$.ci.ci_lower", "$.conditions.baseline.ci_95[0]"), value("ci_upper", "$.ci.ci_upper", "$.conditions.baseline.ci_95[1]"))


def task_text(task_id: Column, dimension: Column, truth: Column, given: Column) -> Column:
    """The text of a task that is compared with a corpus: its id, dimension and two JSON texts."""
    return F.concat_ws(" ", task_id, dimension, canonical_json(truth), canonical_json(given))
