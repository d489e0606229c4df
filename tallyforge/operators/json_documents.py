"""Raw JSON documents: validated by a schema, and taken apart into facts by path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.functions.json_schema import parsed, rules, violations
from tallyforge.operators.invariants import DIFFICULTIES, DIMENSIONS, MODES, TASK_ID, claim_check
from tallyforge.storage import kept

# What a task must have.
TASK_SCHEMA = {
    "type": "object",
    "required": ["task_id", "dimension", "difficulty", "source_mode", "probe_refs", "input", "candidate_output", "ground_truth", "rubric", "metadata"],
    "properties": {
        "task_id": {"type": "string", "pattern": TASK_ID},
        "dimension": {"type": "string", "enum": list(DIMENSIONS)},
        "difficulty": {"type": "string", "enum": list(DIFFICULTIES)},
        "source_mode": {"type": "string", "enum": list(MODES)},
        "probe_refs": {"type": "array", "items": {"type": "string"}, "minItems": 1},
        "trace_refs": {"type": "array", "items": {"type": "string"}},
        "input": {"type": "object", "required": ["hiring_signal_brief", "bench_summary_snapshot", "prospect_context"]},
        "candidate_output": {},
        "ground_truth": {"type": "object", "required": ["expected_behaviors", "forbidden_behaviors"]},
        "rubric": {"type": "object", "required": ["max_score", "pass_threshold", "dimensions_scored"]},
        "metadata": {"type": "object", "required": ["created_at", "author_model", "judge_model", "judge_score", "partition"]},
    },
}


def schema_violations(documents: DataFrame, schema: dict = TASK_SCHEMA) -> DataFrame:
    """file, path, rule and value of everything in ``documents`` (file, body) that breaks the schema.

    A body that is no JSON, null or empty breaks the one rule ``json`` at ``$``. Repeated rows give
    their violations each.
    """
    rows = documents.select("file", parsed(F.col("body")).alias("v"), "body")
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"), F.substring("body", 1, 80).alias("value")))
    found = F.when(F.col("v").isNull(), broken).otherwise(violations(F.col("v"), schema))
    return rows.select("file", F.explode(found).alias("x")).select("file", "x.path", "x.rule", "x.value")


def schema_report(documents: DataFrame, schema: dict = TASK_SCHEMA) -> DataFrame:
    """One row for each rule of the schema, and ``json``: path, rule, documents that break it, and the first of them.

    Places of arrays are one path ``[*]``.
    """
    found = schema_violations(documents, schema).withColumn("path", F.regexp_replace("path", r"\[\d+\]", "[*]"))
    counts = found.groupBy("path", "rule").agg(F.countDistinct("file").alias("documents"), F.min("file").alias("first"))
    asked = documents.sparkSession.createDataFrame(list(dict.fromkeys([("$", "json"), *rules(schema)])), "path string, rule string")
    return asked.join(counts, ["path", "rule"], "left").select("path", "rule", F.coalesce("documents", F.lit(0)).alias("documents"), "first")


def facts(documents: DataFrame) -> DataFrame:
    """file, path, value and kind of every scalar in ``documents`` (file, body), of any depth.

    Fields are ``.name``, elements ``[0]`` and on. Strings are given as they are, other values as JSON;
    a JSON null has a null value. Empty objects and arrays are facts with the values ``{}`` and ``[]``.
    Bodies that are no JSON have none. One pass a level, which is kept; the passes are as many as the
    deepest document has levels.
    """
    level = kept(documents.select("file", F.lit("$").alias("path"), parsed(F.col("body")).alias("v")).where("v is not null"))
    out = []
    while True:
        name = F.schema_of_variant("v")
        fields, items = F.try_variant_get("v", "$", "map<string,variant>"), F.try_variant_get("v", "$", "array<variant>")
        is_object, is_array = F.startswith(name, F.lit("OBJECT")), F.startswith(name, F.lit("ARRAY"))
        inner = (is_object & (F.size(fields) > 0)) | (is_array & (F.size(items) > 0))
        kind = F.when(is_object, "object").when(is_array, "array").when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").otherwise("number")
        value = F.when(name == "STRING", F.try_variant_get("v", "$", "string")).when(name != "VOID", F.to_json("v"))
        out.append(level.where(~inner).select("file", "path", value.alias("value"), kind.alias("kind")))
        kids = F.when(is_object, F.transform(F.map_entries(fields), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("step"), e["value"].alias("v")))).otherwise(
            F.transform(items, lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("step"), x.alias("v")))
        )
        deeper = level.where(inner).select("file", "path", F.explode(kids).alias("k")).select("file", F.concat("path", "k.step").alias("path"), F.col("k.v").alias("v"))
        level = kept(deeper)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task in JSON for every document, with faults that follow from its id, length and language."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("id"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n"), "lang")
    pick = lambda c, *values: F.get(F.array(*map(F.lit, values)), F.pmod(c, F.lit(len(values))).cast("int"))
    id_, n = F.col("id"), F.col("n")
    number = F.lpad(F.substring(id_.cast("string"), 1, 4), 4, "0")
    task_id = F.when(id_ % 5 == 0, F.concat(F.lit('"task_id": '), id_.cast("string"))).when(id_ % 5 == 1, F.concat(F.lit('"task_id": "TB-SG-TR-'), number, F.lit('"'))).when(id_ % 5 == 2, F.concat(F.lit('"task_id": "bad-'), id_.cast("string"), F.lit('"'))).when(id_ % 5 == 3, F.lit('"task_id": null'))
    level = F.when(F.col("lang") == "en", '"difficulty": "easy"').when(F.col("lang") == "de", '"difficulty": "hard"').when(F.col("lang") == "fr", '"difficulty": "tough"').when(F.col("lang") == "es", '"difficulty": ["easy"]')
    fields = F.array_compact(F.array(
        task_id,
        F.concat(F.lit('"dimension": '), pick(id_, *[f'"{x}"' for x in DIMENSIONS], '"other"', "3")),
        level,
        F.when(n % 2 == 0, '"source_mode": "programmatic"').otherwise('"source_mode": "x"'),
        F.concat(F.lit('"probe_refs": '), pick(n, "[]", '["P1"]', '["P1", 5]', '"P1"')),
        pick(n, None, '"trace_refs": []', '"trace_refs": [null]'),
        F.concat(F.lit('"input": '), pick(id_, "{}", '{"hiring_signal_brief": {"signal_confidence": 0.5}, "prospect_context": ""}', '{"hiring_signal_brief": {}, "bench_summary_snapshot": {"available_roles": [{"stack": "go", "count": 2}]}, "prospect_context": null}', "[]")),
        F.when(id_ % 6 != 0, '"candidate_output": null'),
        F.concat(F.lit('"ground_truth": '), pick(id_, '{"expected_behaviors": []}', '{"expected_behaviors": ["asks"], "forbidden_behaviors": []}', '"x"')),
        F.concat(F.lit('"rubric": {"max_score": '), F.pmod(n, F.lit(4)).cast("string"), pick(n, "", ', "pass_threshold": 0.7', ', "pass_threshold": 0.7, "dimensions_scored": ["tone"]'), F.lit("}")),
        F.concat(F.lit('"metadata": '), pick(id_, '{"created_at": "2024-01-01", "author_model": "a", "judge_model": "b", "judge_score": 1.5, "partition": "dev"}', "null", '{"partition": "dev"}')),
    ))
    whole = F.concat(F.lit("{"), F.array_join(fields, ", "), F.lit("}"))
    return d.select(F.col("id").alias("file"), F.when(id_ % 17 == 0, F.substring(whole, F.lit(2), F.length(whole))).otherwise(whole).alias("body"))


def task_schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_report(_documents(spark, sf_dir))


def json_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the facts of all documents: how many each path has, how many values, and the smallest and largest."""
    found = facts(_documents(spark, sf_dir)).withColumn("path", F.regexp_replace("path", r"\[\d+\]", "[*]"))
    return found.where(F.col("path") != "$.task_id").groupBy("path", "kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("values"), F.min("value").alias("least"), F.max("value").alias("most"))


def json_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What labels claim of the tasks' highest scores, checked on the raw documents: quality 1 claims 3, quality 0 claims 1."""
    claims = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("claim"), F.col("doc_id").cast("long").alias("source"), F.lit("$.rubric.max_score").alias("field"), F.when(F.col("quality") == 1, "3").when(F.col("quality") == 0, "1").alias("value"))
    known = facts(_documents(spark, sf_dir)).withColumnsRenamed({"file": "source", "path": "field"})
    return claim_check(claims, known)


_D = "WITH d AS (SELECT doc_id AS id, coalesce(n_chars, 0) AS n, lang, doc_id % 17 = 0 AS broken FROM documents), g AS (SELECT * FROM d WHERE NOT broken)"
_RULES = {
    ("$", "type"): "false",
    ("$", "required: task_id"): "id % 5 = 4", ("$", "required: dimension"): "false", ("$", "required: difficulty"): "coalesce(lang NOT IN ('en', 'de', 'fr', 'es'), true)",
    ("$", "required: source_mode"): "false", ("$", "required: probe_refs"): "false", ("$", "required: input"): "false", ("$", "required: candidate_output"): "id % 6 = 0",
    ("$", "required: ground_truth"): "false", ("$", "required: rubric"): "false", ("$", "required: metadata"): "false",
    ("$.task_id", "type"): "id % 5 IN (0, 3)", ("$.task_id", "pattern"): "id % 5 = 2",
    ("$.dimension", "type"): "id % 7 = 6", ("$.dimension", "enum"): "id % 7 IN (5, 6)",
    ("$.difficulty", "type"): "coalesce(lang = 'es', false)", ("$.difficulty", "enum"): "coalesce(lang IN ('fr', 'es'), false)",
    ("$.source_mode", "type"): "false", ("$.source_mode", "enum"): "n % 2 = 1",
    ("$.probe_refs", "type"): "n % 4 = 3", ("$.probe_refs", "minItems"): "n % 4 = 0", ("$.probe_refs[*]", "type"): "n % 4 = 2",
    ("$.trace_refs", "type"): "false", ("$.trace_refs[*]", "type"): "n % 3 = 2",
    ("$.input", "type"): "id % 4 = 3", ("$.input", "required: hiring_signal_brief"): "id % 4 = 0", ("$.input", "required: bench_summary_snapshot"): "id % 4 IN (0, 1)", ("$.input", "required: prospect_context"): "id % 4 = 0",
    ("$.ground_truth", "type"): "id % 3 = 2", ("$.ground_truth", "required: expected_behaviors"): "false", ("$.ground_truth", "required: forbidden_behaviors"): "id % 3 = 0",
    ("$.rubric", "type"): "false", ("$.rubric", "required: max_score"): "false", ("$.rubric", "required: pass_threshold"): "n % 3 = 0", ("$.rubric", "required: dimensions_scored"): "n % 3 < 2",
    ("$.metadata", "type"): "id % 3 = 1", **{("$.metadata", f"required: {k}"): "id % 3 = 2" for k in ("created_at", "author_model", "judge_model", "judge_score")}, ("$.metadata", "required: partition"): "false",
}
#: (path, kind, value, condition) of the facts that a document can have.
_FACTS = [
    *[("$.dimension", "string", f"'{x}'", f"id % 7 = {i}") for i, x in enumerate([*DIMENSIONS, "other"])], ("$.dimension", "number", "'3'", "id % 7 = 6"),
    ("$.difficulty", "string", "'easy'", "lang = 'en'"), ("$.difficulty", "string", "'hard'", "lang = 'de'"), ("$.difficulty", "string", "'tough'", "lang = 'fr'"), ("$.difficulty[*]", "string", "'easy'", "lang = 'es'"),
    ("$.source_mode", "string", "CASE WHEN n % 2 = 0 THEN 'programmatic' ELSE 'x' END", "true"),
    ("$.probe_refs", "array", "'[]'", "n % 4 = 0"), ("$.probe_refs[*]", "string", "'P1'", "n % 4 IN (1, 2)"), ("$.probe_refs[*]", "number", "'5'", "n % 4 = 2"), ("$.probe_refs", "string", "'P1'", "n % 4 = 3"),
    ("$.trace_refs", "array", "'[]'", "n % 3 = 1"), ("$.trace_refs[*]", "null", "NULL", "n % 3 = 2"),
    ("$.input", "object", "'{}'", "id % 4 = 0"), ("$.input", "array", "'[]'", "id % 4 = 3"), ("$.input.hiring_signal_brief.signal_confidence", "number", "'0.5'", "id % 4 = 1"), ("$.input.prospect_context", "string", "''", "id % 4 = 1"),
    ("$.input.hiring_signal_brief", "object", "'{}'", "id % 4 = 2"), ("$.input.bench_summary_snapshot.available_roles[*].stack", "string", "'go'", "id % 4 = 2"), ("$.input.bench_summary_snapshot.available_roles[*].count", "number", "'2'", "id % 4 = 2"), ("$.input.prospect_context", "null", "NULL", "id % 4 = 2"),
    ("$.candidate_output", "null", "NULL", "id % 6 <> 0"),
    ("$.ground_truth.expected_behaviors", "array", "'[]'", "id % 3 = 0"), ("$.ground_truth.expected_behaviors[*]", "string", "'asks'", "id % 3 = 1"), ("$.ground_truth.forbidden_behaviors", "array", "'[]'", "id % 3 = 1"), ("$.ground_truth", "string", "'x'", "id % 3 = 2"),
    ("$.rubric.max_score", "number", "CAST(n % 4 AS VARCHAR)", "true"), ("$.rubric.pass_threshold", "number", "'0.7'", "n % 3 > 0"), ("$.rubric.dimensions_scored[*]", "string", "'tone'", "n % 3 = 2"),
    ("$.metadata.created_at", "string", "'2024-01-01'", "id % 3 = 0"), ("$.metadata.author_model", "string", "'a'", "id % 3 = 0"), ("$.metadata.judge_model", "string", "'b'", "id % 3 = 0"), ("$.metadata.judge_score", "number", "'1.5'", "id % 3 = 0"),
    ("$.metadata.partition", "string", "'dev'", "id % 3 IN (0, 2)"), ("$.metadata", "null", "NULL", "id % 3 = 1"),
]

QUERIES = {"task_schema_report": task_schema_report, "json_facts": json_facts, "json_claims": json_claims}
ORACLES = {
    "task_schema_report": f"{_D} SELECT '$' AS path, 'json' AS rule, count(*) FILTER (broken) AS documents, min(id) FILTER (broken) AS first FROM d UNION ALL "
    + " UNION ALL ".join(f"SELECT '{p}', '{r}', count(*) FILTER ({c}), min(id) FILTER ({c}) FROM g" for (p, r), c in _RULES.items()),
    "json_facts": f"{_D}, f AS ({' UNION ALL '.join(f'''SELECT '{p}' AS path, '{k}' AS kind, {v} AS value FROM g WHERE {c}''' for p, k, v, c in _FACTS)}) SELECT path, kind, count(*) AS n, count(DISTINCT value) AS values, min(value) AS least, max(value) AS most FROM f GROUP BY ALL",
    "json_claims": f"{_D}, c AS (SELECT doc_id, CASE quality WHEN 1 THEN '3' WHEN 0 THEN '1' END AS value FROM labels) SELECT c.doc_id AS claim, c.value, CAST(g.n % 4 AS VARCHAR) AS found, coalesce(c.value = CAST(g.n % 4 AS VARCHAR), false) AS verified FROM c LEFT JOIN g ON g.id = c.doc_id",
}
