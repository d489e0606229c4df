"""Schemas compiled to Columns against plain checks, and facts of nested documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.json_schema import kind, parsed, rules, violations
from tallyforge.operators import json_documents as jd


def check(spark, schema, *bodies):
    df = spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    found = df.select("i", violations(parsed(F.col("body")), schema).alias("x")).orderBy("i").collect()
    return [[(v.path, v.rule) for v in r.x] for r in found]


def test_texts_that_are_no_json(spark):
    good = ["1", '"a"', "null", "[]", "{}", ' {"a": 1} ', "true", "1e3", "-0.5"]
    bad = ["", " ", "{", "1 2", "1, 2", '"a": 1', "1]", "1}", "1] [2", "1}, {", "nope", "[1,]", None, "}", "]"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    assert [r.ok for r in df.select(parsed(F.col("t")).isNotNull().alias("ok")).collect()] == [True] * len(good) + [False] * len(bad)


def test_kinds(spark):
    values = [None, True, 1, 1.0, 1.5, 10**25, "a", [], {}]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "t string")
    assert [r.k for r in df.select(kind(parsed(F.col("t"))).alias("k")).collect()] == ["null", "boolean", "integer", "integer", "number", "integer", "string", "array", "object"]


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"type": "integer"}, [1, 2.0], [1.5, "1", True, None, [1]]),
        ({"type": ["string", "null"]}, ["a", None], [1, {}]),
        ({"type": "number"}, [1, 1.5], [True, "1"]),
        ({"enum": ["a", 1, None, True, [1, 2], {"b": 1, "a": 2}]}, ["a", 1.0, None, True, [1, 2], {"a": 2, "b": 1}], ["b", 2, False, [2, 1]]),
        ({"const": 0}, [0, 0.0], [False, None, ""]),
        ({"pattern": "^a+$"}, ["aa", 5, None], ["b", "aab"]),
        ({"minLength": 2, "maxLength": 3}, ["éé", "abc", 7], ["a", "abcd"]),
        ({"minimum": 1, "exclusiveMaximum": 2}, [1, 1.99, "x"], [0.5, 2]),
        ({"exclusiveMinimum": 1, "maximum": 2}, [2, 1.5, None], [1, 3]),
        ({"multipleOf": 0.5}, [1, 1.5, "a"], [0.7]),
        ({"minItems": 1, "maxItems": 2}, [[1], [1, 2], "abc"], [[], [1, 2, 3]]),
        ({"uniqueItems": True}, [[1, 2], ["a"], {}], [[1, 1], [{"a": 1}, {"a": 1}]]),
        ({"minProperties": 1, "maxProperties": 2}, [{"a": 1}, []], [{}, {"a": 1, "b": 2, "c": 3}]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5, "type": "number"}]}, ["a", 6], [4, None]),
        ({"oneOf": [{"minimum": 5}, {"maximum": 7}]}, [4, 8], [6]),
        ({"allOf": [{"minimum": 5}, {"maximum": 7}]}, [6], [4, 8]),
        ({"not": {"type": "string"}}, [1], ["a"]),
    ],
)
def test_keywords(spark, schema, good, bad):
    found = check(spark, schema, *map(json.dumps, good), *map(json.dumps, bad))
    assert found[: len(good)] == [[]] * len(good)
    assert all(found[len(good) :])
    assert all(p == "$" for v in found for p, _ in v)


def test_paths_in_nested_documents(spark):
    schema = {
        "type": "object",
        "required": ["a", "odd name"],
        "additionalProperties": False,
        "properties": {
            "a": {"type": "array", "items": {"type": "object", "required": ["x"], "properties": {"x": {"type": "array", "items": {"type": "integer"}}}}},
            "odd name": {},
            "m": {"additionalProperties": {"type": "string"}},
            "never": False,
        },
    }
    found = check(spark, schema, {"a": [{"x": [1, "b"]}, {}, 3], "odd name": None, "m": {"k": "v", "l": 1}, "z": 1}, {"never": 0}, [], {"a": None, "odd name": 1})
    assert sorted(found[0]) == [("$", "additionalProperties: z"), ("$.a[0].x[1]", "type"), ("$.a[1]", "required: x"), ("$.a[2]", "type"), ("$.m.l", "type")]
    assert sorted(found[1]) == [("$", "required: a"), ("$", "required: odd name"), ("$.never", "false")]
    assert found[2] == [("$", "type")] and found[3] == [("$.a", "type")]
    assert set(rules(schema)) == {("$", "type"), ("$", "required: a"), ("$", "required: odd name"), ("$", "additionalProperties"), ("$.a", "type"), ("$.a[*]", "type"), ("$.a[*]", "required: x"), ("$.a[*].x", "type"), ("$.a[*].x[*]", "type"), ("$.m.*", "type"), ("$.never", "false")}


def test_unknown_keywords_are_told():
    with pytest.raises(ValueError, match="dependencies"):
        violations(F.parse_json(F.lit("1")), {"dependencies": {}})


def test_report_has_every_rule(spark):
    rows = spark.createDataFrame([(1, '{"task_id": "TB-SG-TR-0001"}'), (2, "broken"), (3, None), (1, "[]")], "file long, body string")
    got = {(r.path, r.rule): (r.documents, r["first"]) for r in jd.schema_report(rows).collect()}
    assert set(got) == {("$", "json"), *rules(jd.TASK_SCHEMA)}
    assert got["$", "json"] == (2, 2) and got["$", "type"] == (1, 1) and got["$", "required: rubric"] == (1, 1) and got["$.task_id", "pattern"] == (0, None)
    assert all(r.documents == 0 for r in jd.schema_report(rows.limit(0)).collect())


def flat(value, path="$"):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in flat(v, f"{path}.{k}")]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in flat(v, f"{path}[{i}]")]
    return [(path, value)]


def test_facts_of_any_depth(spark):
    rng = random.Random(2)

    def made(depth):
        pick = rng.random()
        if depth and pick < 0.35:
            return {f"k{i}": made(depth - 1) for i in range(rng.randint(0, 3))}
        if depth and pick < 0.6:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([None, True, False, 3, -7, 0.25, "text", "", "é"])

    docs = [(i, made(6)) for i in range(60)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs] + [(100, "broken"), (101, None)], "file long, body string")
    shown = lambda v: v if isinstance(v, str) else None if v is None else json.dumps(v)
    want = sorted((i, p, shown(v) or "") for i, d in docs for p, v in flat(d))
    assert sorted((r.file, r.path, r.value or "") for r in jd.facts(rows).collect()) == want
    assert jd.facts(rows.limit(0)).collect() == []
