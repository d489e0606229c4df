"""Scores follow the settings file; a pattern that is none gives error rows where a score meets it."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.rules import Rules, compiled, rules_of
from tallyforge.operators import scorer, settings_scores
from tallyforge.sources import readers, writers

TASKS = [
    (1, "consent_coordination", "Would you like a call?"),
    (2, "gap_framing", "We noticed a gap."),
    (3, "gap_framing", "You lack people."),
    (4, "tone_preservation", "A world-class offer, however small."),
    (5, "signal_grounding", "It appears to be early."),
    (6, "capacity_honesty", "Let me check."),
    (7, "extra", "short"),
    (8, None, "x"),
    (9, "gap_framing", "  "),
    (10, "gap_framing", None),
]


def scores(spark, settings=None, **more):
    rows = spark.createDataFrame(TASKS, "id int, dimension string, text string")
    empty = rows.selectExpr("*", "cast(null as array<string>) behaviours", "cast(null as string) role", "cast(null as array<struct<stack: string, count: bigint>>) roles")
    return {r["id"]: (r["score"], r["error"]) for r in scorer.score_tasks(empty, settings, **more).collect()}


def table(spark, rows):
    return spark.createDataFrame([(s, i, e) for i, (s, e) in enumerate(rows)], "section string, place long, entry string")


def test_built_in_values(spark):
    got = scores(spark)
    assert [got[i][0] for i in range(1, 7)] == [2, 3, 0, 0, 1, 2]
    assert [got[i][1] for i in range(7, 11)] == ["unknown_dimension: extra", "missing_dimension", "empty_candidate", "empty_candidate"]


def test_scores_change_with_the_file(spark, tmp_path):
    path = f"file://{tmp_path}/settings"
    writers.write_settings(table(spark, [("question_framing_patterns", r"\black\b"), ("banned_phrases", "small."), ("bench_external_ban", "c++"), ("hedge_patterns", "early")]), path)
    got = scores(spark, readers.read_settings(spark, path))
    assert [got[i][0] for i in range(1, 7)] == [0, 1, 3, 0, 1, 0]


def test_broken_patterns(spark):
    late = scores(spark, table(spark, [("question_framing_patterns", "noticed"), ("question_framing_patterns", "(unclosed"), ("question_framing_patterns", "gap"), ("accusatory_patterns", "lack")]))
    assert late[2] == (3, None) and late[3] == (0, None)
    early = scores(spark, table(spark, [("question_framing_patterns", "[a"), ("question_framing_patterns", "noticed"), ("hedge_patterns", "appears"), ("hedge_patterns", "*"), ("escalation_patterns", "(?P<x>a)"), ("condescending_patterns", "("), ("banned_phrases", "world")]))
    assert early[2] == (None, "bad_pattern: question_framing_patterns: [a")
    assert early[3] == (None, "bad_pattern: question_framing_patterns: [a")
    assert early[5] == (None, "bad_pattern: hedge_patterns: *")
    # a named group in Python's form is none that the JVM knows
    assert early[6] == (None, "bad_pattern: escalation_patterns: (?P<x>a)")
    assert early[4] == (0, None), "a banned phrase is met before the broken pattern"
    assert early[9][1] == "empty_candidate"


def test_own_dimensions_and_thresholds(spark):
    own = scorer.DIMENSIONS | {"extra": scorer.Dimension(5, lambda r: F.length("text").cast("int"), lambda r: F.lit(None).cast("string"))}
    rows = spark.createDataFrame([(1, "extra", "short", 1.0), (2, "extra", "no", 0.4), (3, "extra", "no", None)], "id int, dimension string, text string, t double")
    rows = rows.selectExpr("*", "cast(null as array<string>) behaviours", "cast(null as string) role", "cast(null as array<struct<stack: string, count: bigint>>) roles")
    got = {r["id"]: (r["score"], r["passed"]) for r in scorer.score_tasks(rows, threshold=F.col("t"), dimensions=own).collect()}
    assert got == {1: (5, True), 2: (2, True), 3: (2, False)}


def test_empty_and_null_settings(spark):
    assert rules_of(table(spark, [])).sections == {}
    assert rules_of(table(spark, [(None, "a"), ("x", None), ("x", ""), ("x", "b")])).sections == {"x": ("b",)}
    assert [scores(spark, Rules({}))[i][0] for i in range(1, 7)] == [0, 1, 1, 4, 0, 0]
    assert compiled(spark, {"banned_phrases": ["(", "["]}).broken == {}


def test_batch_report(spark):
    rows = spark.createDataFrame([("x", None, None, None), (None, "a", None, True), (None, "a", None, False), (None, "a", "bad", None), (None, None, "empty", None), (None, "", None, None)], "file_error string, text string, error string, passed boolean")
    got = settings_scores.batch_report(rows).first()
    assert tuple(got) == (6, 1, 2, 1, 2, 1, 1, 0.5)
    assert tuple(settings_scores.batch_report(rows.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0, None)


@pytest.mark.parametrize("text", ["{broken", '{"task_id": "t", "dimension": "gap_framing", "candidate_output": "We noticed a gap.", "rubric": {"pass_threshold": 0.9}}'])
def test_files_to_scores(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    got = scorer.score_tasks(settings_scores.file_columns(readers.read_tasks(spark, str(tmp_path))), threshold=F.col("threshold")).first()
    assert (got["task_id"], got["file_error"], got["passed"]) == ("t", "invalid_json" if text == "{broken" else None, text != "{broken")
