"""Audits on nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import task_audits as ta

TASK = "task_id string, dimension string, source_mode string, partition string, input_keys array<string>, confidence double, roles boolean, max_score int, threshold double, scored array<string>"
KEYS = list(ta.INPUT_KEYS)


def report(spark, rows, **more):
    return {r.check: (r.violations, r.sample) for r in ta.field_checks(spark.createDataFrame(rows, TASK), **more).collect()}


def test_field_checks(spark):
    good = ("a", "gap_framing", "programmatic", "train", [*KEYS, "more"], 0.0, True, 3, 1.0, ["x"])
    assert all(report(spark, [good])[c][0] == 0 for c in ("input_keys", "confidence_range", "available_roles", "max_score_least", "max_score_fixed", "threshold_range", "dimensions_scored", "partition_sum"))
    bad = ("b", "gap_framing", "programmatic", "other", KEYS[:2], 1.1, False, 0, 0.0, [])
    nulls = (None,) * 10
    odd = ("c", "unknown", None, "dev", KEYS, 1.0, True, 9, 0.5, ["x"])
    got = report(spark, [good, bad, nulls, odd, bad])
    assert got["input_keys"] == (3, "b") and got["confidence_range"][0] == 3 and got["available_roles"][0] == 3 and got["max_score_least"][0] == 3
    assert got["max_score_fixed"] == (2, "b"), "unknown dimensions have no fixed score"
    assert got["threshold_range"][0] == 3 and got["dimensions_scored"][0] == 3 and got["partition_sum"] == (3, "b")
    assert got["partition_present"] == (1, "held_out")
    assert got["cell_filled"][0] == 17 and got["known_gap"] == (0, "capacity_honesty/programmatic")
    empty = report(spark, [])
    assert empty["partition_present"] == (3, "dev") and empty["cell_filled"][0] == 17 and empty["input_keys"] == (0, None)
    assert report(spark, [], gaps=(("gap_framing", "hand_authored"),))["cell_filled"][0] == 19


def test_decoded_ids(spark):
    rows = spark.createDataFrame([("TB-SG-TR-0001",), ("TB-XX-YY",), ("TB",), ("",), (None,)], "task_id string")
    assert [(r[1], r[2], r[3]) for r in ta.decoded_ids(rows).collect()] == [("SG", "signal_grounding", "trace_derived"), ("XX", "Unknown", "Unknown"), *[(None, "Unknown", "Unknown")] * 3]


@pytest.mark.parametrize(
    "body, want",
    [
        ('{"hiring_signal_brief": {"company": "A", "open_role": null, "signal_source": 3}, "prospect_context": {"company": true, "sector": "x y"}}', "A None 3 True x y"),
        ('{"hiring_signal_brief": []}', "    "),
        ("broken", "    "),
        (None, "    "),
        ('{"prospect_context": {"sector": 1.5}}', "    1.5"),
    ],
)
def test_dedup_key(spark, body, want):
    assert spark.createDataFrame([(body,)], "b string").select(ta.dedup_key(F.col("b"))).first()[0] == want


def test_judged(spark):
    rows = spark.createDataFrame([(1, True, 1), (2, False, 9), (3, None, 7), (4, None, 6), (5, None, None), (6, True, None)], "id int, stated boolean, total int")
    got = {r.id: (r.verdict, r.judge and tuple(r.judge)) for r in ta.judged(rows, "m").collect()}
    assert got == {1: (True, ("m", 1, True)), 2: (False, None), 3: (True, ("m", 7, True)), 4: (False, None), 5: (None, None), 6: (True, ("m", None, True))}
    assert ta.judged(rows.limit(0), "m").count() == 0


def test_traces_losses_and_costs(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0, True), ("a", 3.0, None, None), ("b", None, 1.0, False)], "g string, d double, c double, ok boolean")
    assert {tuple(r) for r in ta.trace_summary(rows, "g", "d", "c", F.col("ok")).collect()} == {("a", 2, 0.5, 2.0, 2.0, 2.9), ("b", 1, 0.0, 1.0, None, None)}
    loss = {r.g: (r.loss, r.place, r.in_top, r.share, r.total_loss) for r in ta.loss_report(spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 1.0), ("c", 0.0, 5.0), ("d", None, 1.0), ("e", 0.5, 12.0)], "g string, r double, c double"), "g", "r", "c", 3).collect()}
    assert loss == {"e": (6.0, 1, True, 0.6, 10.0), "a": (2.0, 2, True, 0.2, 10.0), "b": (2.0, 2, True, 0.2, 10.0), "c": (0.0, 4, False, 0.0, 10.0), "d": (None, 5, False, None, 10.0)}
    costs = spark.createDataFrame([("base", 3.0, 0.5), ("other", 4.5, 0.9), ("free", 0.0, 0.1), (None, None, None)], "name string, cost double, quality double")
    got = {r.name: tuple(r)[3:] for r in ta.cost_table(costs, 5, 3, "base").collect()}
    assert got == {"base": (0.2, 0.0, 0.0, 0.166667), "other": (0.3, 0.1, 50.0, 0.2), "free": (0.0, -0.2, -100.0, None), None: (None, None, None, None)}
    assert {r.name: r.delta_pct for r in ta.cost_table(costs, 0, 3, "free").collect()}["other"] == 0.0
    assert all(r.delta is None for r in ta.cost_table(costs, 5, 3, "nobody").collect())
    for made in (ta.trace_summary(rows.limit(0), "g", "d", "c", F.col("ok")), ta.loss_report(rows.limit(0), "g", "d", "c"), ta.cost_table(costs.limit(0), 1, 1, "base")):
        assert made.count() == 0


def test_pairs(spark):
    rows = spark.createDataFrame([("1", "x", "good", "bad"), ("2", "x", None, "fine"), ("3", "x", "bad", None), ("4", "y", "z", "z"), (None, None, " ", "")], "pair_id string, dimension string, chosen string, rejected string")
    got = {r.dimension: tuple(r)[1:] for r in ta.pair_content(rows, {"x": "good"}, {"x": "bad"}).collect()}
    assert got == {"x": (3, 2, 1, 2), "y": (1, 0, 0, 0), None: (1, 0, 0, 0)}
    assert tuple(ta.pair_structure(rows).first()) == (5, 1, 1, 2, 2)
    assert tuple(ta.pair_structure(rows.limit(0)).first()) == (0, 0, 0, 0, 0)
