"""The examples of the description, nulls and empty tables."""

import dataclasses

import pytest

from tallyforge.operators.maturity import KEYWORDS, WEIGHTS, Config, score_maturity

SCHEMA = "roles array<string>, cto_name string, cto_tenure_days int, description string, industry string, recent_news string"
THREE = ["ML Engineer", "Data Scientist", "AI Lead"]


def score(spark, row, config=Config()):
    r = score_maturity(spark.createDataFrame([row], SCHEMA), config).first()
    return r.score, r.confidence, {s.signal_name: s for s in r.signal_breakdown}


def test_all_signals(spark):
    s, c, found = score(spark, (THREE, "Jane Doe", 30, "mlops platform for model deployment", "artificial intelligence", "CEO announces llm strategy"))
    assert s == 3 and c >= 0.85
    assert set(found) == set(WEIGHTS) and [found[n].detected for n in WEIGHTS] == [True] * 5 + [False]


@pytest.mark.parametrize(
    "row, score_, confidence",
    [
        ((THREE, "", None, "", "", ""), 2, None),
        ((["ML Engineer"], "", None, "", "", ""), 1, None),
        ((THREE, "Jane Doe", 30, "", "", ""), 3, 0.85),
        ((["ML Engineer"], "", None, "", "artificial intelligence", "CEO announces ai strategy"), 3, 0.70),
        (([], "", None, "ai-powered platform with mlops pipeline", "software", ""), 0, 0.5),
        ((None,) * 6, 0, 0.3),
        (([], " ", 5, "", "", "said again"), 0, 0.3),
    ],
)
def test_examples(spark, row, score_, confidence):
    s, c, found = score(spark, row)
    assert s == score_ and (confidence is None or c == confidence)
    if row[0] == THREE:
        assert found["ai_adjacent_roles"].confidence == 0.9
    if row[0] == ["ML Engineer"]:
        assert found["ai_adjacent_roles"].confidence == 0.7


def test_changes_of_the_configuration(spark):
    row = ([], "Jane Doe", 75, "", "", "Company launches ChatGPT integration")
    s, _, found = score(spark, row)
    assert found["named_ai_leadership"].detected and not found["executive_commentary"].detected and s == 1
    other = Config(keywords=KEYWORDS | {"executive_commentary": ("chatgpt",)}, tenure_days=60)
    s, _, found = score(spark, row, other)
    assert not found["named_ai_leadership"].detected and found["executive_commentary"].detected and s == 1
    assert score(spark, row, dataclasses.replace(other, keywords={}))[0] == 0


def test_empty_table(spark):
    assert score_maturity(spark.createDataFrame([], SCHEMA)).count() == 0
