"""Readers and writers on small files, with broken, empty and commented ones, and the probe stream."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import readers, writers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_tasks_and_partitions(spark, tmp_path):
    task = {"task_id": "a", "dimension": "gap_framing", "probe_refs": ["P-1"], "input": {"bench_summary_snapshot": {"available_roles": [{"stack": "go", "count": 2}]}}, "rubric": {"pass_threshold": 0.7}, "more": 1}
    write(tmp_path / "train" / "1.json", json.dumps(task, indent=2))
    write(tmp_path / "train" / "2.json", "{broken")
    write(tmp_path / "held_out" / "3.json", json.dumps({"task_id": "c"}))
    rows = {(r.partition, r.file): r for r in readers.read_partitions(spark, str(tmp_path)).collect()}
    assert set(rows) == {("train", "1.json"), ("train", "2.json"), ("held_out", "3.json")}
    assert rows["train", "2.json"].error == "invalid_json" and rows["train", "2.json"].task_id is None
    good = rows["train", "1.json"]
    assert good.error is None and good.input.bench_summary_snapshot.available_roles[0]["count"] == 2
    with pytest.raises(FileNotFoundError):
        readers.read_partitions(spark, str(tmp_path / "none"))
    found = readers.read_partitions(spark, str(tmp_path)).select("task_id", "partition", "rank")
    writers.publish(found, str(tmp_path / "out"))
    assert {r.partition for r in spark.read.json(str(tmp_path / "out")).collect()} == {"train"}
    writers.append_runs(found.limit(1), str(tmp_path / "runs"))
    writers.append_runs(found.limit(1), str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 2
    assert writers.text_table(spark.createDataFrame([(1, "xyz"), (2, None)], "a int, b string"), 1) == "a  b\n-----".replace("-----", "----") + "\n1  xyz\n..."


def test_corpus(spark, tmp_path):
    write(tmp_path / "c.jsonl", '{"a":1,"b":"é"}\n\n  \nnot json\n')
    assert sorted(r.text for r in readers.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()) == ["not json", '{"a": 1, "b": "\\u00e9"}']


def test_annotations(spark, tmp_path):
    path = tmp_path / "a.csv"
    write(path, "task_id,dimension,rater_b,rater_a1,rater_a2\n# note,,,,\nt1,d,1,0,1\n\n\"t,2\",d,,x,0\n")
    rows = {r.task_id: r for r in readers.read_annotations(spark, str(path)).collect()}
    assert set(rows) == {"t1", "t,2"}
    assert (rows["t1"].rater_a1, rows["t1"].rater_b, rows["t1"].row_num, rows["t1"].missing_cols) == (0, 1, 3, [])
    assert rows["t,2"].row_num == 4 and rows["t,2"].missing_cols == ["rater_a1(invalid:'x')", "rater_b"]
    write(tmp_path / "b.csv", "task_id,dimension\n")
    with pytest.raises(ValueError, match="rater_a1, rater_b, rater_a2"):
        readers.read_annotations(spark, str(tmp_path / "b.csv"))
    with pytest.raises(FileNotFoundError):
        readers.read_annotations(spark, str(tmp_path / "c.csv"))
    lines = readers.read_commented(spark, str(path)).orderBy(F.desc("comment"), "place").collect()
    assert [r.line[:4] for r in lines] == ["# no", "task", "t1,d", '"t,2']


def test_markdown(spark, tmp_path):
    write(tmp_path / "s.md", "﻿# title\nlost\n## banned_phrases\n# note\nworld one | why\n\n10x | a | b\n## hedges\n\\bmay\\b\n")
    rows = readers.read_settings(spark, str(tmp_path / "s.md")).orderBy("place").collect()
    assert [(r.section, r.entry) for r in rows] == [("banned_phrases", "world one"), ("banned_phrases", "10x"), ("hedges", "\\bmay\\b")]
    write(tmp_path / "p.md", "# x\n## P-001 Name\ntext\n## Other\n## P-002\n")
    assert [r.probe for r in readers.read_probe_ids(spark, str(tmp_path / "p.md")).orderBy("place").collect()] == ["P-001 Name", "P-002"]


def test_trials_and_references(spark, tmp_path):
    write(tmp_path / "r1" / "results.json", '{"score": 0.5, "reward": 0.25}')
    write(tmp_path / "r2" / "results.json", '{"results": {"score": 0.75}}')
    write(tmp_path / "r3" / "task_1_result.json", '{"reward": 1}')
    write(tmp_path / "r3" / "task_2.json", '{"score": 0.4}')
    write(tmp_path / "r3" / "task_3.json", "broken")
    write(tmp_path / "r4" / "other.json", "{}")
    got = {r.run: round(r.score, 6) for r in readers.read_trial_scores(spark, str(tmp_path)).collect()}
    assert got == {"r1": 0.25, "r2": 0.75, "r3": round(2.4 / 3, 6), "r4": 0.0}
    shapes = ['[{"ci": {"mean": 0.7, "ci_lower": 0.6}}]', '{"conditions": {"baseline": {"pass_at_1": 0.5, "ci_95": [0.4, 0.6]}}}', '{"pass_at_1": 0.9}', "broken", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(shapes)], "i int, t string").select("i", readers.reference_values(F.col("t"), {"pass_at_1": 0.1, "ci_lower": 0.2, "ci_upper": 0.3}).alias("v")).orderBy("i").collect()
    assert [tuple(r.v) for r in rows] == [(0.7, 0.6, 0.3), (0.5, 0.4, 0.6), (0.9, 0.2, 0.3), (0.1, 0.2, 0.3), (0.1, 0.2, 0.3)]
    text = spark.range(1).select(readers.task_text(F.lit("t"), F.lit("d"), F.lit('{"a":1}'), F.lit(None).cast("string")).alias("x")).first().x
    assert text == 't d {"a": 1}'


def test_stream(spark, tmp_path):
    from tallyforge.streaming.probes import daily_totals, regressions

    schema = "probe string, ts timestamp, triggered int"
    source = tmp_path / "in"
    spark.createDataFrame([("a", "2024-01-01 01:00:00", 1), ("a", "2024-01-01 02:00:00", 0), ("b", "2024-01-01 03:00:00", 0)], "probe string, ts string, triggered int").coalesce(1).write.json(str(source))
    runs = lambda: spark.readStream.schema(schema).json(str(source))
    for name, stream, mode in (("found", regressions(runs()), "append"), ("totals", daily_totals(runs()), "complete")):
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert [(r.probe, r.ts.hour) for r in spark.table("found").collect()] == [("a", 1)]
    assert {(r.probe, r.runs, r.triggered) for r in spark.table("totals").collect()} == {("a", 2, 1), ("b", 1, 0)}
