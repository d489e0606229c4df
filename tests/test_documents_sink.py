"""One JSON document a row: indented UTF-8 files, all of them or none."""

import json

import pytest

from tallyforge.sources import documents, readers


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, body string").repartition(3)


def test_files_come_back(spark, tmp_path):
    rows = [(f"t{i}", json.dumps({"task_id": f"t{i}", "dimension": "é", "rubric": {"pass_threshold": i / 10}})) for i in range(12)]
    path = f"{tmp_path}/out"
    documents.write_documents(frame(spark, rows), path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{n}.json" for n, _ in rows)
    text = (tmp_path / "out" / "t1.json").read_text(encoding="utf-8")
    assert text.startswith('{\n  "task_id"') and "é" in text and text.endswith("}\n")
    back = readers.read_tasks(spark, path).collect()
    assert [r.file for r in back] == sorted(f"{n}.json" for n, _ in rows)
    assert {(r.task_id, r.rubric.pass_threshold) for r in back} == {(f"t{i}", i / 10) for i in range(12)}
    documents.write_documents(frame(spark, [("new", "{}")]), path, append=True)
    assert (tmp_path / "out" / "t1.json").exists() and (tmp_path / "out" / "new.json").exists()
    documents.write_documents(frame(spark, [("only", "[]")]), path)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["only.json"]


@pytest.mark.parametrize("bad", [("x", "{broken"), ("a/b", "{}"), ("", "{}"), (None, "{}"), ("t3", "{}"), ("x", None), ("_x", "{}")])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    rows = [(f"t{i}", "{}") for i in range(9)]
    with pytest.raises(Exception):  # noqa: B017 (the engine wraps it)
        documents.write_documents(frame(spark, [*rows, bad]), f"{tmp_path}/out")
    assert list((tmp_path / "out").glob("*")) in ([], list((tmp_path / "out").glob("_staged-*")))


def test_a_failed_job_keeps_what_was_there(spark, tmp_path):
    documents.write_documents(frame(spark, [("old", "{}")]), f"{tmp_path}/out")
    with pytest.raises(Exception):  # noqa: B017
        documents.write_documents(frame(spark, [("new", "{}"), ("bad", "{")]), f"{tmp_path}/out")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["old.json"]


def test_empty_table(spark, tmp_path):
    documents.write_documents(frame(spark, []), f"{tmp_path}/out")
    assert list((tmp_path / "out").glob("*")) in ([], list((tmp_path / "out").glob("_staged-*")))
