"""Queries that take every row of their tables."""

import os

from tallyforge import catalog
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_label_is_merged(spark):
    got = catalog.QUERIES["label_upsert"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("doc_id is not null")
    assert got.select("doc_id").distinct().count() == labels.select("doc_id").distinct().count()


def test_every_document_is_counted(spark):
    rows = catalog.QUERIES["dimension_union"](spark, SF).collect()
    assert sum(r.all_rows for r in rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len({r.lang for r in rows}) == len(rows)
