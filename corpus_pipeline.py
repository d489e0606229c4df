"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm import bpe_codec, minhash, mixing, suffix_dedup, toxicity
from tallyforge.llm.names import hidden
from tallyforge.llm.queries import table, tokenizer_path
from tallyforge.llm.scratch import Scratch

#: Held by a test against the operators run one by one; SQL can't express the classifier.
ORACLE_SQL = None


def under_own_names(stage):
    """``stage`` over columns whose names can't clash with those that it makes itself."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(spark, hidden(docs), sf_dir).toDF(*docs.columns)

    return run


@under_own_names
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it is trained on the labels of ``sf_dir``.

    Null and empty texts have the score that the classifier's bias alone gives, which is clean;
    repeated rows are scored alike, each a row. Columns may have any names. An empty table stays one.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=tuple(docs.columns)).where("score < 0.5").select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique ``key``: the id where one row has it, else a number above all ids.

    Rows that repeat an id and a text are one; rows without an id are rows of their own.
    """
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    scratch = Scratch(docs.sparkSession, "keys")
    again = scratch.keep(again)
    if again.isEmpty():
        return docs.withColumn("key", F.col("doc_id").cast("long"))
    named = docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    odd = named.unionByName(docs.where("doc_id is null"))
    # numbered once, as a reread may deal rows otherwise
    odd = scratch.keep(odd.withColumn("number", F.monotonically_increasing_id()))
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("long").alias("top"))
    odd = odd.join(F.broadcast(top)).withColumn("key", F.col("top") + 1 + F.col("number")).drop("top", "number")
    usual = docs.where("doc_id is not null").join(again, "doc_id", "left_anti").withColumn("key", F.col("doc_id").cast("long"))
    return usual.select(*docs.columns, "key").unionByName(odd.select(*docs.columns, "key"))


@under_own_names
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows that repeat an id and a text are one.

    Null and empty texts and those without words have no near-duplicates and stay, as rows without
    an id do that are near none. Columns may have any names. An empty table stays one.
    """
    rows = keyed(docs)
    found = minhash.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("key"))
    return rows.join(found, "key", "left_semi").select(*docs.columns)


@under_own_names
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte strings; documents with nothing left go.

    A passage of 50 words has 200 bytes if its words have four, the space included; words of shorter
    ones (50 times ``is``) need more of them. op8 has 400 bytes, which 60 words may not reach.

    Where a cut divides a character, its other bytes go too. Null and empty texts have no such
    strings and stay; rows that repeat an id and a text are one. Columns may have any names. An empty
    table stays one.
    """
    rows = keyed(docs)
    done = suffix_dedup.remove_repeats(rows.select(F.col("key").alias("doc_id"), "text"), changed_only=True, characters=True, scale=suffix_dedup.SHORT).where("n_removed > 0").select(F.col("doc_id").alias("key"), "n_bytes", "n_removed", F.col("kept").cast("string").alias("left"))
    cut = rows.join(done, "key", "left")
    text = F.when(F.col("n_removed") > 0, F.col("left")).otherwise(F.col("text"))
    out = cut.where("n_removed is null or n_removed < n_bytes").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each document and pass with the words that are taken.

    Null and blank texts have no words and go; rows that agree in id, source and text are one; a null
    source is a source of its own. Columns may have any names. An empty table stays one.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, number of tokens, and the decoded text of every document of the mix.

    Null and empty texts have no ids and an empty text; every row gives one, repeated ones too. Other
    columns aren't read, whatever their names. An empty table gives an empty one.
    """
    coded = bpe_codec.round_trip(docs, tokenizer_path("word_bpe_49k.json"))
    return coded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("mix_sources", mix_sources),
    ("bpe_codec", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
