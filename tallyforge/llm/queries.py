"""The queries op1_ to op13_ and ``pipeline``: operators of this subpackage over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file of this name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = count_tokens(sized, tokenizer_path("piece_bpe_32k.model"), carry=("doc_id", "n_bytes"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.mixing import mix_digest

    return mix_digest(table(spark, sf_dir, "documents"))


def op3_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has audio: the UTF-8 bytes of every whole text are taken as an 8-bit recording."""
    from tallyforge.llm.chroma import align

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("media"))
    return align(docs, F.col("doc_id") % 20 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.minhash import Settings, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Settings(words=4))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.embed_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.bpe_codec import round_trip

    coded = round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.token_files import token_file_digests

    return token_file_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end=2)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.merkle import verify

    return verify(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mix_sources": op2_mix_sources,
    "op3_media_fingerprints": op3_media_fingerprints,
    "op4_quality": op4_quality,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_html_text": op6_html_text,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_token_files": op11_token_files,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = dict(oracles.ORACLES)
