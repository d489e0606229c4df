"""Contamination of benchmark items by documents, as equi joins on grams and tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits of the filter of the items' grams: a fixed size, at which five million grams let one in fifty of others through.
FILTER_BITS = 1 << 26
#: Words that are looked at together in Python.
PIECE = 100_000


def tokens(text: Column) -> Column:
    """Lower-case words between white space, without empty ones."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def grams(words: Column, n: int) -> Column:
    """Distinct runs of ``n`` words; none where there are fewer words."""
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))))


def _exploded(df: DataFrame, key: str, n: int) -> DataFrame:
    """One row for each distinct gram. Words are bound once a row, not once a gram."""
    made = F.transform(F.array(tokens(F.col("text"))), lambda w: F.coalesce(grams(w, n), F.array().cast("array<string>")))
    return df.select(key, F.explode(F.element_at(made, 1)).alias("gram"))


def hashed(text: Column) -> Column:
    """The words as 64-bit hashes."""
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def pieces(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lengths, values) of runs of rows with about PIECE values; null lists are empty."""
    size = np.array(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
        yield at, size[at:stop], lists.slice(at, stop - at).flatten().to_numpy(zero_copy_only=False)
        at = stop


def gram_bits(size: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, bits) of every run of ``n`` hashed words inside a row; ``bits`` has two places of the filter each."""
    many = max(len(values) - n + 1, 0)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(owner[:many] == owner[n - 1 :]) if many else np.zeros(0, dtype=np.int64)
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + values[at + k].view(np.uint64)
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    mask = np.uint64(FILTER_BITS - 1)
    bits = np.stack([total >> np.uint64(38), total >> np.uint64(8)]) & mask
    first = np.cumsum(size) - size
    return owner[at], at - first[owner[at]], bits.astype(np.int64)


def gram_filter(items: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the items' grams, of FILTER_BITS bits however many grams there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, size, values in pieces(batch.column(0)):
                _, _, bits = gram_bits(size, values, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(bits))], names=["bit"])

    rows = items.select(hashed(F.col("text")).alias("h")).mapInArrow(run, "bit bigint")
    found = rows.groupBy(F.shiftright("bit", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("byte")).toArrow()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    out[found["at"].to_numpy()] = found["byte"].to_numpy()
    return out


def filtered_places(bits: np.ndarray, n: int) -> Callable[[Column], Column]:
    """A function from hashed words to the places (from 1) of the grams that pass the filter."""

    @F.arrow_udf("array<int>")
    def places(lists: pa.Array) -> pa.Array:
        out = []
        for _, size, values in pieces(lists):
            row, place, at = gram_bits(size, values, n)
            hit = np.ones(len(row), dtype=bool)
            for b in at:
                hit &= (bits[b >> 3] >> (b & 7) & 1).astype(bool)
            ends = np.append(0, np.cumsum(np.bincount(row[hit], minlength=len(size))))
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[hit] + 1, pa.int32())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return places


def filtered_grams(docs: DataFrame, bits: np.ndarray, n: int) -> DataFrame:
    """(doc_id, gram): the distinct grams of each document that pass the filter, as strings."""
    found = docs.select("doc_id", "text", filtered_places(bits, n)(hashed(F.col("text"))).alias("places")).where("size(places) > 0")
    texts = F.transform(F.array(tokens(F.col("text"))), lambda w: F.array_distinct(F.transform("places", lambda i: F.array_join(F.slice(w, i, n), " "))))
    return found.select("doc_id", F.explode(F.element_at(texts, 1)).alias("gram"))


def containment(items: DataFrame, docs: DataFrame, n: int = 8) -> DataFrame:
    """item_id, doc_id and the share of the item's grams that the document holds, where there is any.

    A filter of fixed size keeps the documents' other grams from the shuffle; those that pass are
    joined as strings, so what it lets through by chance is not counted. Null, empty and short texts
    have no grams. Other columns aren't read.
    """
    left = _exploded(items, "item_id", n)
    right = filtered_grams(docs, gram_filter(items, n), n)
    size = left.groupBy("item_id").agg(F.count("*").alias("grams"))
    hits = left.join(right, "gram").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))
    return hits.join(size, "item_id").select("item_id", "doc_id", (F.col("hits") / F.col("grams")).alias("share"))


def ngram_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    best = containment(items, docs).groupBy("item_id").agg(F.max("share").alias("share"))
    share = F.coalesce("share", F.lit(0.0))
    return items.select("item_id").join(best, "item_id", "left").select("item_id", F.round(share, 4).alias("max_ngram"), (share >= 1.0).alias("contaminated"))


def contamination_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = ngram_containment(spark, sf_dir)
    bad = F.count_if("contaminated")
    return row.agg(F.count("*").alias("items"), bad.alias("violations"), F.round(bad / F.greatest(F.count("*"), F.lit(1)), 4).alias("contamination_rate"), (bad == 0).alias("clean"))


def tfidf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed inverse document frequency of every token over items and documents."""
    both = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))
    rows = both.select(F.array_distinct(tokens(F.col("text"))).alias("words")).where(F.size("words") > 0)
    total = rows.agg(F.count("*").alias("n"))
    df = rows.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(total)).select("token", "df", F.round(F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


def time_shift_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as tasks: created on the order date, locked until the first shipping date."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("created"))
    lock = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.min("l_shipdate")).alias("locked"))
    stale = F.col("locked") < F.col("created")
    early = F.col("created") < F.lit("1995-01-01").cast("date")
    return orders.join(lock, "o_orderkey", "left").where(stale | early).select("o_orderkey", F.coalesce(early, F.lit(False)).alias("early"), F.coalesce(stale, F.lit(False)).alias("stale"), F.when(stale, F.datediff("created", "locked")).alias("days_stale"))


WORDS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"
_GRAMS = "unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' ')))) AS gram"
_CONTAIN = f"""WITH bw AS MATERIALIZED (SELECT item_id, {WORDS} AS w FROM benchmark), dw AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents), i AS (SELECT item_id, {_GRAMS} FROM bw), d AS (SELECT doc_id, {_GRAMS} FROM dw),
s AS (SELECT item_id, count(*) AS grams FROM i GROUP BY 1),
h AS (SELECT item_id, doc_id, count(*) AS hits FROM i JOIN d USING (gram) GROUP BY 1, 2),
m AS (SELECT item_id, max(hits / grams) AS share FROM h JOIN s USING (item_id) GROUP BY 1),
r AS (SELECT item_id, round(coalesce(share, 0), 4) AS max_ngram, coalesce(share, 0) >= 1 AS contaminated FROM benchmark LEFT JOIN m USING (item_id))"""

QUERIES = {"ngram_containment": ngram_containment, "contamination_report": contamination_report, "tfidf_idf": tfidf_idf, "time_shift_audit": time_shift_audit}
ORACLES = {
    "ngram_containment": f"{_CONTAIN} SELECT * FROM r",
    "contamination_report": f"{_CONTAIN} SELECT count(*) AS items, count(*) FILTER (contaminated) AS violations, round(count(*) FILTER (contaminated) / greatest(count(*), 1), 4) AS contamination_rate, count(*) FILTER (contaminated) = 0 AS clean FROM r",
    "tfidf_idf": f"WITH t AS (SELECT list_distinct({WORDS}) AS w FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents)), n AS (SELECT count(*) AS n FROM t WHERE len(w) > 0), d AS (SELECT token, count(*) AS df FROM (SELECT unnest(w) AS token FROM t) GROUP BY 1) SELECT token, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM d, n",
    "time_shift_audit": "WITH l AS (SELECT l_orderkey, min(l_shipdate)::date AS locked FROM lineitem GROUP BY 1) SELECT o_orderkey, o_orderdate::date < date '1995-01-01' AS early, coalesce(locked < o_orderdate::date, false) AS stale, CASE WHEN locked < o_orderdate::date THEN date_diff('day', locked, o_orderdate::date)::int END AS days_stale FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE locked < o_orderdate::date OR o_orderdate::date < date '1995-01-01'",
}
