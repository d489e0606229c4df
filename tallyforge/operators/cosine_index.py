"""The most similar document of each item by cosine of TF-IDF weights, without comparing all pairs.

The items' weights make an inverted index: for each token the items that hold it, their weights and
the largest of these. A document meets the index with its own tokens, those that can add most
first. Once what the other tokens can add at most is too little for any item, no further item is
opened, and an open one is finished only if it can still reach the best document that its task has
seen. Of a document's other tokens only a bound is needed there: document frequencies, added up in a
table of fixed size by hash, bound its length from below, and the rarest possible tokens from above.
So a document gives no more than (item, lower bound, upper bound) where it may be the best, and
exact weights are computed for the documents that the bounds leave. Tokens are told apart by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallyforge.operators.contamination import hashed, pieces
from tallyforge.storage import kept

#: Entries of the table of document frequencies, and (item, token) pairs of the index that one pass holds.
SLOTS = 1 << 20
POSTINGS = 4_000_000
#: Cosines are compared at four decimals: a document this much below the best may be its equal.
SLACK = 1.1e-4


def counted(size: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, times) of the different values of each row."""
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    at = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1]))) if len(values) else np.zeros(0, dtype=np.int64)
    return owner[at], values[at], np.diff(np.append(at, len(values)))


def slot(values: np.ndarray) -> np.ndarray:
    return (values & (SLOTS - 1)).astype(np.int64)


def frequencies(rows: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows with tokens, the sum of document frequencies of each slot, and those of ``vocabulary`` (sorted).

    ``rows`` has a column ``h`` of hashed tokens. Each task adds up its own rows first; what reaches
    the driver are at most SLOTS sums and one for each token of the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slots, known = 0, np.zeros(SLOTS, dtype=np.int64), np.zeros(len(vocabulary) + 1, dtype=np.int64)
        for batch in batches:
            for _, size, values in pieces(batch.column(0)):
                total += int((size > 0).sum())
                _, value, _ = counted(size, values)
                slots += np.bincount(slot(value), minlength=SLOTS)
                at = np.searchsorted(vocabulary, value)
                at[at < len(vocabulary)] = np.where(vocabulary[at[at < len(vocabulary)]] == value[at < len(vocabulary)], at[at < len(vocabulary)], len(vocabulary))
                known += np.bincount(at, minlength=len(vocabulary) + 1)
        a, b = np.flatnonzero(slots), np.flatnonzero(known[:-1])
        kind = np.concatenate([[0], np.full(len(a), 1), np.full(len(b), 2)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([[0], a, b])), pa.array(np.concatenate([[total], slots[a], known[b]]))], names=["kind", "at", "n"])

    found = rows.select("h").mapInArrow(run, "kind int, at bigint, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    kind, at, n = (found[c].to_numpy() for c in ("kind", "at", "n"))
    slots, known = np.zeros(SLOTS), np.zeros(len(vocabulary))
    slots[at[kind == 1]] = n[kind == 1]
    known[at[kind == 2]] = n[kind == 2]
    return int(n[kind == 0].sum()), slots, known


@dataclass
class Index:
    """An inverted index of one block of items."""

    vocabulary: np.ndarray  # hashes, sorted
    idf: np.ndarray
    first: np.ndarray  # the postings of token t are first[t] to first[t + 1]
    item: np.ndarray
    weight: np.ndarray
    largest: np.ndarray  # of each token
    items: int
    least: np.ndarray  # idf of a slot's tokens at least
    most: float  # idf of any token at most

    @staticmethod
    def build(row: np.ndarray, value: np.ndarray, times: np.ndarray, items: int, total: int, slots: np.ndarray, known: np.ndarray, vocabulary: np.ndarray) -> Index:
        idf = np.log((total + 1) / (known + 1)) + 1
        token = np.searchsorted(vocabulary, value)
        raw = times * idf[token]
        weight = raw / np.sqrt(np.bincount(row, weights=raw * raw, minlength=items))[row]
        order = np.argsort(token, kind="stable")
        first = np.append(0, np.cumsum(np.bincount(token, minlength=len(vocabulary))))
        largest = np.maximum.reduceat(weight[order], first[:-1]) if len(vocabulary) else np.zeros(0)
        return Index(vocabulary, idf, first, row[order], weight[order], largest, items, np.log((total + 1) / (slots + 1)) + 1, np.log((total + 1) / 2) + 1)

    def postings(self, token: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What these tokens of a document add to the dot product with each item."""
        size = self.first[token + 1] - self.first[token]
        at = np.repeat(self.first[token] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.item[at], weights=self.weight[at] * np.repeat(weight, size), minlength=self.items)

    def search(self, batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
        """(item, id, low, high, opened) of the documents (id, h) that may be the best of an item.

        ``opened`` counts the items whose postings a document has met, on the first of its rows.
        """
        best = np.zeros(self.items)
        for batch in batches:
            for at, size, values in pieces(batch.column(1)):
                row, value, times = counted(size, values)
                token = np.searchsorted(self.vocabulary, value)
                token[token == len(self.vocabulary)] = 0
                known = self.vocabulary[token] == value if len(self.vocabulary) else np.zeros(len(value), dtype=bool)
                own = times * np.where(known, self.idf[token] if len(self.idf) else 0.0, 0.0)
                low = np.where(known, own, times * self.least[slot(value)])
                high = np.where(known, own, times * self.most)
                shortest = np.sqrt(np.bincount(row, weights=low * low, minlength=len(size)))
                longest = np.sqrt(np.bincount(row, weights=high * high, minlength=len(size)))
                found = self.rows(row[known], token[known], own[known], shortest, longest, best)
                if found:
                    item, doc, lows, highs, opened = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), batch.column(0).take(pa.array(doc + at)), pa.array(lows), pa.array(highs), pa.array(opened, pa.int64())], names=names)

    def rows(self, row: np.ndarray, token: np.ndarray, own: np.ndarray, shortest: np.ndarray, longest: np.ndarray, best: np.ndarray) -> list[tuple]:
        out = []
        bound = own * self.largest[token] / shortest[row]
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=np.int64)
        # the most promising documents of a piece come first, so that the rest has more to reach
        sums = np.add.reduceat(bound, starts) if len(starts) else np.zeros(0)
        ends = np.append(starts[1:], len(row))
        worst = best.min() - SLACK if self.items else 0.0
        for k in np.argsort(-sums, kind="stable"):
            if sums[k] < worst:
                break
            part = slice(starts[k], ends[k])
            doc = row[starts[k]]
            order = np.argsort(-bound[part], kind="stable")
            t, w, b = token[part][order], own[part][order] / shortest[doc], bound[part][order]
            rest = np.append(np.cumsum(b[::-1])[::-1], 0.0)
            cut = int((rest[:-1] >= worst).sum())
            dots = self.postings(t[:cut], w[:cut])
            open_ = dots > 0
            able = open_ & (dots + rest[cut] * (1 + 1e-9) >= best - SLACK)
            if not able.any():
                continue
            dots = dots + self.postings(t[cut:], w[cut:])
            lows = dots * (shortest[doc] / longest[doc]) * (1 - 1e-9)
            np.maximum(best, np.where(able, lows, 0.0), out=best)
            hit = np.flatnonzero(able & (dots * (1 + 1e-9) >= best - SLACK))
            worst = best.min() - SLACK
            if len(hit):
                opened = np.zeros(len(hit), dtype=np.int64)
                opened[0] = open_.sum()
                out.append((hit, np.full(len(hit), doc), lows[hit], dots[hit] * (1 + 1e-9), opened))
        return out


def candidates(items: DataFrame, docs: DataFrame, postings: int = POSTINGS) -> DataFrame:
    """(item_id, doc_id, low, high, opened): bounds of the cosine for each document that may be an item's best.

    Items are taken in as many blocks as keep ``postings`` (item, token) pairs each, one pass over the
    documents for a block. Documents without a token of the items are nobody's best and don't appear.
    """
    spark = docs.sparkSession
    left = items.select("item_id", hashed(F.col("text")).alias("h")).where("size(h) > 0")
    right = docs.select("doc_id", hashed(F.col("text")).alias("h"))
    both = left.select("h").unionByName(right.select("h"))
    many = left.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0]
    blocks = max(1, -(-many // postings))
    out = None
    for k in range(blocks):
        # at most about ``postings`` hashes
        rows = left.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()
        lists = rows["h"].combine_chunks() if rows["h"].num_chunks else pa.array([], pa.list_(pa.int64()))
        size = np.array(pc.list_value_length(lists), dtype=np.int64)
        row, value, times = counted(size, lists.flatten().to_numpy(zero_copy_only=False))
        vocabulary = np.unique(value)
        index = Index.build(row, value, times, len(size), *frequencies(both, vocabulary), vocabulary)
        names = ["item", "doc_id", "low", "high", "opened"]
        kind = docs.schema["doc_id"].dataType.simpleString()
        found = right.mapInArrow(lambda batches, index=index: index.search(batches, names), f"item int, doc_id {kind}, low double, high double, opened bigint")
        ids = spark.createDataFrame(rows.select(["item_id"]).append_column("item", pa.array(np.arange(len(size)), pa.int32()))) if len(size) else spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, item int")
        part = found.join(ids, "item").select("item_id", "doc_id", "low", "high", "opened")
        out = part if out is None else out.unionByName(part)
    return out


def survivors(found: DataFrame) -> DataFrame:
    """(item_id, doc_id) of the candidates whose upper bound reaches the largest lower bound of their item."""
    best = found.groupBy("item_id").agg(F.max("low").alias("best"))
    return found.join(best, "item_id").where(F.col("high") >= F.col("best") - SLACK).select("item_id", "doc_id").distinct()


def _counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.explode(hashed(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def exact_idf(needed: DataFrame, rows: DataFrame, most: int = POSTINGS) -> DataFrame:
    """(token, idf) of the hashed tokens in ``needed``, by exact document frequencies over ``rows`` (h).

    The tokens are taken in as many blocks as keep ``most`` each, one pass over the rows for a block.
    """
    spark, out = rows.sparkSession, None
    for k in range(blocks := max(1, -(-needed.count() // most))):
        # at most about ``most`` hashes
        vocabulary = np.sort(needed.where(F.pmod("token", F.lit(blocks)) == k).select("token").toArrow()["token"].to_numpy())
        total, _, df = frequencies(rows, vocabulary)
        table = pa.table({"token": vocabulary, "idf": np.log((total + 1) / (df + 1)) + 1})
        part = spark.createDataFrame(table) if len(vocabulary) else spark.createDataFrame([], "token bigint, idf double")
        out = part if out is None else out.unionByName(part)
    return out


def pair_cosines(pairs: DataFrame, items: DataFrame, docs: DataFrame, most: int = POSTINGS) -> DataFrame:
    """(item_id, doc_id, cosine) of the given pairs, by exact document frequencies over all items and documents.

    Only tokens of the pairs' own texts are counted and weighed. Repeated ids count as one text.
    """
    a = kept(_counts(items.join(pairs.select("item_id").distinct(), "item_id", "left_semi"), "item_id"))
    b = kept(_counts(docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id"))
    needed = kept(a.select("token").unionByName(b.select("token")).distinct())
    every = items.select(hashed(F.col("text")).alias("h")).unionByName(docs.select(hashed(F.col("text")).alias("h")))
    idf = kept(exact_idf(needed, every, most))
    x = kept(a.join(idf, "token").select("item_id", "token", (F.col("n") * F.col("idf")).alias("xa")))
    y = kept(b.join(idf, "token").select("doc_id", "token", (F.col("n") * F.col("idf")).alias("xb")))
    na = x.groupBy("item_id").agg(F.sqrt(F.sum(F.col("xa") * F.col("xa"))).alias("na"))
    nb = y.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("xb") * F.col("xb"))).alias("nb"))
    dots = pairs.join(x, "item_id").join(y, ["doc_id", "token"]).groupBy("item_id", "doc_id").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    return dots.join(na, "item_id").join(nb, "doc_id").select("item_id", "doc_id", (F.col("dot") / F.col("na") / F.col("nb")).alias("cosine"))


def top1(items: DataFrame, docs: DataFrame, postings: int = POSTINGS) -> DataFrame:
    """item_id, cosine and doc_id of the best document of each item that shares a token with one.

    Cosines are compared at four decimals and the smallest id wins a tie; ``cosine`` is the largest
    one, not rounded. Both tables have their id and ``text``; ids are unique and not null, other
    columns aren't read. Null and empty texts have no token.
    """
    found = kept(candidates(items.select("item_id", "text"), docs.select("doc_id", "text"), postings))
    exact = kept(pair_cosines(kept(survivors(found)), items.select("item_id", "text"), docs.select("doc_id", "text"), postings))
    most = exact.groupBy("item_id").agg(F.max("cosine").alias("cosine"))
    tied = exact.withColumnRenamed("cosine", "own").join(most, "item_id").where(F.round("own", 4) == F.round("cosine", 4))
    return tied.groupBy("item_id").agg(F.first("cosine").alias("cosine"), F.min("doc_id").alias("doc_id"))
