"""Near-duplicates by MinHash: hash minima, banding, signature and set verification, components.

1. Every text's word shingles become a set of 64-bit numbers. Rows with equal sets are one class,
   and only its smallest id goes on.
2. A signature holds the minima of many universal hash functions over the set; its bands are
   buckets. With 40 bands of 5 rows, a pair at the threshold of 0.8 shares no band with a
   probability of 1.3e-7.
3. In every bucket all members are compared with the smallest one. Pairs whose signatures agree
   enough are confirmed on the full sets, and links give components.
4. That leaves pairs of a bucket whose members are in different components. Documents of such
   buckets are open. Their shingles are put in one order, rarest first; by the prefix filter, two
   sets at the threshold share one of each one's first n - ceil(0.8 n) + 1 shingles. Open documents
   of different components that share such a shingle are compared, unless sizes or sketches of one
   bit a minimum rule a link out. A near copy that is too far from its group begins with shingles
   of its own, so that few pairs are left. After that no pair of any bucket that could change the
   components is left, so the result is that of comparing all pairs of all buckets, while a bucket
   full of copies costs one comparison a member.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyforge.llm.components import connected_components
from tallyforge.llm.scratch import Scratch


@dataclass(frozen=True)
class Settings:
    """Documents are linked when 100 * shared >= ``percent`` * all, over sets of ``words``-word shingles."""

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    seed: int = 42
    #: share of equal signature bytes below which a pair is not looked at further; a pair at the
    #: threshold falls below it with a probability under 1e-8
    least_agreement: float = 0.62
    #: of the sketch's bits, one a minimum, at most this many differ in a pair that is looked at: equal
    #: bits are a share of (1 + Jaccard) / 2, and a pair at the threshold differs in more of 200 bits
    #: with a probability of 2e-8
    most_bits: int = 46


MIX = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit numbers."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        try:
            found = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            known.update((w, xxh3_64_intdigest(w)) for w in set(words).difference(known))
            found = list(map(known.__getitem__, words))
        return np.array(found, dtype=np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct shingles of a whole text; fewer words than a shingle count as one, none as none."""
        row = text.encode("utf-8").lower().split() if text else []
        if not row:
            return np.zeros(0, dtype=np.uint64)
        h = self.word_hashes(row)
        k = min(self.words, len(h))
        value = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            value = scramble(value * MIX + h[i : len(h) - k + 1 + i])
        value.sort()
        return value[np.append(True, value[1:] != value[:-1])]


class Minima:
    """Minima of ``n`` universal hash functions a * x + b, of which the upper half is used."""

    def __init__(self, n: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None] * np.uint64(2)

    def of(self, values: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(values), 512):
            part = values[None, at : at + 512] * self.a
            part += self.b
            np.minimum(low, part.min(1), out=low)
        return low >> np.uint64(32)


SKETCH = ("k0", "k1", "k2", "k3")


def sketch(low: np.ndarray) -> list[int]:
    """The lowest bit of each of up to 256 minima, in four numbers."""
    bits = np.zeros(64 * len(SKETCH), dtype=np.uint8)
    bits[: len(low)] = low & np.uint64(1)
    return np.packbits(bits).view(np.int64).tolist()


def near_sketch(x: str, y: str, s: Settings):
    """Condition that the sketches in the columns with prefixes ``x`` and ``y`` differ in few bits."""
    return sum((F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in SKETCH), F.lit(0)) <= s.most_bits


def sketch_as(prefix: str) -> list:
    return [F.col(c).alias(prefix + c) for c in SKETCH]


def signatures(df: DataFrame, s: Settings, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, two halves of a hash of the set, 64-bit band keys, and a byte of each minimum.

    Null texts and texts without words have an empty set: n_shingles 0 and no bands.
    """
    from tallyforge.llm.arrowtext import map_column

    new = T.StructType(
        [
            T.StructField("n_shingles", T.LongType()),
            T.StructField("set_a", T.LongType()),
            T.StructField("set_b", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("signature", T.BinaryType()),
            *[T.StructField(c, T.LongType()) for c in SKETCH],
        ]
    )

    def make():
        shingler, minima = Shingler(s.words), Minima(s.bands * s.rows, s.seed)
        cached: dict[bytes, tuple] = {}

        def one(text):
            import xxhash

            found = shingler.shingles(text)
            if not len(found):
                return 0, None, None, None, None, *[None] * len(SKETCH)
            digest = xxhash.xxh3_128_digest(found.tobytes())
            made = cached.get(digest)
            if made is None:
                low = minima.of(found)
                value = np.arange(s.bands, dtype=np.uint64)
                for r in range(s.rows):
                    value = scramble(value * MIX + low[r :: s.rows])
                made = (value.view(np.int64), (low & np.uint64(255)).astype(np.uint8).tobytes(), *sketch(low))
                if len(cached) > 2000:
                    cached.clear()
                cached[digest] = made
            a, b = np.frombuffer(digest, dtype=np.int64)
            return len(found), int(a), int(b), *made

        def run(texts):
            rows = [one(t) for t in texts]
            n, a, b, bands, low, *bits = zip(*rows, strict=True)
            return [pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary()), *[pa.array(x, pa.int64()) for x in bits]]

        return run

    return map_column(df, text, new, make, [key])


def _agreement(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def confirm(pairs: DataFrame, marks: DataFrame, sets: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked: first signatures are compared, then full sets.

    Both joins are plain equi joins, in which Spark splits the rows of an id that is in very many
    pairs.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def alike(x, y):
        import pandas as pd

        return pd.Series([_agreement(np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)) >= s.least_agreement for p, q in zip(x, y, strict=True)], dtype=bool)

    left = marks.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa"))
    right = marks.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb"))
    pairs = pairs.join(left, "a").join(right, "b").where(alike("sa", "sb")).select("a", "b")
    pairs = scratch.keep(pairs)
    @pandas_udf("boolean")
    def linked(x, y):
        import pandas as pd

        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            shared = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * shared >= s.percent * (len(p) + len(q) - shared))
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb"))
    return scratch.keep(pairs.join(left, "a").join(right, "b").where(linked("xa", "xb")).select("a", "b").distinct())


#: Bits of the filter that is sent to all tasks, at every size of the input: 1 MB.
FILTER_BITS = 1 << 23


def perhaps(ids: DataFrame):
    """Condition on ``doc_id`` that holds for all of ``ids`` and for few others while those are few.

    It only spares texts a shuffle; more ids than bits make it hold for all documents.
    """
    from pyspark.sql.functions import pandas_udf

    spot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.select(spot.alias("spot")).groupBy((F.col("spot") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("bits"))
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for word, bits in words.collect():  # at most FILTER_BITS / 64 rows
        table[word] = bits

    @pandas_udf("boolean")
    def met(spot):
        return (table[spot.to_numpy() // 64] >> (spot.to_numpy() % 64) & 1 == 1) | spot.isna()

    return met(spot)


def wanted_sets(wanted: DataFrame, marks: DataFrame, docs: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """doc_id, set_a and packed shingles of the documents ``wanted``, whose texts are read again."""
    # an id may stand for several sets; a pair is linked if any two of them are
    sets = shingle_sets(docs.where(perhaps(wanted)).join(wanted, "doc_id", "left_semi"), s)
    sets = sets.join(marks.select("doc_id", "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    return scratch.keep(sets.dropDuplicates(["doc_id", "set_a"]).select("doc_id", "set_a", "shingles"))


def prefixes(sets: DataFrame, s: Settings) -> DataFrame:
    """doc_id, set_a, n, and the place and value of each shingle of the prefix that another document has too.

    Shingles are ordered by the number of documents that have them, then by value. Those of one
    document only come first in every prefix and need not be listed.
    """

    def unpack(batches):
        for batch in batches:
            packed = batch.column(2).to_pylist()
            at = np.cumsum([0, *(len(v) // 8 for v in packed)]).astype(np.int32)
            values = np.frombuffer(b"".join(packed), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(at), pa.array(values))], names=["doc_id", "set_a", "listed"])

    listed = sets.select("doc_id", "set_a", "shingles").mapInArrow(unpack, "doc_id bigint, set_a bigint, listed array<bigint>")
    rows = listed.select("doc_id", "set_a", F.size("listed").alias("n"), F.explode("listed").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    own = rows.join(often, "shingle").groupBy("doc_id", "set_a", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("ranked"))
    long = F.col("n") - F.ceil(F.col("n") * s.percent / 100) + 1 - (F.col("n") - F.size("ranked"))
    first = F.col("n") - F.size("ranked") + 1
    return own.where(long > 0).select("doc_id", "set_a", "n", first.alias("first"), F.posexplode(F.slice("ranked", F.lit(1), long.cast("int")))).select("doc_id", "set_a", "n", (F.col("first") + F.col("pos")).alias("place"), "col.shingle")


def shingle_sets(df: DataFrame, s: Settings) -> DataFrame:
    """doc_id, hash halves, and the packed sorted shingle numbers of each document."""
    from tallyforge.llm.arrowtext import map_column

    new = T.StructType([T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def make():
        import xxhash

        shingler = Shingler(s.words)

        def run(texts):
            sets = [shingler.shingles(t).tobytes() for t in texts]
            halves = [np.frombuffer(xxhash.xxh3_128_digest(x), dtype=np.int64) for x in sets]
            return [pa.array([int(h[0]) for h in halves], pa.int64()), pa.array([int(h[1]) for h in halves], pa.int64()), pa.array(sets, pa.binary())]

        return run

    return map_column(df, "text", new, make, ["doc_id"])


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of ``docs``.

    Texts that are null, empty or blank have no shingles and are linked with nothing. Rows with a
    null id are returned with a null component and kept. Other columns of ``docs``, whatever their
    names, are not looked at. Rows that repeat an id and a text agree in all columns; if only the id is repeated, each row follows the links of its own text.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select("doc_id", "text")
    marks = scratch.keep(signatures(docs, s))
    usable = marks.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n")))
    chosen = scratch.keep(usable.join(classes.select("doc_id", "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi").dropDuplicates(["doc_id", "set_a"]))

    bands = chosen.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    stars = bands.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.count("*").alias("members")).where("members > 1")
    shared = scratch.keep(bands.join(stars, "bucket"))
    fits = lambda x, y: F.col(x) * 100 >= F.col(y) * s.percent
    centres = chosen.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), *sketch_as("a"))
    members = chosen.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), *sketch_as("b"))
    first = shared.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    first = first.join(centres, "a").join(members, "b").where(fits("na", "nb") & fits("nb", "na") & near_sketch("a", "b", s))
    first = scratch.keep(first.select("a", "b").distinct())
    sets = wanted_sets(scratch.keep(shared.select("doc_id").distinct()), chosen, docs, s, scratch)
    links = confirm(first, chosen, sets, s, scratch)
    found = connected_components(links, scratch)

    labelled = shared.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled = labelled.select("bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    opened = scratch.keep(labelled.join(mixed, "bucket", "left_semi").select("doc_id", "component").distinct())
    scratch.drop(shared)
    met = prefixes(sets.join(opened, "doc_id", "left_semi"), s).join(opened, "doc_id").join(chosen.select("doc_id", "set_a", *SKETCH), ["doc_id", "set_a"])
    mixed = met.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    met = scratch.keep(met.join(mixed, "shingle", "left_semi"))
    largest = met.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    largest = largest.groupBy("shingle").agg(F.max(F.struct("size", "component")).alias("top")).select("shingle", F.col("top.component").alias("top"))
    sided = met.join(largest, "shingle")
    small = sided.where("component <> top").select("shingle", F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("component").alias("cx"), *sketch_as("x"))
    other = sided.select("shingle", F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"), F.col("component").alias("cy"), "top", *sketch_as("y"))
    # all that two sets share stands, in each, from the first shared shingle on
    most = 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    enough = (100 + s.percent) * most >= s.percent * (F.col("nx") + F.col("ny"))
    # both members outside the largest component meet twice; the smaller id leads
    rest = small.join(other, (small["shingle"] == other["shingle"]) & F.expr("cx <> cy and (cy = top or x < y)") & fits("nx", "ny") & fits("ny", "nx") & enough & near_sketch("x", "y", s))
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = confirm(scratch.keep(rest.join(first, ["a", "b"], "left_anti")), chosen, sets, s, scratch)
    scratch.drop(met)
    scratch.drop(sets)
    found = scratch.keep(connected_components(links.unionByName(more), scratch))

    named = classes.select("set_a", "set_b", F.col("doc_id").alias("class_id"))
    rows = marks.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    rows = rows.join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
