"""Spelling variants by anagram hashing.

The anagram key of a word is the sum of a power of each of its letters, so words with the same
letters have the same key, and adding, removing or exchanging a letter changes it by a known value.
Words one letter apart therefore meet in an equi join: the longer of two words, less the value of
one of its letters, has the key of the shorter; two words that differ by an exchange have the same
key less the value of one letter each. Such a change lies in the first or in the second half, and
the other half is the same in both words: its hash is part of the join key, which keeps anagrams
of one half apart by the other. The order of letters is verified on what meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.llm.scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "a-zÀ-ÿ"
#: Keys are sums modulo a prime, so that they fit a long however long a word is; equal sums stay equal.
MODULUS = (1 << 61) - 1
POWER = 5


def observed_words(docs: DataFrame, least_chars: int = 6, misspell: int = 199) -> DataFrame:
    """(word): every run of letters of every whole text, lower-cased from A to Z only, with planted misspellings.

    Let h be the crc32 of ``doc_id:run``; where ``misspell`` divides h, the letter at h modulo the
    run's length is left out. Words shorter than ``least_chars`` are not given. A document without
    an id has an empty one in h.
    """
    text = F.translate("text", _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    size = F.length("run")
    at = (F.col("h") % size).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    hit = F.col("h") % misspell == 0
    return runs.withColumn("h", h).select(F.when(hit, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_chars)


def vocabulary(words: DataFrame, least: int = 5) -> DataFrame:
    """(word, n) of the words that occur ``least`` times or more."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def letter_value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    value = code
    for _ in range(POWER - 1):
        value = value * code
    return value


def anagram_key(letters: Column) -> Column:
    return F.aggregate(letters, F.lit(0).cast("long"), lambda total, c: (total + letter_value(c)) % MODULUS)


def _less(key: Column, letter: Column) -> Column:
    return (key + MODULUS - letter_value(letter)) % MODULUS


def _keyed(words: DataFrame) -> DataFrame:
    """Each word with its letters, key and length."""
    letters = F.split("word", "")
    return words.select("word", letters.alias("letters")).withColumn("key", anagram_key(F.col("letters"))).withColumn("size", F.size("letters"))


def _halves(word: Column, size: Column, cut: Column, skip: int = 0) -> tuple[Column, Column]:
    """Hashes of the letters before ``cut``, and of those from ``cut + skip`` on."""
    return F.xxhash64(F.substring(word, F.lit(1), cut)), F.xxhash64(F.substring(word, cut + 1 + skip, size))


def _removals(rows: DataFrame, cut: Column, skip: int) -> DataFrame:
    """(word, size, side, half, key): the key without one letter, for each letter of either part of a word.

    The parts are cut at ``cut``: side 1 changes the letters before it (and ``skip`` more), with the
    rest unchanged, side 2 the letters from it on. A part has few different letters, so a long word
    gives no more rows than the alphabet is large.
    """
    head, tail = _halves(F.col("word"), F.col("size"), cut, skip)
    first = F.array_distinct(F.slice("letters", F.lit(1), cut + skip))
    second = F.array_distinct(F.slice("letters", cut + 1, F.col("size")))
    made = F.concat(
        F.transform(first, lambda c: F.struct(F.lit(1).alias("side"), tail.alias("half"), _less(F.col("key"), c).alias("key"))),
        F.transform(second, lambda c: F.struct(F.lit(2).alias("side"), head.alias("half"), _less(F.col("key"), c).alias("key"))),
    )
    return rows.select("word", "size", F.explode(made).alias("m")).select("word", "size", "m.side", "m.half", "m.key")


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): all pairs of different ``word`` that differ by one inserted, removed or replaced code point, each once."""
    rows = scratch.keep(_keyed(words))
    half = (F.col("size") / 2).cast("int")
    on = ["size", "side", "half", "key"]
    same = _removals(rows, half, 0)
    x, y = same.select(F.col("word").alias("a"), *on), same.select(F.col("word").alias("b"), *on)
    exchanged = x.join(y, on).where("a < b").select("a", "b")
    # the longer word is cut where the shorter has its half, so that either part of it matches one
    longer = _removals(rows, ((F.col("size") - 1) / 2).cast("int"), 1).withColumn("size", F.col("size") - 1).withColumnRenamed("word", "b")
    head, tail = _halves(F.col("word"), F.col("size"), half)
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), tail.alias("half")), F.struct(F.lit(2).alias("side"), head.alias("half"))))
    shorter = rows.select(F.col("word").alias("a"), "size", "key", sides.alias("m")).select("a", "size", "key", "m.side", "m.half")
    added = shorter.join(longer, on).select("a", "b")
    # an added letter can be told to lie in either half inside a run of equal ones
    return exchanged.unionByName(added).where(F.levenshtein("a", "b", 1) == 1).distinct()


def follow(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for (word, form): the end of each chain, by joining every word with its form's form.

    Each round doubles the steps taken; a form is more frequent than its word, so chains end.
    """
    now = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.keep(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        done = step.where("moved").isEmpty()
        scratch.drop(now)
        now = step.drop("moved")
        now._scratch_path = step._scratch_path
        if done:
            return now


def variants(words: DataFrame, least: int = 5, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that occurs ``least`` times or more in ``words``.

    A word's form is its near word of largest n, of smaller code points on ties, if that is
    ``factor`` times as frequent or more. A word without one has null form and form_n and is its own
    root. No words give an empty table. Columns other than ``word`` are not read.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    known = scratch.keep(vocabulary(words, least))
    pairs = scratch.keep(near_pairs(known, scratch))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    sized = both.join(known.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = sized.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    top = -F.col("best.less")
    good = top >= factor * F.col("n")
    found = scratch.keep(
        known.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(good, F.col("best.near")).alias("form"), F.when(good, top).alias("form_n"),
        )
    )
    roots = follow(found.where("form is not null").select("word", "form"), scratch)
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of whole ``docs`` (doc_id, text); null and empty texts have none, repeated rows count each time."""
    return variants(observed_words(docs))
