"""Spelling variants against comparisons of all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallyforge.llm import spelling
from tallyforge.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, word string, n int, key string, id string, run string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    counts = Counter()
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, out = {}, []
    for w, n in words.items():
        close = sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x))
        good = close and words[close[0]] >= 5 * n
        form[w] = close[0] if good else None
        out.append((w, form[w], None, n, len(close), words[close[0]] if good else None))
    for k, r in enumerate(out):
        root = r[0]
        while form[root]:
            root = form[root]
        out[k] = (r[0], r[1], root, *r[3:])
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "word", 1, "key", "id", "run") for r in rows], SCHEMA).repartition(3)
    got = spelling.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(expected(rows), key=lambda r: r[0])
    return expected(rows)


def edits(rng, word, alphabet):
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(4)
    if kind == 0:
        return word[:i] + rng.choice(alphabet) + word[i:]
    if kind == 1:
        return word[:i] + word[i + 1 :]
    if kind == 2:
        return word[:i] + rng.choice(alphabet) + word[i + 1 :]
    return "".join(rng.sample(word, len(word)))  # an anagram is no near word


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_words(spark, seed):
    rng = random.Random(seed)
    alphabet = "abcXYéÿ×"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9))) for _ in range(25)]
    words += [edits(rng, rng.choice(words), alphabet) for _ in range(150)]
    words = [w for w in words if w]
    weights = [rng.choice([1, 5, 30, 200, 900]) for _ in words]
    rows = [(i, " ".join(rng.choices(words, weights, k=400))) for i in range(40)]
    found = check(spark, rows)
    assert sum(r[1] is not None for r in found) > 5


def test_chains(spark):
    words = ["abcdef", "abcdex", "abcdxx", "abcxxx", "abxxxx"]
    rows = [(i, " ".join(w for k, w in enumerate(words) if i < 6 ** (k + 1))) for i in range(6**5)]
    found = check(spark, rows)
    assert {r[2] for r in found if r[0] in words} == {"abxxxx"}


def test_nulls_ties_repeats_and_long_words(spark):
    long = "ab" * 3000
    text = f"kitten_kitten kitten-kitten kitten mitten mitten mitten mitten mitten KITTEN sitten {long}a {long}b {long} short {long}é"
    rows = [(1, text)] * 30 + [(None, "mitten 日本 kittén ÉCOLES écoles"), (2, None), (3, ""), (4, "÷×÷×÷× 123456")] * 6
    check(spark, rows)


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_near_pairs_come_once(spark):
    words = ["aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "aabaaa", "abaaaa", "abcdef", "abcfed", "acbdef", "xabcdef", "abcdefx", "abcxdef"]
    got = sorted(tuple(sorted(r)) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), Scratch(spark, "t")).collect())
    assert got == sorted(tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))
