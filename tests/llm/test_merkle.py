"""Merkle manifests against trees built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, i int, d string, load string, task string, path string, changed string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def lowered(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def tree(nodes):
    """Root, and for each node the levels of (left siblings, right siblings)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(paths)):
            run = at[k] // 8 * 8
            paths[k].append(("".join(nodes[run : at[k]]), "".join(nodes[at[k] + 1 : run + 8])))
            at[k] //= 8
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def expected(rows):
    names = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {}
    for name in names:
        own = sorted([r for r in rows if r[2] == name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        groups[name] = (own, *tree([leaf(r, r[1]) for r in own]))
    root, tops = tree([groups[n][1] for n in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        own, subroot, paths = groups[name]
        for r, path in zip(own, paths, strict=True):
            whole = path + top
            d = leaf(r, lowered(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r, r[1])
            for a, b in whole:
                d = H(a, d, b)
            out.append((r[0], leaf(r, r[1]), subroot, root, H(*[a + b for a, b in whole]), d, d == root))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "g", 1, "d", "l", "t", "p", "c") for r in rows], SCHEMA).repartition(3)
    got = merkle.verify(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows), key=key)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 600])
def test_sizes(spark, n):
    check(spark, [(i * 3, f"Text {i} É", "en", f"s{i % 2}", i) for i in range(n)])


def test_languages_nulls_and_repeats(spark):
    rows = [(i, f"Text {i}", ["en", "de", None, "", "ß", "z", "Z", "é", "日", "a", "b", "c"][i % 12 if i % 3 else 0], None if i % 5 == 0 else "s", None if i % 7 == 0 else i) for i in range(150)]
    rows += [(None, "no id", "en", "s", 1), (None, None, None, None, None), (7, None, "de", "s", 2), (7, "", "de", "s", 2), (9, "AB" * 20_000, "x", "s", 3)]
    rows += [(500, "Same", "en", "s", 1)] * 40
    check(spark, rows)


def test_empty_table(spark):
    assert merkle.verify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_single_languages(spark):
    check(spark, [(1, "A", "en", "s", 1), (2, "B", "de", "s", 1)])


def test_tampered_rows_alone_fail(spark):
    rows = [(i, f"Text {i}" if i % 2 else f"text {i}", "en", "s", i) for i in range(60)]
    got = merkle.verify(spark.createDataFrame([(*r, "g", 1, "d", "l", "t", "p", "c") for r in rows], SCHEMA))
    bad = {r[0] for r in got.where(~F.col("verified")).collect()}
    assert bad == {i for i in range(60) if i % 2 and zlib.crc32(str(i).encode()) % 3 == 0}
