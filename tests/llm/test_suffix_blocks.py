"""Removal of repeated strings where blocks are cut by several lowest strings, against brute force."""

import random

import pytest


def shared(seed, n=60):
    """Texts that hold passages of 70 to 399 bytes in common, some also longer ones."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    pool = [word(rng.randint(70, 399)) for _ in range(12)] + [word(rng.randint(400, 520)) for _ in range(2)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(3, 6)):
            parts += [rng.choice(pool), word(rng.randint(0, 200))]
        texts.append("".join(parts))
    return [*texts, texts[0]][: n if n < 60 else None]


def brute(texts):
    """The bytes that each text keeps."""
    count = {}
    data = [t.encode() for t in texts]
    for b in data:
        for i in range(len(b) - 399):
            count[b[i : i + 400]] = count.get(b[i : i + 400], 0) + 1
    for b in data:
        last, kept = -400, bytearray()
        for i, x in enumerate(b):
            if count.get(b[i : i + 400], 0) > 1:
                last = i
            if i - last >= 400:
                kept.append(x)
        yield bytes(kept)


@pytest.mark.parametrize("first", [0, 100, 200])
def test_suffix_blocks(spark, first):
    from tallyforge.llm.suffix_dedup import remove_repeats

    for seed in range(first, first + 3):
        texts = shared(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: bytes(r.kept) for r in remove_repeats(docs).collect()}
        assert got == dict(enumerate(brute(texts)))


def test_many_seeds_at_once(spark):
    """500 sets of texts, which share nothing with each other, in one table."""
    from tallyforge.llm.suffix_dedup import remove_repeats

    texts = [t for seed in range(1000, 1500) for t in shared(seed, 3)]
    rng = random.Random(5)
    # a long text over several chunks, periodic stretches, and copies that are cut at characters
    texts += ["".join(rng.choice("abcdé") for _ in range(150_000)) + texts[0], "ab" * 900, "ab" * 250 + "é", texts[3] + texts[3], "xyz" * 40_000]
    got = {r.doc_id: bytes(r.kept) for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [i for i, kept in enumerate(brute(texts)) if got[i] != kept] == []


def test_a_place_is_one_block():
    """No text has two blocks of one size for one place, no start is lost, and anchors are those of a plain search."""
    import numpy as np

    from tallyforge.llm.suffix_dedup import LENGTH, SIZES, Anchors, cut_blocks

    make = Anchors()
    for seed in range(40):
        for text in [*shared(seed)[:6], "ab" * 400, "q" * 900]:
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            if len(data) < LENGTH:
                continue
            row = make.hashes(data)
            plain = np.array([p + int(np.argmin(row[p : p + 337])) for p in range(len(data) - LENGTH + 1)])
            q, lo, hi, a = make.of(data)
            found = np.full(len(plain), -1)
            for x, first, last in zip(q, lo, hi, strict=True):
                assert (found[first : last + 1] == -1).all()
                found[first : last + 1] = x
            assert (found == plain).all() and (row[q] == a).all()
            known = np.zeros(len(q), bool)
            for size in SIZES:
                q, lo, hi, known = cut_blocks(q, lo, hi, known, size)
                assert len(set(q)) == len(q) and not known.any()
                inside = np.zeros(len(plain), bool)
                for first, last in zip(lo, hi, strict=True):
                    inside[first : last + 1] = True
                assert inside.all()
