"""Passages of over 50 words that have fewer than 400 bytes, against brute force at 200 bytes."""

import random


def shared(seed, n):
    """Texts with passages of 40 to 330 bytes in common."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefghijé ") for _ in range(n))
    pool = [word(rng.randint(40, 199)) for _ in range(8)] + [word(rng.randint(200, 330)) for _ in range(4)]
    return ["".join(x for _ in range(rng.randint(2, 5)) for x in (rng.choice(pool), word(rng.randint(0, 150)))) for _ in range(n)]


def brute(texts, length):
    count, data = {}, [t.encode() for t in texts]
    for b in data:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    for b in data:
        last, kept = -length, bytearray()
        for i, x in enumerate(b):
            if len(b) - i >= length and count[b[i : i + length]] > 1:
                last = i
            if i - last >= length:
                kept.append(x)
        yield bytes(kept)


def test_short_scale(spark):
    from tallyforge.llm.suffix_dedup import SHORT, remove_repeats

    texts = [t for seed in range(120) for t in shared(seed, 6)]
    texts += [texts[0], "ab" * 300, "xy" * 99, "x" * 70_000 + texts[1], "short", ""]
    got = {r.doc_id: bytes(r.kept) for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scale=SHORT).collect()}
    assert [i for i, kept in enumerate(brute(texts, 200)) if got[i] != kept] == []


def test_stage_removes_passages_of_over_50_words(spark):
    import corpus_pipeline

    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n))
    passages = [words(n) for n in (51, 55, 60)]
    assert max(len(p) for p in passages) < 400
    rows = [(i, f"{words(80)} {passages[i % 3]} {words(80)}", None) for i in range(12)] + [(i, words(200), None) for i in range(12, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, docs, "").collect()}
    assert len(got) == 20 and not any(p[5:-5] in t for p in passages for t in got.values())
    assert all(got[i] == t for i, t, _ in rows[12:])
