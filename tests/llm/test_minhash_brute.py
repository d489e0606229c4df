"""Near-duplicates against all pairs of full sets."""

import random

import pytest

from tallyforge.llm.minhash import Settings, near_duplicates


@pytest.mark.parametrize("words", [4, 5])
def test_components_equal_all_pairs(spark, words):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = rng.choices(vocabulary, k=120)
    texts = []
    for _ in range(25):
        base = shared[rng.randint(0, 40) :] + rng.choices(vocabulary, k=rng.randint(5, 90))
        for _ in range(rng.randint(1, 4)):
            now = list(base)
            for _ in range(rng.randint(0, 5)):
                now[rng.randrange(len(now))] = rng.choice(vocabulary)
            texts.append(" ".join(now))
    texts += [texts[0].upper(), "a b", "A\tb", "a", "", None, "  \n"]

    def grams(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        k = min(words, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, k0 string")
    got = {r.doc_id: r for r in near_duplicates(docs, Settings(words=words)).collect()}
    assert {i: (len(sets[i]), find(i), find(i) == i) for i in got} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}
    assert near_duplicates(docs.limit(0)).count() == 0
