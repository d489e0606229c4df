"""The cosine index, the gram filter and the whole verdict against plain comparisons of all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import audits, contamination, cosine_index, verdicts


def tables(spark, items, docs):
    a = spark.createDataFrame(items, "item_id long, text string").withColumn("low", F.lit("x"))
    b = spark.createDataFrame(docs, "doc_id long, text string").withColumn("high", F.lit(1)).withColumn("item", F.lit(2))
    return a.repartition(2), b.repartition(3)


def brute(items, docs):
    bags = {("i", k): Counter((t or "").lower().split()) for k, t in items} | {("d", k): Counter((t or "").lower().split()) for k, t in docs}
    n = sum(bool(b) for b in bags.values())
    df = Counter(w for b in bags.values() for w in b)
    x = {k: {w: c * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in b.items()} for k, b in bags.items()}
    norm = {k: math.sqrt(sum(v * v for v in b.values())) for k, b in x.items()}
    out = {}
    for k, _ in items:
        sims = [(sum(v * x["d", d].get(w, 0) for w, v in x["i", k].items()) / norm["i", k] / norm["d", d], d) for d, _ in docs if norm["i", k] and norm["d", d]]
        sims = [(s, d) for s, d in sims if s > 0]
        if sims:
            best = max(s for s, _ in sims)
            out[k] = (round(best, 9), min(d for s, d in sims if round(s, 4) == round(best, 4)))
    return out


def made(seed, common=True):
    rng = random.Random(seed)
    rare, often = [f"r{i}" for i in range(400)], [f"the{i}" for i in range(6)]
    text = lambda n: " ".join(rng.choice(often) if common and rng.random() < 0.5 else rng.choice(rare) for _ in range(n))
    docs = [(i * 3, text(rng.randint(1, 60))) for i in range(300)]
    items = [(i, text(rng.randint(3, 20))) for i in range(25)]
    items += [(100 + i, " ".join(docs[i * 7][1].split()[: 4 + i])) for i in range(12)]
    docs += [(2000 + i, items[3][1]) for i in range(40)] + [(5000, None), (5001, ""), (5002, " \t ")]
    return [*items, (200, None), (201, " "), (202, "nowhere else unheard")], docs


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("postings", [4_000_000, 60])
def test_top1_is_that_of_all_pairs(spark, seed, postings):
    items, docs = made(seed)
    got = {r["item_id"]: (round(r["cosine"], 9), r["doc_id"]) for r in cosine_index.top1(*tables(spark, items, docs), postings).collect()}
    assert got == brute(items, docs)
    assert 202 not in got and 200 not in got and got[3][1] == 2000


def test_few_pairs_are_opened(spark):
    items, docs = made(4)
    items = items[25:37]
    found = cosine_index.candidates(*tables(spark, items, docs)).cache()
    opened, pairs = found.agg(F.sum("opened")).first()[0], len(items) * len(docs)
    assert opened < pairs / 3
    assert found.where("low > high").isEmpty()
    assert cosine_index.survivors(found).count() < pairs / 20


@pytest.mark.parametrize("items, docs", [([], []), ([(1, "a b")], []), ([], [(1, "a b")]), ([(1, None)], [(2, None)])])
def test_empty_tables(spark, items, docs):
    a, b = tables(spark, items, docs)
    assert cosine_index.top1(a, b).collect() == []
    assert contamination.containment(a, b).collect() == []
    assert [r["status"] for r in verdicts.contamination_cases(a, b).collect()] == ["CLEAN" for _, t in items if t]


def test_filtered_containment(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(120)] + [(900, None)]
    items = [(i, " ".join(docs[i][1].split()[2:20])) for i in range(20)] + [(50, "too short"), (51, None), (52, (docs[3][1] + " ") * 40)]
    a, b = tables(spark, items, docs)
    for n in (1, 3, 8):
        grams = lambda t, n=n: {tuple(w[i : i + n]) for w in [(t or "").split()] for i in range(len(w) - n + 1)}
        want = {(i, d): len(grams(s) & grams(t)) / len(grams(s)) for i, s in items for d, t in docs if grams(s) & grams(t)}
        assert {(r[0], r[1]): r[2] for r in contamination.containment(a, b, n).collect()} == want
    bits = contamination.gram_filter(a, 8)
    assert contamination.filtered_grams(b, bits, 8).count() < contamination._exploded(b, "doc_id", 8).count()


def test_dense_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items, refs = rng.normal(size=(40, 8)), rng.normal(size=(90, 8))
    refs[7] = refs[5] = items[4] * 1e-200
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)] + [(98, None), (99, [0.0] * 8), (97, [float("nan")] * 8), (96, [1.0])], "id long, v array<double>")
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(refs)] + [(-1, None), (-2, [0.0] * 8)], "id long, v array<double>").repartition(5)
    unit = lambda x: x / np.abs(x).max(1, keepdims=True) / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True)
    dots = np.round(unit(items) @ unit(refs).T, 12)
    want = {i: int(d.argmax()) for i, d in enumerate(dots)}
    for most in (64_000_000, 640):
        monkeypatch.setattr(audits, "MATRIX_BYTES", most)
        assert {r["id"]: r["ref_id"] for r in audits.dense_top1(a, b).collect()} == want
    assert want[4] == 5
    assert audits.dense_top1(a.limit(0), b).collect() == []
    assert audits.dense_top1(a, b.limit(0)).collect() == []


def test_whole_verdict(spark):
    words = [f"w{i}" for i in range(40)]
    near = words[:20] + ["changed"] + words[21:]
    items = [(1, " ".join(words)), (2, "other words that stand here in this one item"), (3, "nothing of it"), (4, None), (5, "by its vector only")]
    docs = [(7, " ".join(near)), (9, "see: other words that stand here in this one item"), (8, "a b other words that stand here in this one item"), (6, None)]
    a, b = tables(spark, items, docs)
    vectors = spark.createDataFrame([(5, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<double>"), spark.createDataFrame([(70, [1.0, 0.1]), (60, [2.0, 0.2])], "id long, v array<double>")
    got = {r["item_id"]: r for r in verdicts.contamination_cases(a, b, vectors).collect()}
    assert {k: r["violations"] for k, r in got.items()} == {1: ["high_tfidf_cosine"], 2: ["ngram_exact_match", *(["high_tfidf_cosine"] if got[2]["cosine_flag"] else [])], 3: [], 5: ["high_embedding_similarity"]}
    assert got[1]["cosine_ref"] == 7 and got[2]["ngram_ref"] == 8 and got[5]["embedding_ref"] == 60 and got[3]["cosine_ref"] == -1
    assert got[1]["max_embedding"] is None and got[3]["status"] == "CLEAN" and got[5]["status"] == "CONTAMINATED"
    report = verdicts.case_report(verdicts.contamination_cases(a, b, vectors), a, b, True).first()
    assert (report["tasks_checked"], report["reference_docs"], report["clean"], report["violations"], report["status"]) == (5, 4, 1, 3, "CONTAMINATED")
