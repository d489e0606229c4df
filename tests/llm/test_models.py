"""Quality, embeddings and mixing: odd rows, brute force, and held-out accuracy."""

import math
import random

import numpy as np
import pytest


def test_quality(spark):
    """Held-out accuracy on made rows whose words tell the label, and odd rows."""
    from tallyforge.llm.quality import score_quality

    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.5
        pool = [f"{'good' if good else 'junk'}{rng.randint(0, 30)}" if rng.random() < 0.4 else f"w{rng.randint(0, 200)}" for _ in range(60)]
        rows.append((i, " ".join(pool), "en", f"s{int(good) if rng.random() < 0.9 else rng.randint(0, 1)}", 400, "clash"))
        if i < 300:
            labels.append((i, int(good)))
    truth = {i: "good" in r[1] for i, r in enumerate(rows)}
    big = (1 << 60) + 1
    odd = [(None, None, None, None, None, "x"), (700, "", None, "s1", None, "x"), (701, "word " * 50_000, "en", None, -5, "x"), (701, "word " * 50_000, "en", None, -5, "x"), (big, "good1 good2", "en", "s1", 3, "x")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
    docs = spark.createDataFrame(rows + odd, schema)
    known = spark.createDataFrame([*labels, (None, 1), (2, None)], "doc_id bigint, quality int")
    got = score_quality(docs, known).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert big in by and len({r.score for r in got if r.doc_id == 701}) == 1
    assert np.mean([(by[i] >= 0.5) == truth[i] for i in range(300, 600)]) >= 0.95
    assert score_quality(docs.limit(0), known).count() == 0
    assert {r.score for r in score_quality(docs, known.where("quality = 1")).collect()} == {0.5}


@pytest.mark.parametrize("width", [2, 16])
def test_embeddings_brute(spark, width):
    from tallyforge.llm.embed_dedup import Settings, near_duplicates

    rng = np.random.default_rng(width)
    base = rng.normal(size=(40, width))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.05, 0.15, 0.25)])
    x = np.concatenate([x, x[:5]])
    label = [None if i % 17 == 0 else int(i % 3 == 0) for i in range(len(x))]
    rows = [(i, x[i].tolist(), label[i], "clash") for i in range(len(x))]
    # other lengths of vectors, numbers at both ends of the scale, and repeated ids with unlike vectors
    rows += [(900, [1e200, *[0.0] * (width - 1)], 7, "x"), (901, [1e-200, *[0.0] * (width - 1)], 7, "x"), (902, [1.0, *[0.0] * (width - 1)], 7, "x"), (903, [1.0], 7, "x")]
    rows += [(910, [1.0, *[0.0] * (width - 1)], 8, "x"), (910, [*[0.0] * (width - 1), 1.0], 8, "x"), (911, [*[0.0] * (width - 1), 2.0], 8, "x")]
    rows += [(None, [1.0] * width, 8, "x"), (920, None, 8, "x"), (921, [], 8, "x"), (922, [0.0] * width, 8, "x"), (923, [float("inf")] * width, 8, "x"), (924, [None] * width, 8, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, id string")
    got = near_duplicates(df, Settings(cell_rows=15, block=10)).collect()
    assert len(got) == len(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & np.array([[a is not None and a == b for b in label] for a in label])
    np.fill_diagonal(link, False)
    root = list(range(len(x)))
    for _ in range(len(x)):
        root = [min([root[i], *[root[j] for j in np.flatnonzero(link[i])]]) for i in range(len(x))]
    by = {r.vec_id: r for r in got}
    assert [(by[i].n_links, by[i].component_id, by[i].kept) for i in range(len(x))] == [(link[i].sum(), root[i], root[i] == i) for i in range(len(x))]
    assert link.sum() > 100
    assert [(by[i].n_links, by[i].component_id) for i in (900, 901, 902, 903)] == [(2, 900)] * 3 + [(0, 903)]
    assert sorted((r.n_links, r.component_id) for r in got if r.vec_id == 910) == [(0, 910), (1, 910)] and by[911].component_id == 910
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id is None or r.vec_id >= 920)
    assert near_duplicates(df.limit(0)).count() == 0


def test_mix_targets_and_shards(spark):
    from tallyforge.llm.mixing import Mix, mix_digest, mix_plan, mixed_shards, shard_counts, targets, sized

    rng = random.Random(9)
    rows = []
    for i in range(300):
        source = rng.choice(["a", "a", "a", "b", "c", None])
        rows.append((i, " ".join(f"d{i}w{k}" for k in range(rng.choice([0, 1, 30, 400])) ), source, "clash"))
    rows += [(300, None, "a", "x"), (301, "q " * 30_000, "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    mix = Mix(block=16, shard_slots=64)
    got = {r.doc_id: r for r in mix_digest(docs, mix).collect()}
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    own = {i: s for i, _, s, _ in rows}
    total = {s: sum(size[i] for i in own if own[i] == s) for s in ("a", "b", "c", None)}
    weight, rest, target = dict(zip(("a", "b", "c", None), (5, 2, 1, 5), strict=True)), sum(total.values()), {}
    while True:
        free = [s for s in total if s not in target]
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * total[s]]
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        for s in over:
            target[s] = 3.0 * total[s]
        rest = sum(total.values()) - sum(target.values())
    for i, r in got.items():
        assert (r["size"], r.source_size) == (size[i], total[own[i]]) and math.isclose(r.target, target[own[i]], rel_tol=1e-9) and 0 <= r.taken <= 3 * size[i]
    for s in total:
        taken = sum(got[i].taken for i in own if own[i] == s)
        assert abs(taken - target[s]) <= 0.03 * target[s] + 16
    out = mixed_shards(docs, mix).collect()
    assert len({r.slot for r in out}) == len(out)
    words = [w for r in out for w in r.text.split()]
    assert len(words) == sum(r.taken for r in got.values())
    own_words = {}
    for w in words:
        key = 301 if w == "q" else int(w[1:].split("w")[0])
        own_words[key] = own_words.get(key, 0) + 1
    assert own_words == {i: r.taken for i, r in got.items() if r.taken}
    _, by_source, _ = mix_plan(docs, mix)
    counts = shard_counts(by_source, mix).collect()
    shards = {}
    for r in counts:
        shards[r.shard] = shards.get(r.shard, 0) + r.n
    assert all(n == 64 for k, n in shards.items() if k < max(shards)) and len({r.n for r in counts if r.skey == "va"}) > 3
    assert mix_digest(docs.limit(0), mix).count() == 0 and mixed_shards(docs.limit(0), mix).count() == 0


def test_mix_follows_the_drawn_counts(spark):
    """Another draw takes other words; the sum of what the shards drew is what is taken."""
    from tallyforge.llm.mixing import Mix, mix_digest, mix_plan, shard_counts

    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 90)), "abc"[i % 3]) for i in range(400)], "doc_id bigint, text string, source string")
    found = []
    for seed in (1, 2, 3):
        mix = Mix(block=8, shard_slots=32, seed=seed)
        _, by_source, takes = mix_plan(docs, mix)
        drawn = {r.skey: r.n for r in shard_counts(by_source, mix).groupBy("skey").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
        blocks = {r.skey: r.n for r in takes.select("skey", "slot").distinct().groupBy("skey").count().withColumnRenamed("count", "n").collect()}
        most = {r.skey: r.blocks * mix.passes for r in by_source.collect()}
        assert blocks == {k: min(n, most[k]) for k, n in drawn.items()}
        assert takes.groupBy("slot").agg({"block": "count"}).count() == sum(blocks.values())
        found.append({r.doc_id: r.taken for r in mix_digest(docs, mix).collect()})
    assert found[0] != found[1] != found[2]


def test_mix_sizes_and_targets_in_sql(spark, tmp_path):
    """Sizes, source sizes and targets of the contract in DuckDB, by filling up level by level."""
    import duckdb

    from tallyforge.llm.mixing import mix_digest

    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", " \t", "a b\u00a0c d\n"]) if i % 10 == 0 else "w " * rng.randint(0, 200), rng.choice(["x", "x", "x", "é", "y", "z", None, "Q"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    want = con.sql(rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM '{tmp_path}/documents/*.parquet'),
b AS (SELECT source, sum(size)::double AS s, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(3 * s) OVER u, 0) AS full_, sum(w) OVER () - coalesce(sum(w) OVER u, 0) AS open_, sum(s) OVER () AS whole, row_number() OVER (ORDER BY 3 * s / w, source IS NULL, source) AS k
      FROM b WINDOW u AS (ORDER BY 3 * s / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((whole - full_) / open_, k) AS level FROM o WHERE (whole - full_) / open_ <= 3 * s / w)
SELECT doc_id, size, s AS source_size, least(level * w, 3 * s) AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, l ORDER BY doc_id""").fetchall()
    got = [tuple(r) for r in mix_digest(docs).orderBy("doc_id").select("doc_id", "size", "source_size", "target").collect()]
    assert len(got) == len(want) and all(g[:3] == (w[0], w[1], int(w[2])) and math.isclose(g[3], w[3], rel_tol=1e-9) for g, w in zip(got, want, strict=True))
