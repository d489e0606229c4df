"""Each stage of the pipeline on its own input against the operators and brute force."""

import random
import struct

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def table(spark):
    """Clean and toxic documents, near copies, repeated passages, odd rows."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        text = words(rng, 60) + (" moron idiot scum" * 12 if bad else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not bad), int(bad)))
    passage = words(rng, 90)
    for i in range(120, 126):
        text = words(rng, 30) + " " + passage
        rows.append((i, text, "en", "s1", len(text)))
    near = rows[1][1].split()
    near[7] = "other"
    rows += [(126, " ".join(near), "en", "s1", 1), (127, rows[2][1], None, None, None), (128, None, None, "s1", None), (129, "", "en", "s2", 0), (None, words(rng, 20), "en", "s2", 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    from tallyforge.llm.minhash import near_duplicates
    from tallyforge.llm.mixing import mix_plan
    from tallyforge.llm.suffix_dedup import remove_repeats

    docs, labels = table(spark)
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, sf)
        out.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        seen[name] = now
        if name != pipeline.STAGES[-1][0]:
            assert now.schema.simpleString() == docs.schema.simpleString()
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    clean = seen["toxicity"]
    bad = {i for i in range(120) if i % 4 == 0}
    assert not bad & set(ids(clean)) and len(ids(clean)) == docs.count() - len(bad)
    single = seen["minhash_near_dedup"]
    kept = {r.doc_id for r in near_duplicates(clean.where("doc_id is not null")).collect() if r.kept}
    assert set(ids(single)) == kept | {None} and 126 not in kept and 127 not in kept
    cut = {r.doc_id: r.text for r in seen["suffix_array_dedup"].collect()}
    want = {r.doc_id: bytes(r.kept).decode() for r in remove_repeats(single).where("n_removed > 0").collect()}
    assert set(want) == set(range(120, 126)) and all(cut[i] == t for i, t in want.items())
    assert all(cut[r.doc_id] == r.text for r in single.collect() if r.doc_id not in want)
    mixed = seen["mix_sources"].collect()
    _, _, takes = mix_plan(seen["suffix_array_dedup"])
    assert sum(len(r.text.split()) for r in mixed) == takes.selectExpr("sum(hi - lo)").first()[0]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = now.collect()
    assert len(coded) == len(mixed)
    texts = sorted(r.text for r in mixed)
    assert sorted(r.decoded for r in coded) == sorted(lib.decode(lib.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts)
    for r in coded:
        assert r.n_tokens == len(r.ids) // 4 and lib.decode(list(struct.unpack(f"<{r.n_tokens}I", r.ids)), skip_special_tokens=False) == r.decoded


def test_empty_table(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs, labels = table(spark)
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    now = docs.limit(0)
    for name, stage in pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    assert now.count() == 0
