"""Stages of the pipeline on tables with repeated and null ids."""

import random

import corpus_pipeline


def words(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_repeated_and_null_ids(spark):
    a, b, c, p = words(1), words(2), words(3), words(4, 70)
    rows = [(1, a), (1, b), (2, c), (2, c), (None, a), (None, words(5)), (None, p + words(6)), (3, words(7) + p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    texts = [r.text for r in left.collect()]
    assert sorted(texts) == sorted({t for _, t in rows})
    cut = {(r.doc_id, r.text) for r in corpus_pipeline.drop_repeats(spark, left, "").collect()}
    assert len(cut) == len(texts)
    assert not any(p[:400] in t for _, t in cut)


def test_replacement_characters_stay(spark):
    p = "�" + words(8, 80)
    rows = [(1, "x�y " + words(9, 20) + "é" + p), (2, words(10, 20) + "ũ" + p), (3, "� alone")]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    # these two letters end in the same byte, which the repeated string takes along
    assert got == {1: "x�y " + words(9, 20), 2: words(10, 20), 3: "� alone"}


CLASHES = ["score", "key", "number", "left", "n_bytes", "n_removed", "kept", "words", "skey", "row_key", "text_key", "spans", "begin", "size", "taken", "k0", "v", "other_3_", "toxic", "component_id", "a.b", "top"]


def test_stages_take_columns_of_any_name(spark, tmp_path):
    bad = " moron idiot scum" * 12
    texts = [words(i, 60) + (bad if i % 3 == 0 else "") for i in range(45)]
    passage = words(99, 90)
    texts += [words(100 + i, 30) + " " + passage for i in range(3)] + [texts[1], texts[2], None, "", " \t"]
    rows = [(i, t, f"s{i % 2}" if i % 7 else None, "en", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(45)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    more = docs.selectExpr(*[f"concat('{c}', doc_id) as `{c}`" for c in CLASHES[:11]], "*", *[f"concat('{c}', doc_id) as `{c}`" for c in CLASHES[11:]])
    for name, stage in corpus_pipeline.STAGES[:4]:
        plain = stage(spark, docs, str(tmp_path))
        assert plain.columns == docs.columns
        clashing = stage(spark, more, str(tmp_path))
        assert clashing.columns == more.columns, name
        got = clashing.collect()
        key = lambda r: (r[0], r[1] or "")
        assert sorted((tuple(r[c] for c in docs.columns) for r in got), key=key) == sorted(map(tuple, plain.collect()), key=key), name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in CLASHES), name
        assert stage(spark, more.limit(0), str(tmp_path)).columns == more.columns
    coded = corpus_pipeline.encode(spark, more, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in coded) == list(range(len(rows)))


def test_texts_are_encoded_and_decoded_by_one_worker(spark):
    """op10 and the pipeline's last stage have one Python step, so that one worker a task holds the vocabulary."""
    import corpus_pipeline as pipeline

    from tallyforge.llm.bpe_codec import decode, encode, round_trip
    from tallyforge.llm.queries import tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    texts = ["a word, two words", "É́ <|endoftext|> x", "", None, "日本語 \n\n z", "w" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    apart = {r.doc_id: (bytes(r.ids), r.decoded) for r in decode(encode(docs, path), path).collect()}
    assert {r.doc_id: (bytes(r.ids), r.decoded) for r in round_trip(docs, path).collect()} == apart
    assert pipeline.encode(spark, docs, "")._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
