"""What the co-training moves between tasks: ids and scores, never texts."""

import random


def test_texts_stay_in_place(spark, monkeypatch):
    from tallyforge.llm.quality import score_quality
    from tallyforge.llm.scratch import Scratch

    rng, plans, keep = random.Random(8), [], Scratch.keep

    def kept(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df)

    monkeypatch.setattr(Scratch, "keep", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with labels that are too large
    try:
        text = lambda good: " ".join(rng.choice(("clear", "sound", "shown") if good else ("BUY", "$$$", "win")) for _ in range(40))
        docs = spark.createDataFrame([(i, text(i % 2), "en", "s", 200) for i in range(400)], "doc_id bigint, text string, lang string, source string, n_chars int")
        labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, quality int")
        result = score_quality(docs, labels)
        got = {r.doc_id: r.score for r in result.collect()}
        plans.append(result._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 400 and all((v > 0.5) == (i % 2 == 1) for i, v in got.items())
    assert any("Exchange" in p for p in plans)
    assert not [p for p in plans if "Exchange" in p and "text" in p]


def test_stored_views(spark):
    """Counts above two bytes, and null and blank rows, come back as they went in."""
    import numpy as np

    from tallyforge.llm.quality import ContentView, mapped, stored_views

    texts = ["a " * 70000 + "B1 c\nc", "", None, " \n ", "Ünder 12 \U0001f600"]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars int")
    rows = mapped(stored_views(docs), lambda a, b: {"a": list(a), "b": list(b)}, "doc_id bigint, a array<double>, b array<double>").orderBy("doc_id").collect()
    assert np.array_equal([r.a for r in rows], ContentView()(texts))
    assert all(sum(r.b) == 2.0 for r in rows)
