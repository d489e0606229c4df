"""An item is contaminated by its 8-grams or by its TF-IDF cosine."""


def test_near_copy_is_contaminated(spark):
    from tallyforge.operators.evaluation import verdicts

    words = [f"w{i}" for i in range(40)]
    near = words[:20] + ["changed"] + words[21:]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "quite other words stand here in this one item"), (3, None)], "item_id int, text string")
    docs = spark.createDataFrame([(7, " ".join(near)), (8, "a document of its own"), (9, None)], "doc_id long, text string")
    got = {r.item_id: (r.ngram_flag, r.cosine_flag, r.contaminated) for r in verdicts(items, docs).collect()}
    assert got == {"1": (False, True, True), "2": (False, False, False), "3": (False, False, False)}
    whole = {r.item_id: (r.ngram_flag, r.contaminated) for r in verdicts(items, docs.union(items.where("item_id = 2"))).collect()}
    assert whole["2"] == (True, True)
