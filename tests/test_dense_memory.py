"""The best references of many items are found in little more memory than their vectors take."""

import tracemalloc

import numpy as np
import pandas as pd

from tallyforge.operators import audits


def test_products_are_made_by_tiles(spark):
    rng = np.random.default_rng(1)
    items = [(i, rng.normal(size=4).tolist()) for i in range(2500)]
    refs = [(i, rng.normal(size=4).tolist()) for i in range(1200)] + [(5000, items[9][1]), (4000, items[9][1])]
    ids, x = np.arange(2500), audits._unit(pd.Series([v for _, v in items]))
    frame = pd.DataFrame(refs, columns=["id", "v"])
    tracemalloc.start()
    (got,) = audits.best_references(ids, x, [frame[:700], frame[700:]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    dots = np.round(x @ audits._unit(frame["v"]).T, 12)
    assert got["ref_id"].tolist() == [min(frame["id"][row == row.max()]) for row in dots] and got["ref_id"][9] == 4000
    assert peak < 14e6
    table = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    assert [r["ref_id"] for r in audits.dense_top1(table(items), table(refs)).orderBy("id").collect()] == got["ref_id"].tolist()
