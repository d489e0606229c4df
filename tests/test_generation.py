"""Sweeps over tables of prospects: whole cells, odd ids, empty pools."""

from collections import Counter

from tallyforge.operators.generation import swept
from tallyforge.operators.invariants import DIFFICULTIES, DIMENSIONS


def test_sweep(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    pool = spark.createDataFrame([("x",), ("y",), ("z",)], "entry string")
    rows = swept(ids, {"signal": pool, "snapshot": pool.limit(0)}).collect()
    assert len(rows) == 4 * len(DIMENSIONS) * len(DIFFICULTIES)
    assert Counter(r.prospect for r in rows) == {"1": 20, "2": 40, "": 20}
    assert {r.signal for r in rows} == {"x", "y", "z"} and {r.snapshot for r in rows} == {None}
    assert len({(r.dimension, r.difficulty, r.source_mode) for r in rows}) == 20
    assert all((r.confidence == 0.3) == (r.difficulty == "adversarial") and (r.turn is None) == (r.difficulty in ("easy", "medium")) for r in rows)
    assert all(r.turn is None or 1 <= r.turn <= 5 for r in rows)
    same = lambda r: tuple(map(str, r))
    again = swept(ids.repartition(3), {"signal": pool.repartition(2), "snapshot": pool.limit(0)}).collect()
    assert sorted(map(same, rows)) == sorted(map(same, again))
    assert swept(ids.limit(0), {"signal": pool}).count() == 0
