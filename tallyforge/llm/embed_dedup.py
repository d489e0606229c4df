"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one row kept a group.

Vectors with equal labels are compared. Centres are fitted for each label on a bounded sample, more
of them for larger labels; each vector belongs to its nearest centre's cell, and is copied to the
cells whose bounding plane it is near. Two unit vectors at the threshold are a chord of
sqrt(2 - 2 cosine) apart; were it to point straight at the other centre, the copy would need a
reach of sin(angle). In ``n`` dimensions a chord that doesn't depend on the centres has a part of
that direction with a deviation of chord / sqrt(n), and ``spread`` deviations are the reach, never
more than sin(angle). So all links are found in few dimensions, and a link is missed with a
probability of about 3e-7 for each plane in many, unless its direction was chosen to miss.

A label of up to ``cell_rows`` different vectors is one cell, and a cell of up to ``block`` of them one
block, so that vectors go through one shuffle, once for each cell and pair of blocks; no table with
vectors is written. Blocks are compared by products of tiles in single precision; pairs that this
can't tell from the threshold are decided in double precision. A pair of blocks gives counts of links
and, for each vector, the smallest vector that its links there reach, never all pairs. (Its smallest
partner would not do: two groups may meet in a link that is neither end's smallest.)
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from tallyforge.llm.components import connected_components
from tallyforge.llm.scratch import Scratch


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the vectors that the centres are fitted on, over all labels.

    A label has a cell for each ``cell_rows`` different vectors, ``most_cells`` at most. A block has
    ``block`` vectors and ``block_bytes`` bytes at most.
    """

    cosine: float = 0.93
    sample: int = 8000
    cell_rows: int = 60_000
    most_cells: int = 512
    spread: float = 5.0
    rounds: int = 8
    block: int = 60_000
    block_bytes: int = 64_000_000
    tile: int = 1000
    seed: int = 5


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaling by the largest part first keeps large and small numbers finite."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    rows = np.unique(unit(rows), axis=0)
    centres = rows[rng.permutation(len(rows))[:k]]
    for _ in range(rounds):
        near = (rows @ centres.T).argmax(1)
        sums = np.stack([rows[near == c].sum(0) for c in range(len(centres))])
        size = np.sqrt((sums * sums).sum(1))
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Bring ``root``, which gives each node one that stands for its component, up to the edges ``a``, ``b``."""
    while True:
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def links_of_tiles(x: np.ndarray, first: np.ndarray, second: np.ndarray, cosine: float, tile: int):
    """(a, b) for each pair of tiles with links: their rows in ``first`` and ``second``, each pair once, no row with itself."""
    low = x.astype(np.float32)
    doubt = (x.shape[1] + 8) * 2.4e-7
    same = first is second
    for p in range(0, len(first), tile):
        left = first[p : p + tile]
        rows = low[left]
        for q in range(p if same else 0, len(second), tile):
            right = second[q : q + tile]
            dots = rows @ low[right].T
            if dots.max() < cosine - doubt:
                continue
            i, j = np.nonzero(dots >= cosine - doubt)
            fine = dots[i, j] >= cosine + doubt
            a, b = left[i], right[j]
            open_ = np.flatnonzero(~fine)
            for at in range(0, len(open_), 50_000):
                o = open_[at : at + 50_000]
                fine[o] = (x[a[o]] * x[b[o]]).sum(1) >= cosine
            if same and p == q:
                fine &= i < j
            if fine.any():
                yield a[fine], b[fine]


def near_duplicates(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row.

    Rows whose label or vector is null, whose vector is empty, zero, or has a null or non-finite
    part are linked with nothing. Vectors of other lengths under one label aren't compared. Rows that
    repeat an id count as vectors of their own in ``n_links`` and each follow their own vector; a row
    with a null id has a null component and is kept. Only vec_id, label and embedding are read,
    whatever other columns there are.
    """
    scratch = Scratch(df.sparkSession, "cells")
    value = F.col("embedding").cast("array<double>")
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    usable = F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    kind = "float" if isinstance(df.schema["embedding"].dataType.elementType, FloatType) else "double"
    rows = df.select("vec_id", F.when(usable, F.concat_ws(":", F.col("label").cast("string"), F.size(value))).alias("grp"), F.when(usable, F.col("embedding").cast(f"array<{kind}>")).alias("v"))
    # equal vectors are one class with a count, told by 128 bits of hashes
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("g", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), "v")))
    classes = scratch.keep(rows.where("grp is not null").groupBy("grp", "h", "g").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")))
    # the same id may stand for unlike vectors; classes are numbered by a hash that is no other class's
    for salt in range(64):
        number = F.xxhash64(F.lit(salt), "grp", "h", "g")
        if classes.groupBy(number.alias("k")).count().where("count > 1").isEmpty():
            break
    classes, vectors = classes.withColumn("k", number), rows.where("grp is not null").select("grp", number.alias("k"), "v")
    sizes = {r["grp"]: r["count"] for r in classes.groupBy("grp").count().where(F.col("count") > s.cell_rows).collect()}
    large = F.col("grp").isin(list(sizes)) if sizes else F.lit(False)
    centres = {}
    if sizes:
        picked = classes.where(large).orderBy(F.xxhash64("id"), "k").select("k").limit(s.sample)
        taken = vectors.join(F.broadcast(picked), "k", "left_semi").groupBy("grp", "k").agg(F.first("v").alias("v")).orderBy("k").toPandas()
        centres = {g: spherical_kmeans(np.stack(p["v"].to_list()).astype(float), min(s.most_cells, -(-sizes[g] // s.cell_rows), len(p)), s.rounds, s.seed) for g, p in taken.groupby("grp")}
    chord = float(np.sqrt(2 - 2 * s.cosine))
    exact = float(np.sqrt(1 - s.cosine**2)) if s.cosine > 0 else 1.0

    def assign(batches):
        for pdf in batches:
            out = []
            for g, part in pdf.groupby("grp"):
                x = unit(np.stack(part["v"].to_list()).astype(float))
                c = centres.get(g, x[:0])
                if len(c) == 0:
                    c = np.eye(1, x.shape[1])
                # row by row, so that equal vectors get equal cells in any batch
                dots = np.stack([(x * one).sum(1) for one in c], axis=1)
                near = dots.argmax(1)
                gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))[near]
                reach = min(exact, s.spread * chord / np.sqrt(x.shape[1])) + 1e-9
                beyond = (dots[np.arange(len(x)), near][:, None] - dots) <= reach * gap + 1e-9
                beyond[np.arange(len(x)), near] = True
                i, cell = np.nonzero(beyond)
                p = part.iloc[i]
                lists = [np.flatnonzero(r).astype(np.int32) for r in beyond]
                out.append(pd.DataFrame({"cell": [f"{g}#{k}" for k in cell], "no": cell.astype(np.int32), "home": near[i].astype(np.int32), "cells": [lists[j] for j in i], "k": p["k"].to_numpy(), "v": p["v"].to_numpy()}))
            if out:
                yield pd.concat(out)

    alone = lambda t: t.where(~large).withColumn("cell", F.concat("grp", F.lit("#0")))
    cells = alone(vectors).select("cell", F.lit(0).alias("no"), F.lit(0).alias("home"), F.array(F.lit(0)).alias("cells"), "k", "v")
    counted = alone(classes).select("cell", "grp").groupBy("cell").agg(F.count("*").alias("rows"), F.first(F.element_at(F.split("grp", ":"), -1).cast("int")).alias("width"))
    if sizes:
        dealt = vectors.where(large).mapInPandas(assign, f"cell string, no int, home int, cells array<int>, k long, v array<{kind}>")
        cells = cells.unionByName(dealt)
        counted = counted.unionByName(dealt.select("cell", "k", F.size("v").alias("width")).groupBy("cell").agg(F.count_distinct("k").alias("rows"), F.first("width").alias("width")))
    most = F.greatest(F.lit(1), F.least(F.lit(s.block), F.floor(F.lit(s.block_bytes) / (8 * F.col("width")))))
    n = counted.select("cell", F.ceil(F.col("rows") / most).cast("long").alias("n")).where("n > 1")
    cut = cells.join(F.broadcast(n), "cell", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long"))).withColumn("b", F.pmod(F.xxhash64("k"), "n"))
    # block pair (i, j), i <= j, gets the rows of blocks i and j; copies are counted where they arrive
    placed = cut.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    placed = placed.select("cell", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "no", "home", "cells", F.col("k").alias("id"), "v").repartition("cell", "i", "j")
    first = [F.first(c).alias(c) for c in ("b", "no", "home", "cells", "v")]
    placed = placed.groupBy("cell", "i", "j", "id").agg(F.count("*").alias("m"), *first)

    def compare(pdf):
        x = unit(np.stack(pdf["v"].to_list()).astype(float))
        b, home, ids, m = (pdf[k].to_numpy() for k in ("b", "home", "id", "m"))
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        one = np.flatnonzero(b == i)
        other = one if i == j else np.flatnonzero(b == j)
        at = home == pdf["no"].iloc[0]
        there = None
        if not at.all():
            there = np.zeros((len(ids), max(home.max(), max(c.max() for c in pdf["cells"])) + 1), bool)
            for r, c in enumerate(pdf["cells"]):
                there[r, c] = True
        links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        held, many = [], 0
        for a, c in links_of_tiles(x, one, other, s.cosine, s.tile):
            if there is not None:
                # a pair counts in the home cell of its smaller id, or if the larger one isn't there, in that one's
                low, high = np.where(ids[a] < ids[c], a, c), np.where(ids[a] < ids[c], c, a)
                lead = at[low] | (at[high] & ~there[high, home[low]])
                a, c = a[lead], c[lead]
            np.add.at(links, a, m[c])
            np.add.at(links, c, m[a])
            apart = root[a] != root[c]
            held.append((a[apart], c[apart]))
            many += int(apart.sum())
            if many > 500_000:
                unite(root, *map(np.concatenate, zip(*held, strict=True)))
                held, many = [], 0
        if held:
            unite(root, *map(np.concatenate, zip(*held, strict=True)))
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, root, ids)
        return pd.DataFrame({"id": ids, "links": links, "low": low[root]})[links > 0]

    met = scratch.keep(placed.groupBy("cell", "i", "j").applyInPandas(compare, "id long, links long, low long"))
    counts = met.groupBy("id").agg(F.sum("links").alias("links"))
    found = connected_components(met.select("id", "low"), scratch)
    # classes are told by number; a component's name is its smallest vec_id
    lows = found.withColumnRenamed("node", "k").join(classes.select("k", "id"), "k").groupBy("component").agg(F.min("id").alias("component_id"))
    named = found.withColumnRenamed("node", "k").join(lows, "component").select("k", "component_id")
    marks = classes.join(counts.withColumnRenamed("id", "k"), "k", "left").join(named, "k", "left")
    marks = marks.select("grp", "h", "g", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = rows.drop("v").join(marks, ["grp", "h", "g"], "left")
    component = F.coalesce("component_id", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
