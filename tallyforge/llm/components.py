"""Connected components by alternating large-star and small-star.

Each round is two joins of the edges with their nodes' smallest neighbours. A node's neighbours are
never gathered: the smallest is found by an aggregate that combines before the shuffle, and the
join back can be split where a node has very many edges. Edges of every round are written to the
shared folder, so that lost executors cost no lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or the node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node with an edge.

    ``edges`` has two columns of longs. Loops, repeated and reversed edges are allowed; edges with
    a null end are ignored. No edges give an empty table.
    """
    a, b = edges.columns
    now = scratch.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    mark = None
    while True:
        large = scratch.keep(_large_star(now))
        small = scratch.keep(_small_star(large))
        row = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        scratch.drop(large)
        now = small
        if row[0] == 0 or tuple(row) == mark:
            break
        mark = tuple(row)
    # at rest every node but the smallest of a component has one edge, which leads to the smallest
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
