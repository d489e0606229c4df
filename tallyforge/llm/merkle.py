"""A Merkle manifest of a dataset: built bottom-up, proofs pushed top-down.

Every level of a tree is written to the shared folder as parents with the digests of their
children, 8 at most. A proof is a list with one entry a level, (digests left of the node, digests
right of it). The proof of a root is empty; joined with its level's parents it goes down to all
children, each of which prepends its own siblings. So no step gathers more than a node's children,
and the tree of a hot group is as wide as any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.llm.scratch import Scratch

ARITY = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def record_digest(values: list[Column]) -> Column:
    """Hex sha256 of the values: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in shown]), 256)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``i``, the place in the group ``g`` by ``order`` from 0 on, and ``n``, the group's size.

    Rows are dealt out by ranges of group and order, so that a hot group takes many tasks; only one
    row for each task and group is added up. Rows equal in group and order lie in the order of the
    tasks that read them.
    """
    keys = ["g", *order, "task"]
    spread = rows.withColumn("task", F.spark_partition_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = scratch.keep(spread.drop("task").withColumn("row", F.monotonically_increasing_id()))
    # the upper bits of a row's number are its task, the others its place there
    task = F.shiftright("row", 33).alias("task")
    parts = kept.groupBy(task, "g").agg(F.count("*").alias("size"), F.min("row").alias("first"))
    group = Window.partitionBy("g")
    before = F.sum("size").over(group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("g", "task", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(group).alias("n"), "first")
    joined = kept.withColumn("task", F.shiftright("row", 33)).join(parts, ["g", "task"])
    return joined.withColumn("i", F.col("before") + F.col("row") - F.col("first")).drop("task", "row", "before", "first")


@dataclass
class Trees:
    """One tree for each group: leaves (g, i, n, d, load) and levels (g, i, n, d, kids) of parents."""

    leaves: DataFrame
    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(g, d): the last digest of each group."""
        out = self.leaves.where("n = 1").select("g", "d")
        for level in self.levels:
            out = out.unionByName(level.where("n = 1").select("g", "d"))
        return out

    def proofs(self, tops: DataFrame) -> DataFrame:
        """Leaves (g, d, load) with ``path`` and ``top``, given (g, path, top) of each group's root."""
        own = lambda level: level.where("n = 1").select("g", "i").join(tops, "g")
        down = None
        for level in reversed(self.levels):
            now = own(level) if down is None else down.select("g", "i", "path", "top").unionByName(own(level))
            joined = level.select("g", "i", "kids").join(now, ["g", "i"])
            kids = F.transform("kids", lambda k: k["d"])
            down = joined.select("g", F.posexplode("kids").alias("at", "kid"), kids.alias("all"), "path", "top").select(
                "g", F.col("kid.i").alias("i"), F.col("kid.d").alias("d"), F.col("kid.load").alias("load"), "top",
                F.array_prepend("path", F.struct(
                    F.array_join(F.slice("all", F.lit(1), F.col("at")), "").alias("left"),
                    F.array_join(F.slice("all", F.col("at") + 2, F.lit(ARITY)), "").alias("right"),
                )).alias("path"),
            )
        # a leaf that is its group's root has its load in the table of leaves
        single = self.leaves.where("n = 1").select("g", "i", "d", "load").join(tops, "g")
        return single if down is None else down.unionByName(single)


def build(leaves: DataFrame, scratch: Scratch) -> Trees:
    """Trees over ``leaves`` (g, i, n, d, load): level by level, every ARITY nodes become their digest."""
    leaves = scratch.keep(leaves)
    widest = leaves.agg(F.max("n")).first()[0] or 0
    levels, now = [], leaves
    while widest > 1:
        load = F.col("load") if now is leaves else F.lit(None).cast(leaves.schema["load"].dataType)
        kid = F.struct("i", "d", load.alias("load"))
        parents = now.where("n > 1").groupBy("g", F.expr(f"i div {ARITY}").alias("i")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(kid)).alias("kids"))
        digest = F.sha2(F.array_join(F.transform("kids", lambda k: k["d"]), ""), 256)
        now = scratch.keep(parents.select("g", "i", F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), digest.alias("d"), "kids"))
        levels.append(now)
        widest = -(-widest // ARITY)
    return Trees(leaves, levels)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    return F.aggregate(path, leaf, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a proof, level by level to the root, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def manifest(docs: DataFrame, changed: str | None = None, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(order, leaf, changed, subroot, root, path): each row's leaf digest and its proof up to the root.

    Groups are ordered by name, UTF-8 bytewise, the null group first; inside a group rows lie by
    ``order``, nulls first, rows that repeat it by their leaf. Repeated rows are leaves of their own.
    An empty table gives no rows, one row a path without entries. Texts are hashed whole. Columns
    other than ``fields`` are not read, whatever their names, but for the column that ``changed`` names: a
    digest to carry along, null if none is named.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    extra = F.col(changed) if changed else F.lit(None).cast("string")
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(name.alias("g"), F.col(order).alias("o"), record_digest([F.col(f) for f in fields]).alias("d"), extra.alias("c"))
    placed = numbered(rows, ["o", "d"], scratch)
    inner = build(placed.select("g", "i", "n", "d", F.struct("o", "c").alias("load")), scratch)
    tops = numbered(inner.roots().select(F.lit("").alias("g"), F.col("g").alias("o"), "d"), ["o"], scratch)
    outer = build(tops.select("g", "i", "n", "d", F.col("o").alias("load")), scratch)
    none = F.array().cast("array<struct<left: string, right: string>>")
    root = outer.roots().select("g", none.alias("path"), F.col("d").alias("top"))
    groups = outer.proofs(root).select(F.col("load").alias("g"), "path", F.struct(F.col("d").alias("subroot"), F.col("top").alias("root")).alias("top"))
    out = inner.proofs(scratch.keep(groups))
    return out.select(F.col("load.o").alias(order), F.col("d").alias("leaf"), F.col("load.c").alias("changed"), "top.subroot", "top.root", "path")


def tampered(docs: DataFrame, by: int = 3) -> DataFrame:
    """``docs`` with ``changed``: the leaf of the row with a lower-case text, where ``by`` divides the crc32 of its id.

    Rows without an id are left alone.
    """
    low = [F.translate("text", _UPPER, _LOWER) if f == "text" else F.col(f) for f in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % by == 0
    return docs.select(*FIELDS, F.when(hit, record_digest(low)).alias("changed"))


def verify(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` with proof digests, and each proof folded from the tampered or original leaf."""
    found = manifest(tampered(docs), "changed")
    folded = found.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
