"""Mixing sources to target weights, with DataFrame operations only.

Each source's words are laid end to end, document after document, and packed into blocks of a fixed
length. Sources with more weight than words are passed over up to ``passes`` times; what they can't
fill is shared by weight among the rest. The output is a numbered row of slots, a block each, cut
into shards. For every shard the number of its slots of each source is drawn first
(``shard_counts``): a multinomial draw by stratified uniforms over the slots of ``DRAWN`` shards, in
which each slot has one of as many equal strata of 0 to 1 by a pseudorandom permutation, a uniform
number in it, and the source in whose range of cumulated targets that number lies. So any slot is of a
source with the probability of its target, a shard's counts vary as a draw without replacement does,
and those of a group of shards are off what is expected by less than two slots a source. How much is
taken of a source, and of each document, follows from the drawn counts of all shards: the slots of a
source are numbered shard after shard, the numbers go through pseudorandom permutations of its
blocks, one for each pass, and slots and blocks are joined by source and block number.
``mixed_shards`` has the blocks that come out, ``mix_digest`` and ``mixed_documents`` what is taken of
each document. A slot that is drawn beyond the last pass of a source stays empty.

Nothing depends on how rows are partitioned, so reruns agree. Running sums are taken in two levels
(``CHUNKS`` parts of each source, then the parts' totals), so that a source that holds most rows is
still handled by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Parts into which the documents of a source are dealt for running sums.
CHUNKS = 1024
#: Shards of a source whose counts are summed by one window.
SHARD_RUN = 1024
#: Shards that are drawn together.
DRAWN = 64
SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights are given to sources by rank (code point order, null last), and repeat."""

    weights: tuple[int, ...] = (5, 2, 1)
    passes: int = 3
    block: int = 64
    shard_slots: int = 8192
    seed: int = 20240229


def word_count(text: Column) -> Column:
    """Words, which are runs of other characters than space and U+0009 to U+000D; 0 for null."""
    parts = F.size(F.split(text, SPACES))
    ends = text.rlike(r"^[\x20\x09-\x0D]").cast("int") + text.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(parts - ends).cast("long")


def permuted(value: Column, n: Column, *key: Column) -> Column:
    """``value`` sent through a pseudorandom permutation of 0 .. n - 1 chosen by ``key``.

    The numbers below m * m, with m the root of n, are pairs of digits. A round turns all numbers by
    a hashed amount, adds a hash of the low digit to the high one, and swaps the two; turning mixes
    in the numbers from m * m on. Rounds are folded over a sequence, which keeps the expression small.
    """
    m = F.floor(F.sqrt(n.cast("double"))).cast("long")

    def turn(value: Column, step: Column) -> Column:
        turned = (value + F.pmod(F.xxhash64(*key, step), n)) % n
        high, low = F.floor(turned / m).cast("long"), turned % m
        moved = low * m + (high + F.pmod(F.xxhash64(low, step, *key), m)) % m
        return F.when(turned < m * m, moved).otherwise(turned)

    return F.aggregate(F.sequence(F.lit(1), F.lit(5)), value, turn)


def source_key(docs: DataFrame) -> Column:
    """A never-null key of the source; a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("v"), docs["source"].cast("string")), F.lit("n"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, source key, a hash of the text, and size in words of every document."""
    return docs.select(
        "doc_id",
        docs["source"].cast("string").alias("source"),
        source_key(docs).alias("skey"),
        F.xxhash64("text").alias("text_key"),
        word_count(docs["text"]).alias("size"),
    )


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row a source: its rank, its size, its target in words, its blocks, and its range of slots.

    Only totals by source meet in one task, a row a source.
    """
    by = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), ((F.row_number().over(ranked) - 1) % len(mix.weights) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * mix.passes)
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before, whole = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", rest / open_weight).withColumn("place", F.row_number().over(filled))
    # the level at which the first source that doesn't overflow is reached holds for all after it
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("place", "level"))
    by = by.withColumn("level", F.min(fits).over(whole)["level"])
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)), F.col("most").cast("double"))
    by = by.withColumn("target", target)
    by = by.withColumn("blocks", F.ceil(F.col("source_size") / mix.block).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    by = by.withColumn("slots", F.least(slots, F.col("blocks") * mix.passes))
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    first = F.coalesce(F.sum("slots").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = (F.row_number().over(ordered) - 1).cast("long")
    return by.select("skey", "source", "source_size", "target", "blocks", "slots", first.alias("first_slot"), F.sum("slots").over(whole).alias("all_slots"), rank.alias("rank"))


def placed(sizes: DataFrame) -> DataFrame:
    """``sizes`` with the number of words of its source that stand before each document."""
    sizes = sizes.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(CHUNKS)))
    part = Window.partitionBy("skey", "chunk").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.withColumn("at", F.coalesce(F.sum("size").over(part), F.lit(0)))
    totals = sizes.groupBy("skey", "chunk").agg(F.sum("size").alias("words"))
    outer = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("skey", "chunk", F.coalesce(F.sum("words").over(outer), F.lit(0)).alias("base"))
    return inner.join(totals, ["skey", "chunk"]).select("doc_id", "source", "skey", "text_key", "size", (F.col("at") + F.col("base")).alias("begin"))


def shard_draws(by_source: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """shard, rank, skey, blocks and the slots ``n`` that the draw gives the source in the shard, where it gives any.

    Two sources that meet in a stratum share its uniform number, so that every slot has one source.
    The strata of a group of shards and a source are dealt to a stated number of tasks, which adaptive
    plans leave alone, and counted there before the shuffle.
    """
    slots, sources = by_source.agg(F.coalesce(F.max("all_slots"), F.lit(0)), F.count("*")).first()  # two numbers
    wide = mix.shard_slots * DRAWN
    groups, many = -(-slots // wide), F.lit(max(sources, 1))
    pairs = by_source.sparkSession.range(groups * sources).select((F.col("id") / many).cast("long").alias("group"), (F.col("id") % many).alias("rank"))
    rows = pairs.join(by_source, "rank").withColumn("here", F.least(F.lit(wide).cast("long"), F.col("all_slots") - F.col("group") * wide))

    def reached(edge: Column) -> Column:
        """Slots of the group whose uniform number lies below this edge of the cumulated targets."""
        at = edge.cast("double") * F.col("here") / F.col("all_slots")
        stratum = F.floor(at).cast("long")
        uniform = F.pmod(F.xxhash64(F.lit(mix.seed), F.col("group"), stratum), F.lit(1 << 30)) / float(1 << 30)
        return stratum + F.when(uniform < at - stratum, 1).otherwise(0)

    rows = rows.select("group", "rank", "skey", "blocks", "here", reached(F.col("first_slot")).alias("low"), reached(F.col("first_slot") + F.col("slots")).alias("high"))
    rows = rows.where("low < high").repartition(_tasks(by_source, slots), "group", "rank")
    place = permuted(F.col("stratum"), F.col("here"), F.lit(mix.seed), F.col("group"))
    strata = rows.withColumn("stratum", F.explode(F.sequence(F.col("low"), F.col("high") - 1)))
    shard = F.col("group") * DRAWN + F.floor(place / mix.shard_slots).cast("long")
    return strata.groupBy(shard.alias("shard"), "rank", "skey", "blocks").agg(F.count("*").alias("n"))


def _tasks(rows: DataFrame, slots: int) -> int:
    """One task for each 2^18 slots, and at least as many as a shuffle has."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slots >> 18))


def shard_counts(by_source: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``shard_draws`` with the source's slots in earlier shards (``before``), the slots of sources of lower rank in the shard (``first``), and its slots (``here``)."""
    from tallyforge.llm.scratch import Scratch

    rows = Scratch(by_source.sparkSession, "draw").keep(shard_draws(by_source, mix)).withColumn("run", F.floor(F.col("shard") / SHARD_RUN))
    part = Window.partitionBy("rank", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard = Window.partitionBy("shard")
    own = shard.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    inner = rows.withColumns({"inside": none(F.sum("n").over(part)), "first": none(F.sum("n").over(own)), "here": F.sum("n").over(shard)})
    runs = rows.groupBy("rank", "run").agg(F.sum("n").alias("sum"))
    outer = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("rank", "run", none(F.sum("sum").over(outer)).alias("base"))
    return inner.join(runs, ["rank", "run"]).select("shard", "skey", "blocks", "first", "here", "n", (F.col("inside") + F.col("base")).alias("before"))


def slot_table(by_source: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row a filled slot of the output: skey, turn, block, slot and shard.

    Shards and sources are dealt to a stated number of tasks, which adaptive plans leave alone.
    """
    slots = by_source.agg(F.max("all_slots")).first()[0] or 0  # one number
    drawn = shard_counts(by_source, mix).repartition(_tasks(by_source, slots), "shard", "skey")
    rows = drawn.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("j", F.col("before") + F.col("i"))
    rows = rows.where(F.col("j") < F.col("blocks") * mix.passes)
    seed, turn = F.lit(mix.seed), (F.col("j") / F.col("blocks")).cast("long")
    block = permuted(F.col("j") % F.col("blocks"), F.col("blocks"), seed, F.col("skey"), turn)
    place = permuted(F.col("first") + F.col("i"), F.col("here"), seed, F.col("shard"))
    return rows.select("skey", turn.alias("turn"), block.alias("block"), (F.col("shard") * mix.shard_slots + place).alias("slot"), "shard")


def block_table(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row for each document and block that share words: which words of the document those are."""
    b = mix.block
    begin, end = F.col("begin"), F.col("begin") + F.col("size")
    rows = documents.where("size > 0").withColumn("block", F.explode(F.sequence((begin / b).cast("long"), ((end - 1) / b).cast("long"))))
    lo = F.greatest(begin, F.col("block") * b) - begin
    hi = F.least(end, (F.col("block") + 1) * b) - begin
    return rows.select("skey", "block", "doc_id", "text_key", "begin", lo.alias("lo"), hi.alias("hi"))


def mix_plan(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, takes): where each document stands, the targets, and the mix itself.

    ``takes`` has a row for each slot of the output and document in its block: shard, slot, turn,
    skey, block, doc_id, text_key, begin, and the document's words ``lo`` to before ``hi``. Null and blank
    texts have no words and are never taken; a null source is a source of its own. Rows that repeat
    an id are documents of their own, told apart by ``begin``.
    """
    from tallyforge.llm.scratch import Scratch

    # texts are split once; what the later steps read is a few numbers a document
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.keep(sized(docs))
    by_source = scratch.keep(targets(sizes, mix))
    documents = scratch.keep(placed(sizes))
    # the planner takes the slots for as few as the sources that they are made from
    takes = slot_table(by_source, mix).hint("merge").join(block_table(documents, mix), ["skey", "block"])
    return documents, by_source, takes


def mixed_shards(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The output itself: shard, slot, source, and the text of each slot's block, words joined by one space.

    Rows that repeat an id, source and text give their words to blocks one by one.
    """
    documents, _, takes = mix_plan(docs, mix)
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    # one row for equal rows; each begin has its own words of them
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")).alias("row_key"), source_key(docs).alias("skey"), F.xxhash64("text").alias("text_key"), "text").dropDuplicates(["row_key", "skey", "text_key"])
    takes = takes.withColumn("row_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")))
    keys = ["row_key", "skey", "text_key"]
    spans = takes.groupBy(*keys).agg(F.collect_list(F.struct("shard", "slot", "begin", "lo", "hi")).alias("spans"))
    # the words are bound once a row; named as a column, they would be split again for every span
    piece = lambda w, x: F.struct(x["shard"].alias("shard"), x["slot"].alias("slot"), x["begin"].alias("begin"), F.array_join(F.slice(w, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")), " ").alias("piece"))
    made = F.element_at(F.transform(F.array(words), lambda w: F.transform("spans", lambda x: piece(w, x))), 1)
    cut = texts.join(spans.hint("merge"), keys).select("skey", F.explode(made).alias("x"))
    # a block has at most ``block`` pieces
    rows = cut.groupBy("x.shard", "x.slot", "skey").agg(F.sort_array(F.collect_list(F.struct("x.begin", "x.piece"))).alias("pieces"))
    source = F.when(F.startswith("skey", F.lit("v")), F.substring("skey", 2, 1 << 30))
    return rows.select("shard", "slot", source.alias("source"), F.array_join(F.transform("pieces", lambda p: p["piece"]), " ").alias("text"))


def mix_digest(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row a document: size, source_size, target, and the words that the mix takes of it.

    Only doc_id, source and text are read, whatever other columns ``docs`` has. An empty table gives
    an empty one; null, blank and very long texts have the words that they have.
    """
    documents, by_source, takes = mix_plan(docs, mix)
    taken = takes.groupBy("skey", "begin").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    rows = documents.withColumn("begin", F.when(F.col("size") > 0, F.col("begin"))).join(taken.hint("merge"), ["skey", "begin"], "left")
    rows = rows.join(by_source.select("skey", "source_size", "target"), "skey")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as documents: for each pass over a source, the words it takes of each document.

    Rows have the columns of ``docs``; a document that is taken in several passes gives as many
    rows. A text taken as a whole stays as it is, the words of a part are joined by one space.
    Documents of which nothing is taken are left out, as null and blank texts are; rows that agree in
    id, source and text are one. Columns may have any names. An empty table gives an empty one.
    """
    from tallyforge.llm.names import hidden

    names, docs = docs.columns, hidden(docs)
    _, _, takes = mix_plan(docs, mix)
    # a document has at most ``passes`` spans for each of its own blocks
    spans = takes.groupBy("doc_id", "skey", "text_key", "begin", "turn").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"), F.sum(F.col("hi") - F.col("lo")).alias("words"))
    row_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("~")).alias("row_key")
    spans = spans.select(row_key, "skey", "text_key", "spans", "words")
    keyed = docs.select("*", row_key, source_key(docs).alias("skey"), F.xxhash64("text").alias("text_key"))
    keys = ["row_key", "skey", "text_key"]
    joined = keyed.dropDuplicates(keys).join(spans.hint("merge"), keys)
    cut = F.filter(F.split("text", SPACES), lambda w: w != "")
    # the words are bound once a row; named as a column, they would be split again for every span
    taken = lambda words: F.flatten(F.transform("spans", lambda s: F.slice(words, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int"))))
    pieces = F.element_at(F.transform(F.array(cut), taken), 1)
    whole = F.col("words") == word_count(F.col("text"))
    joined = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(pieces, " ")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns).toDF(*names)
