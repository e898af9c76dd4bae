"""Mixing sources to target weights.

Each source's words are packed into blocks of a fixed length. A source's target, in words, gives its number of slots,
which are drawn into output shards: a shard's source counts are multinomial draws given the sources' totals. A source's
slots are numbered shard after shard, a slot's number goes through the source's own pseudorandom permutation to a
block's index, shards are written as (slot, block) and blocks are joined to them by index. A second pass over the
blocks begins only when the first is through: nothing is taken three times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import WORD, Scratch, n_partitions, table

BLOCK = 64  # words
SHARD_SLOTS = 4096  # on average
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
ROUNDS = 16
CHUNK_WORDS, LEAST_CHUNKS = 1 << 20, 64  # of all sources, about; the data alone decide how many chunks a source has
SEED = 29


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target and ``no`` (its place by code point, null last) from (source, source_size).

    The sources share ``share`` times all words by weight; none gets more than ``cap`` times its size, and what is over
    goes to the others by weight. With t = min(cap * size, level * weight), the level follows from running sums in the
    order of cap * size / weight. One row a source is all that meets in one task.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("no") % len(weights)).cast("int") + 1)
    s = sizes.withColumn("no", (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1).cast("long"))
    s = s.withColumns({"w": w, "most": F.col("source_size") * cap})
    upto = W.orderBy(F.col("most") / F.col("w"), "no")
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumns({"most_so": F.sum("most").over(upto), "w_so": F.sum("w").over(upto), "w_all": F.sum("w").over(every), "budget": F.sum("source_size").over(every) * share})
    s = s.withColumn("full", F.col("most_so") + F.col("most") / F.col("w") * (F.col("w_all") - F.col("w_so")) <= F.col("budget"))
    none = F.lit(0.0)
    level = F.try_divide(F.col("budget") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(none)).over(every), F.col("w_all") - F.sum(F.when(F.col("full"), F.col("w")).otherwise(none)).over(every))
    return s.withColumn("level", level).select("no", "source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("w"))).alias("target"))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1: in each round x may swap places with its mirror image about a keyed point."""

    def swap(a: Column, r: Column) -> Column:
        mirror = F.pmod(F.xxhash64(F.lit(SEED), r, *key) - a, n)
        return F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), r, F.greatest(a, mirror), *key), F.lit(2)) == 0, mirror).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap)


def placed(rows: DataFrame, tags: DataFrame, words: int) -> DataFrame:
    """``rows`` (source, doc_id, size, tie) with their source's columns and ``at``, the source's words before them.

    Two phases, so that no source needs a task of its own: totals of hashed chunks, then running sums within a chunk.
    ``words`` is the size of all rows: the same rows have the same places in any session.
    """
    chunk = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(max(LEAST_CHUNKS, words // CHUNK_WORDS)))
    r = rows.join(tags, rows.source.eqNullSafe(tags.source)).drop(tags.source).withColumn("chunk", chunk)
    totals = r.groupBy("no", "chunk").agg(F.sum("size").alias("words"))
    totals = totals.withColumn("before", F.sum("words").over(W.partitionBy("no").orderBy("chunk")) - F.col("words")).drop("words")
    own = W.partitionBy("no", "chunk").orderBy("doc_id", "tie", "size")
    within = F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return r.withColumns({"within": within, "rn": F.row_number().over(own)}).join(totals, ["no", "chunk"]).withColumn("at", F.col("before") + F.col("within")).drop("before", "within")


def shard_counts(tags: DataFrame, shards: int) -> DataFrame:
    """(no, shard, n, first): how many of a source's slots each shard draws, and the number of the first.

    Each slot draws one of the shards: counts are multinomial given the source's total.
    """
    many = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / SHARD_SLOTS))
    runs = tags.where("n_slots > 0").select("no", "n_slots", F.explode(many).alias("run")).repartition(n_partitions(tags.sparkSession), "no", "run")
    draws = runs.select("no", F.explode(F.sequence(F.col("run") * SHARD_SLOTS, F.least(F.col("n_slots"), (F.col("run") + 1) * SHARD_SLOTS) - 1)).alias("t"))
    counts = draws.groupBy("no", F.pmod(F.xxhash64(F.lit(SEED + 2), "no", "t"), F.lit(shards)).alias("shard")).agg(F.count("*").alias("n"))
    # running counts in two phases: over groups of shards, then within each
    counts = counts.withColumn("group", F.floor(F.col("shard") / SHARD_SLOTS))
    before = counts.groupBy("no", "group").agg(F.sum("n").alias("m"))
    before = before.select("no", "group", (F.sum("m").over(W.partitionBy("no").orderBy("group")) - F.col("m")).alias("before"))
    within = F.sum("n").over(W.partitionBy("no", "group").orderBy("shard")) - F.col("n")
    return counts.withColumn("within", within).join(before, ["no", "group"]).select("no", "shard", "n", (F.col("before") + F.col("within")).alias("first"))


def slots(tags: DataFrame, counts: DataFrame) -> DataFrame:
    """(shard, no, slot, turn, block): the shards; ``turn`` is the pass over the source's blocks that the slot is in."""
    c = counts.join(tags.select("no", "n_blocks"), "no").repartition(n_partitions(tags.sparkSession), "shard")
    s = c.select("shard", "no", "n_blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    s = s.withColumn("turn", F.floor(F.col("slot") / F.col("n_blocks")))
    return s.select("shard", "no", "slot", "turn", permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.col("no"), F.col("turn")).alias("block"))


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("source").cast("string"), F.col("doc_id").cast("long"), size.alias("size"), F.xxhash64(F.col("text").cast("string")).alias("tie"))


def shard_pieces(docs: DataFrame) -> DataFrame:
    """The mix: one row a piece (a document's words in one block) and slot that takes it, with the columns of ``placed``.

    shard, slot, turn: where it stands (null: not taken); first, n: its words in the document (null: it has none).
    """
    tmp = Scratch(docs.sparkSession, "op8")
    rows = tmp.write(sized(docs), "sizes")
    tags = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    blocks = F.ceil(F.col("source_size") / BLOCK)
    tags = tmp.write(tags.withColumns({"n_blocks": blocks, "n_slots": F.coalesce(F.round(F.try_divide(F.col("target") * blocks, F.col("source_size"))), F.lit(0)).cast("long")}), "sources")
    all_slots, all_words = (x or 0 for x in tags.agg(F.sum("n_slots"), F.sum("source_size")).first())
    shards = max(1, all_slots // SHARD_SLOTS)
    drawn = tmp.write(slots(tags, shard_counts(tags, shards)), "shards")
    span = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK)))
    pieces = placed(rows, tags, all_words).withColumn("block", F.explode_outer(span))
    first = F.greatest(F.col("block") * BLOCK, F.col("at"))
    pieces = pieces.withColumns({"first": first - F.col("at"), "n": F.least((F.col("block") + 1) * BLOCK, F.col("at") + F.col("size")) - first})
    return pieces.hint("merge").join(drawn, ["no", "block"], "left")


def mix(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted).

    Null texts have no words. A null source is a source of its own, last in order; a null doc_id is a document like
    others. Rows that share a doc_id are separate documents. Other columns are not read. Equal inputs give equal mixes.
    """
    cols = ["no", "chunk", "rn", "source", "doc_id", "size", "source_size", "target"]
    taken = F.sum(F.when(F.col("shard").isNotNull(), F.col("n")).otherwise(0)).cast("long")
    return shard_pieces(docs).groupBy(*cols).agg(taken.alias("taken")).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: one row for each pass that takes words of a document.

    Where a pass takes all its words the text stays as it is; else it is the words taken, a blank between. ``n_chars``
    follows the text. Documents without words stay once. Null ids, sources and texts are as in ``mix``; an empty table
    gives no rows. Texts are shuffled once.
    """
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    took = F.array_sort(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("turn", "first", "n"))))
    per = shard_pieces(docs).groupBy("no", "chunk", "rn", ident.alias("__id"), F.col("tie").alias("__tie"), "size").agg(took.alias("took"))
    # rows with one id and text take these in order of source
    per = per.groupBy("__id", "__tie").agg(F.sort_array(F.collect_list(F.struct("no", "chunk", "rn", "size", "took"))).alias("__per"))
    d = docs.withColumns({"__id": ident, "__tie": F.xxhash64(F.col("text").cast("string"))}).hint("merge").join(per, ["__id", "__tie"])
    same = F.row_number().over(W.partitionBy("__id", "__tie").orderBy(F.asc_nulls_last(F.col("source").cast("string"))))
    d = d.withColumn("__own", F.get("__per", same - 1)).drop("__per")
    d = d.withColumn("__pass", F.explode(F.when(F.col("__own.size") == 0, F.array(F.lit(-1))).otherwise(F.array(F.lit(0), F.lit(1)))))
    d = d.withColumn("__took", F.filter("__own.took", lambda p: p.turn == F.col("__pass"))).where("__pass < 0 or size(__took) > 0")
    whole = F.aggregate("__took", F.lit(0).cast("long"), lambda a, p: a + p.n) == F.col("__own.size")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("__took", lambda p: F.slice(F.col("__words"), (p.first + 1).cast("int"), p.n.cast("int")))), " ")
    d = d.withColumn("__words", F.when(~whole, words)).withColumn("text", F.when((F.col("__pass") < 0) | whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
