"""The bipartite graph of cards and merchants over training rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import n_partitions, written

BLOCK_EDGES = 1 << 22  # about so many edges in a block (16 MB of codes)


def positive_keys(train: DataFrame, key: str, label: str) -> DataFrame:
    return train.where(F.col(label) == 1).select(key).distinct()


def edges(train: DataFrame, left: str, right: str) -> DataFrame:
    return train.select(left, right).dropDuplicates()


def right_nodes(e: DataFrame, bad: DataFrame, left: str, right: str) -> DataFrame:
    """Per merchant: its cards and its fraud cards."""
    flagged = e.join(bad.withColumn("__bad", F.lit(1)), left, "left")
    return flagged.groupBy(right).agg(F.count("*").alias("merchant_card_degree"), F.count("__bad").alias("merchant_fraud_card_cnt"))


def left_nodes(e: DataFrame, bad: DataFrame, left: str) -> DataFrame:
    """Per card: its merchants, and whether it is a fraud card."""
    flagged = e.join(bad.withColumn("__bad", F.lit(1)), left, "left")
    return flagged.groupBy(left).agg(F.count("*").alias("card_merchant_degree"), F.max(F.coalesce("__bad", F.lit(0))).alias("card_is_fraud"))


def _listed(x: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _packed(batches: Iterator[pa.RecordBatch], at_most: int) -> Iterator[pa.RecordBatch]:
    """Rows (card, merchant, bad) in order of the card as few rows (block, keys, ends, bad, items, codes): the merchants of a
    card are the places in ``items`` that the codes up to its end name. A card's rows stay in one block row, which holds about
    ``at_most`` of them."""
    block = TaskContext.get().partitionId()

    def one(t: pa.Table) -> pa.RecordBatch:
        keys, items = (t.column(i).combine_chunks().dictionary_encode(null_encoding="encode") for i in (0, 1))
        at, codes = (np.asarray(c.indices) for c in (keys, items))
        ends = np.cumsum(np.bincount(at, minlength=len(keys.dictionary)), dtype=np.int32)
        bad = np.bincount(at, weights=t.column(2).to_numpy(), minlength=len(keys.dictionary)) > 0
        codes = codes[np.argsort(at, kind="stable")].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *map(_listed, (keys.dictionary, pa.array(ends), pa.array(bad), items.dictionary, pa.array(codes)))], ["block", "keys", "ends", "bad", "items", "codes"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= at_most:
            t = pa.Table.from_batches(held)
            before = pc.index(t.column(0), t.column(0)[n - 1]).as_py()  # rows of earlier keys than the last; nulls come first
            if before > 0:
                yield one(t.slice(0, before))
                held, n = t.slice(before).to_batches(), n - before
    if n:
        yield one(pa.Table.from_batches(held))


def _unpacked(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """A block's keys, how many codes each has, which are bad, items and codes."""
    return row["keys"].values, np.diff(np.asarray(row["ends"].values), prepend=0), row["bad"].values.to_numpy(zero_copy_only=False).astype(bool), row["items"].values, np.asarray(row["codes"].values)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i] for c in b.schema.names}


def _union_sizes(ends: np.ndarray, shop: np.ndarray, upto: np.ndarray, members: np.ndarray, sparse: int | None) -> np.ndarray:
    """Of each card, whose merchants are ``shop`` up to its end (-1: none of these), how many members its merchants have
    together; the members of a merchant stand in ``members`` up to its end. Merchants of more than ``sparse`` are bitmaps."""
    size = np.diff(upto, prepend=0)
    card = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[shop >= 0]
    shop = shop[shop >= 0]
    words = int(members.max(initial=0)) // 64 + 1
    dense = size > (max(16, words // 2) if sparse is None else sparse)
    row, bits = np.cumsum(dense) - 1, np.zeros((int(dense.sum()), words * 8), np.uint8)
    for s in np.flatnonzero(dense):
        mine = np.zeros(words * 64, np.uint8)
        mine[members[upto[s] - size[s] : upto[s]]] = 1
        bits[row[s]] = np.packbits(mine, bitorder="little")
    bits, is_wide = bits.view(np.uint64), dense[shop]
    wide, few, few_card = row[shop[is_wide]], shop[~is_wide], card[~is_wide]
    n_wide, n_few = np.bincount(card[is_wide], minlength=len(ends)), np.bincount(few_card, minlength=len(ends))
    wide_at, few_at = np.cumsum(n_wide) - n_wide, np.cumsum(n_few) - n_few
    out, step = np.zeros(len(ends), np.int64), max(1, (1 << 15) // words)
    for k in np.unique(n_wide):  # cards of equally many bitmaps at once
        for listed in (False, True):
            alike = np.flatnonzero((n_wide == k) & ((n_few > 0) == listed))
            for lo in range(0, len(alike) if k or listed else 0, step):
                some = alike[lo : lo + step]
                union = bits[wide[wide_at[some]]] if k else np.zeros((len(some), words), np.uint64)
                for j in range(1, k):
                    union |= bits[wide[wide_at[some] + j]]
                if listed:
                    edges = _ranges(few_at[some], n_few[some])
                    n = size[few[edges]]
                    marks = np.zeros((len(some), words * 64), np.uint8)
                    marks.ravel()[np.repeat(np.repeat(np.arange(len(some)), n_few[some]) * (words * 64), n) + members[_ranges(upto[few[edges]] - n, n)]] = 1
                    union |= np.packbits(marks, axis=1, bitorder="little").view(np.uint64)
                out[some] = np.bitwise_count(union).sum(axis=1, dtype=np.int64)
    return out


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``n`` of them, one after another."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def _side(spark) -> int:
    """Blocks a side, so that there are about four pairs a task."""
    return math.isqrt(4 * n_partitions(spark) - 1) + 1


def blocks_of(marked: DataFrame, left: str, right: str, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """Distinct edges (card, merchant, ``__bad``: 1 for a fraud card's, or on one edge of it at least) in blocks of whole cards."""
    of_left, of_right = (marked.schema[c].dataType.simpleString() for c in (left, right))
    rows = marked.select(left, right, "__bad").repartition(_side(marked.sparkSession), left).sortWithinPartitions(left)
    return rows.mapInArrow(lambda b: _packed(b, block_edges), f"block int, keys array<{of_left}>, ends array<int>, bad array<boolean>, items array<{of_right}>, codes array<int>")


def _kinds(blocks: DataFrame) -> tuple[str, str]:
    """The types of cards and merchants."""
    return tuple(blocks.schema[c].dataType.elementType.simpleString() for c in ("keys", "items"))


def card_nodes(blocks: DataFrame, left: str, sparse: int | None = None) -> DataFrame:
    """Per card: its merchants, whether it is a fraud card, and distinct other fraud cards that share a merchant.

    A task a pair of blocks counts the fraud cards of one block that the merchants of each card of the other have together, by
    bitmaps for merchants of many and lists for others; fraud cards are in one block each, so a card's counts add up. Blocks
    are shuffled once, and what a pair of them makes is a number a card: neither pairs of cards nor sets a card are ever
    shuffled or written. A null merchant is a merchant of its card and links nothing, nor does a null card.
    """
    (of_left, of_right), n = _kinds(blocks), _side(blocks.sparkSession)

    def by_merchant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, size, bad, items, codes = _unpacked(row)
            its = np.repeat(bad, size) & ~items.is_null().to_numpy(zero_copy_only=False)[codes]
            at, card = codes[its], np.repeat(np.cumsum(bad) - 1, size)[its].astype(np.int32)
            have = np.bincount(at, minlength=len(items))
            ends = np.cumsum(have[have > 0], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"].as_py()], pa.int32()), _listed(items.filter(pa.array(have > 0))), _listed(pa.array(ends)), _listed(pa.array(card[np.argsort(at, kind="stable")]))], ["f_block", "f_keys", "f_ends", "f_codes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            cards, ends, shops, codes, theirs, upto, members = (row[c].values for c in ("keys", "ends", "items", "codes", "f_keys", "f_ends", "f_codes"))
            place = pc.fill_null(pc.index_in(shops, value_set=theirs, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
            found = _union_sizes(np.asarray(ends), place[np.asarray(codes)], np.asarray(upto), np.asarray(members), sparse)
            yield pa.RecordBatch.from_arrays([cards, pa.array(found)], [left, "__n"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            cards, size, bad, _, _ = _unpacked(row)
            yield pa.RecordBatch.from_arrays([cards, pa.array(size.astype(np.int64)), pa.array(bad.astype(np.int32))], [left, "__degree", "__bad"])

    fraud = blocks.mapInArrow(by_merchant, f"f_block int, f_keys array<{of_right}>, f_ends array<int>, f_codes array<int>").repartitionById(n, F.col("f_block")).drop("f_block")
    pairs = blocks.select("block", "keys", "ends", "items", "codes").repartitionById(n, F.col("block")).drop("block").join(fraud.hint("shuffle_replicate_nl"))
    every = blocks.mapInArrow(own, f"{left} {of_left}, __degree long, __bad int").withColumn("__n", F.lit(0).cast("long"))
    one = every.unionByName(pairs.mapInArrow(count, f"{left} {of_left}, __n long"), allowMissingColumns=True)
    one = one.groupBy(left).agg(F.sum("__degree").alias("card_merchant_degree"), F.max("__bad").alias("card_is_fraud"), F.sum("__n").alias("__n"))
    # a fraud card is among those of its own merchants, if it has any
    hops = F.when(F.col(left).isNull(), F.lit(0)).otherwise(F.greatest(F.col("__n") - F.col("card_is_fraud"), F.lit(0)))
    return one.select(left, "card_merchant_degree", "card_is_fraud", hops.cast("long").alias("card_2hop_fraud_cards"))


def merchant_nodes(blocks: DataFrame, right: str) -> DataFrame:
    """Per merchant: its cards and its fraud cards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, size, bad, items, codes = _unpacked(row)
            n = (np.bincount(c, minlength=len(items)).astype(np.int64) for c in (codes, codes[np.repeat(bad, size)]))
            yield pa.RecordBatch.from_arrays([items, *map(pa.array, n)], [right, "n", "n_bad"])

    per = blocks.mapInArrow(run, f"{right} {_kinds(blocks)[1]}, n long, n_bad long")
    per = per.groupBy(right).agg(F.sum("n").alias("merchant_card_degree"), F.sum("n_bad").alias("merchant_fraud_card_cnt"))
    return written(per, "merchants")  # its size is known then: rows are shuffled to merchants only if these are many


def card_lists(blocks: DataFrame, left: str, right: str) -> DataFrame:
    """Per card: the list of its merchants, named ``right``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            cards, size, _, items, codes = _unpacked(row)
            ends = np.cumsum(size)
            for lo in range(0, len(cards), 10_000):
                some = slice(lo, lo + 10_000)
                first = ends[lo] - size[lo]
                mine = items.take(pa.array(codes[first : ends[some][-1]]))
                yield pa.RecordBatch.from_arrays([cards[some], pa.ListArray.from_arrays(pa.array(np.append(0, ends[some] - first).astype(np.int32)), mine)], [left, right])

    of_left, of_right = _kinds(blocks)
    return blocks.mapInArrow(run, f"{left} {of_left}, {right} array<{of_right}>")


def two_hop(e: DataFrame, bad: DataFrame, left: str, right: str, sparse: int | None = None, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """Per card: distinct other fraud cards that share a merchant."""
    marked = e.join(bad.select(left).distinct().withColumn("__bad", F.lit(1)), left, "left").withColumn("__bad", F.coalesce("__bad", F.lit(0)))
    return card_nodes(blocks_of(marked, left, right, block_edges), left, sparse).select(left, "card_2hop_fraud_cards")


def edge_blocks(train: DataFrame, left: str = "cc_num", right: str = "merchant", label: str = "is_fraud") -> DataFrame:
    """The graph of ``train`` in blocks, written once: all node features come from them, so rows are read and edges are shuffled
    no more than once for all."""
    bad = F.coalesce((F.col(left).isNotNull() & (F.col(label) == 1)).cast("int"), F.lit(0))
    return written(blocks_of(train.groupBy(left, right).agg(F.max(bad).alias("__bad")), left, right), "edges")


def edges_with_graph(blocks: DataFrame, left: str = "cc_num", right: str = "merchant") -> DataFrame:
    """The edges with all node features: cards join with lists of merchants, which are rows of their own after that."""
    d = card_lists(blocks, left, right).join(card_nodes(blocks, left), left, "left").withColumn(right, F.explode(right))
    return with_graph(d, None, merchant_nodes(blocks, right), left, right)


def with_graph(rows: DataFrame, cards: DataFrame | None, merchants: DataFrame, left: str = "cc_num", right: str = "merchant") -> DataFrame:
    """Node features on rows (``cards`` None: the rows have those of their card already); a fraud card takes itself out of its
    merchant's count whether or not it is in it."""
    d = rows.join(merchants, right, "left")
    d = d if cards is None else d.join(cards, left, "left")
    zero = F.lit(0)
    is_bad, degree = F.coalesce("card_is_fraud", zero), F.coalesce("merchant_card_degree", zero)
    cnt = F.greatest(F.coalesce("merchant_fraud_card_cnt", zero) - is_bad, zero)
    return d.withColumns(
        {
            "merchant_fraud_card_cnt": cnt,
            "merchant_fraud_card_ratio": F.when(degree - 1 > 0, cnt / (degree - 1)).otherwise(0.0),
            "merchant_card_degree": degree,
            "card_merchant_degree": F.coalesce("card_merchant_degree", zero),
            "card_2hop_fraud_cards": F.coalesce("card_2hop_fraud_cards", zero),
        }
    ).drop("card_is_fraud")


def density(e: DataFrame, left: str, right: str) -> DataFrame:
    return e.agg(F.count("*").alias("edges"), F.count_distinct(left).alias("cards"), F.count_distinct(right).alias("merchants")).withColumn("density", F.try_divide(F.col("edges"), F.col("cards") * F.col("merchants")))
