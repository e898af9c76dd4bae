"""Shards by a hierarchical weighted hash tree: region, rack, shard, each level a weighted hash draw.

A node draws for a key with -ln(u) / weight, u from a hash of key and node; the least draw wins, so that a node wins in
proportion to its weight, and another node's weight never changes its draw. A changed weight therefore moves keys only
into the subtree that grew, out of the one that shrank, and inside them.

Weight that is added later stands as a layer of its own: a region's later weight draws beside its earlier one, and
what it wins descends only to the racks and shards to which that weight belongs. So a shard that is added to an old rack
takes keys only into itself, although its rack and region weigh more than before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import Scratch, table, text_or_empty
from tidemark.llm.flat import mix

FILE_BYTES = 128 << 20  # of text in a shard's file, about


@dataclass(frozen=True)
class Leaf:
    """A shard's place and weight; ``layer`` is the number of the extension that brought the weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0
    layer: int = 0


@dataclass
class _Node:
    seed: np.uint64 = np.uint64(0)
    weight: float = 0.0
    shard: int = -1
    below: dict[str, _Node] = field(default_factory=dict)


def _seed(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


class Tree:
    """Shards under racks under regions. A tree never changes: ``grown`` and ``reweighted`` give others."""

    def __init__(self, leaves: Sequence[Leaf]):
        if not any(x.weight > 0 for x in leaves):
            raise ValueError("no shard has a weight")
        self.leaves = tuple(leaves)
        self.root = _Node()
        for x in leaves:
            node = self.root
            for name in (f"{x.region}@{x.layer}", f"{x.region}/{x.rack}@{x.layer}", f"{x.region}/{x.rack}/{x.shard}@{x.layer}"):
                node = node.below.setdefault(name, _Node(_seed(name)))
                node.weight += max(x.weight, 0.0)
            node.shard = x.shard

    @classmethod
    def even(cls, regions: int, racks: int, shards: int) -> Tree:
        """So many regions, racks a region and shards a rack, all of weight 1, numbered from 0."""
        return cls([Leaf(f"region{i // (racks * shards)}", f"rack{i // shards}", i) for i in range(regions * racks * shards)])

    def grown(self, region: str, rack: str, weight: float = 1.0) -> Tree:
        """With one more shard, numbered after the last, in an old or new rack."""
        return Tree([*self.leaves, Leaf(region, rack, 1 + max(x.shard for x in self.leaves), weight, 1 + max(x.layer for x in self.leaves))])

    def reweighted(self, shard: int, weight: float) -> Tree:
        return Tree([Leaf(x.region, x.rack, x.shard, weight, x.layer) if x.shard == shard else x for x in self.leaves])

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The shard of each 64-bit key."""
        out = np.full(len(keys), -1, np.int32)
        todo = [(self.root, np.arange(len(keys)))]
        while todo:
            node, rows = todo.pop()
            if not node.below:
                out[rows] = node.shard
                continue
            best, won = np.full(len(rows), np.inf), np.full(len(rows), -1)
            live = [n for n in node.below.values() if n.weight > 0]
            for i, child in enumerate(live):
                u = ((mix(keys[rows] ^ child.seed) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53  # (0, 1]
                draw = -np.log(u) / child.weight
                less = (draw < best) | (won < 0)
                best[less], won[less] = draw[less], i
            todo += [(child, rows[won == i]) for i, child in enumerate(live) if (won == i).any()]
        return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key of any type. Null is a key as well: all rows without one share a shard."""

    def place(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in hashes:
            yield pd.Series(tree.place(mix(h.to_numpy(np.int64).astype(np.uint64))))

    return F.pandas_udf(place, "int")(F.xxhash64(key))


def write_shards(docs: DataFrame, tree: Tree, more: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` as one folder a shard and reads them back: (shard, slot, grown_shard and the columns of ``docs``).

    ``slot`` numbers a shard's rows from 0 as they stand in its files, in ascending key order inside each file, null
    first. ``grown_shard`` is the row's shard under ``more``, null without it. Files take about FILE_BYTES of text,
    whatever a shard weighs; rows are dealt to a shard's files by a hash of row and input split, so that equal keys,
    texts and rows spread. Null and empty texts are rows like others; columns of ``docs`` with the new names are left out.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "op12")
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot", "grown_shard")]
    placed = docs.select(*kept, shard_of(F.col(key), tree).alias("shard"), (shard_of(F.col(key), more) if more else F.lit(None).cast("int")).alias("grown_shard"))
    total = {r.shard: r.n for r in docs.select(shard_of(F.col(key), tree).alias("shard"), F.octet_length(text_or_empty(text)).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    files = {s: 1 + n // FILE_BYTES for s, n in sorted(total.items())}
    first = dict(zip(files, np.cumsum([0, *files.values()]).tolist(), strict=False))
    plan = spark.createDataFrame([(s, first[s], files[s]) for s in files], "__s int, __first int, __files long")  # a row a shard
    spread = F.pmod(F.xxhash64(key, text, F.spark_partition_id()), F.col("__files")).cast("int")
    dealt = placed.join(F.broadcast(plan), F.col("shard") == F.col("__s")).withColumn("__file", F.col("__first") + spread).drop("__s", "__first", "__files")
    out = dealt.repartitionById(max(1, sum(files.values())), F.col("__file")).drop("__file").sortWithinPartitions("shard", key)
    out.write.partitionBy("shard").parquet(f"{tmp.path}/shards")
    if not files:
        return placed.withColumn("slot", F.lit(0).cast("long")).select("shard", "slot", "grown_shard", *kept)
    held = spark.read.schema(out.schema).parquet(f"{tmp.path}/shards").select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"))
    before = W.partitionBy("shard").orderBy("__path").rowsBetween(W.unboundedPreceding, -1)  # a row a file
    starts = held.groupBy("shard", "__path").agg(F.count("*").alias("n")).select("__path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return held.join(starts, "__path").select("shard", (F.col("__start") + F.col("__at")).cast("long").alias("slot"), "grown_shard", *kept)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards in two regions of two racks; the grown tree has a seventeenth in the first rack."""
    tree = Tree.even(2, 2, 4)
    held = write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), tree, tree.grown("region0", "rack0"))
    text = text_or_empty()
    return held.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
