"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import Scratch, n_partitions, shared_dir, written

__all__ = ["WORD", "Scratch", "n_partitions", "shared_dir", "table", "text_or_empty", "with_ids", "without_ids", "written"]

#: One word of the contracts: a run of anything but blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
FILTER_BITS = 1 << 27  # of an id filter at most: 16 MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _maybe(ids: DataFrame, column: str) -> Column:
    """Whether a row's id may be among ``ids``: a Bloom filter with one hash, eight bits an id, FILTER_BITS at most.

    Where it says no, the row need not be shuffled to find out; beyond its bound it says yes too often, no more.
    """
    bits = min(FILTER_BITS, max(1 << 15, 1 << (8 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    maps = ids.groupBy(F.bitmap_bucket_number(at + 1).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits")).collect()
    held = np.zeros(bits // 8, np.uint8)
    for r in maps:
        held[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    known = ids.sparkSession.sparkContext.broadcast(held)

    def hit(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in places:
            p = p.to_numpy(np.int64)
            yield pd.Series((known.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool))

    return F.pandas_udf(hit, "boolean")(at)


def with_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``; few others are shuffled."""
    return docs.where(_maybe(ids, column)).hint("merge").join(ids, column, "left_semi").select(*docs.columns)


def without_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``ids``; few of them are shuffled. A null id is in nothing."""
    maybe = _maybe(ids, column)
    rest = docs.where(maybe).hint("merge").join(ids, column, "left_anti").select(*docs.columns)
    return docs.where(~maybe).unionByName(rest)
