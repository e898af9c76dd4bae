"""The registry that the query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its doubles rounded, and its integers and counts as longs."""
    out = []
    for n, t in df.dtypes:
        c = F.col(f"`{n}`")
        if n not in skip and t == "double":
            c = F.round(c, places)
        elif n not in skip and t in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(n))
    return df.select(*out)
