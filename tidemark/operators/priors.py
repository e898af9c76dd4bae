"""Sums over all strictly earlier rows, and global row numbers, without a single-partition window.

Borders in the order columns, taken from a sample, cut the rows into ordered chunks: a chunk's number follows from the
row alone, so nothing has to be written to keep it. Totals a chunk and level of all keys come from one aggregate; what
earlier chunks hold of a level enters each chunk as a row of its own, a seed, that stands before the chunk's rows. One
exchange deals rows and seeds to their chunks, and windows inside a chunk do the rest, for any number of keys. Rows are
never gathered in one task, also not those of one frequent key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.storage import n_partitions, written

_BEGIN = W.unboundedPreceding
_BEFORE = (_BEGIN, -1)
SAMPLE = 20_000  # rows from which borders are taken; they decide how even chunks are, nothing else
CHUNKS_A_PARTITION = 2
CHUNK_ROWS = 1 << 17  # of a chunk, about, at most; larger tables have more chunks, so that a task's memory doesn't grow


def _n_chunks(df: DataFrame) -> tuple[int, int]:
    """How many chunks ``df`` is cut into by default, and its rows."""
    n = df.count()
    return max(CHUNKS_A_PARTITION * n_partitions(df.sparkSession), -(-n // CHUNK_ROWS)), n


def _borders(df: DataFrame, order_by: Sequence[str], chunks: int, sample: int, n: int) -> DataFrame:
    """One row: ``__borders``, up to chunks - 1 ascending values of the order columns, of a sample of about so many rows, chosen by hash."""
    names = [f"o{i}" for i in range(len(order_by))]
    o = df.select(*[F.col(c).alias(n) for c, n in zip(order_by, names, strict=True)])
    every = max(1, n // sample)
    picked = o.where(F.pmod(F.xxhash64(*names), F.lit(every)) == 0) if every > 1 else o
    held = F.sort_array(F.collect_list(F.struct(*names)))  # of the sample
    step = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(chunks - 1)), lambda i: F.element_at("held", F.greatest(F.lit(1), (i * F.size("held") / chunks).cast("int"))))) if chunks > 1 else None
    one = picked.agg(held.alias("held"))
    return one.select(F.when(F.size("held") > 0, step).alias("__borders") if chunks > 1 else F.lit(None).cast(f"array<{one.schema['held'].dataType.elementType.simpleString()}>").alias("__borders"))


def with_chunks(df: DataFrame, order_by: Sequence[str], chunks: int | None = None, sample: int = SAMPLE, n: int | None = None) -> DataFrame:
    """``df`` of ``n`` rows, if known, with ``__chunk``: the number of borders at or before the row, by halving. Ordered as
    ``order_by``, nulls first."""
    if chunks is None:
        chunks, n = _n_chunks(df)
    n, sample = df.count() if n is None else n, max(sample, SAMPLE, 32 * chunks)
    here = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)])
    d = df.withColumn("__here", here).join(F.broadcast(_borders(df, order_by, chunks, sample, n))).withColumn("__chunk", F.lit(0))  # one row
    for step in [1 << i for i in reversed(range(chunks.bit_length()))]:
        further = F.col("__chunk") + step
        d = d.withColumn("__chunk", F.when(F.coalesce(F.get("__borders", further - 1) <= F.col("__here"), F.lit(False)), further).otherwise(F.col("__chunk")))
    return d.drop("__here", "__borders")


def with_priors(df: DataFrame, order_by: Sequence[str], sums: dict[str, Column], keys: dict[str, Column | None], chunks: int | None = None) -> DataFrame:
    """``df`` with ``<key>_<sum>_prior``, the sum over strictly earlier rows of the same level of the key, and
    ``<key>_<sum>_all``, over all of them; names of the empty key begin with the sum.

    sums: name -> a number a row. keys: name -> its level (null is a level of its own), or None for all rows. ``order_by``
    must be a total order. An empty table gives no rows.
    """
    names, levels = list(sums), {f"__k{i}": F.lit(None).cast("string") if c is None else c.cast("string") for i, c in enumerate(keys.values())}
    n_chunks, n = (chunks, None) if chunks else _n_chunks(df)
    d = with_chunks(df, order_by, n_chunks, n=n).withColumns({**{f"__s{j}": F.coalesce(c, F.lit(0)) for j, c in enumerate(sums.values())}, **levels})
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(k).alias("level")) for i, k in enumerate(levels)])).alias("x")
    totals = d.select("__chunk", *[f"__s{j}" for j in range(len(names))], each).groupBy("__chunk", "x.i", "x.level").agg(*[F.sum(f"__s{j}").alias(f"__s{j}") for j in range(len(names))])
    every = W.partitionBy("i", "level")  # a row a chunk
    seeds = totals.select(
        "__chunk", F.col("i").alias("__seed"), *[F.when(F.col("i") == i, F.col("level")).alias(k) for i, k in enumerate(levels)],
        *[F.coalesce(F.sum(f"__s{j}").over(every.orderBy("__chunk").rowsBetween(*_BEFORE)), F.lit(0)).alias(f"__s{j}") for j in range(len(names))], *[F.sum(f"__s{j}").over(every).alias(f"__a{j}") for j in range(len(names))],
    )
    line = d.unionByName(seeds, allowMissingColumns=True).repartitionById(n_chunks, F.col("__chunk"))  # a task a chunk
    for i, (key, level) in enumerate(zip(keys, levels, strict=True)):
        # a number first: rows are told apart by it before anything else is compared
        line = line.withColumn("__h", F.xxhash64("__chunk", level))
        before = W.partitionBy("__h", "__chunk", level).orderBy(F.asc_nulls_last("__seed"), *order_by).rowsBetween(*_BEFORE)
        mine = F.col("__seed").isNull() | (F.col("__seed") == i)
        head = f"{key}_" if key else ""
        line = line.withColumns({f"{head}{n}_prior": F.sum(F.when(mine, F.col(f"__s{j}"))).over(before) for j, n in enumerate(names)} | {f"{head}{n}_all": F.max(F.when(mine, F.col(f"__a{j}"))).over(before) for j, n in enumerate(names)})
    out = [f"{key}_{n}_{x}" if key else f"{n}_{x}" for key in keys for n in names for x in ("prior", "all")]
    return line.where("__seed is null").select(*[F.col(f"`{c}`") for c in df.columns], *out)


def prior_sums(df: DataFrame, value: str, order_by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``value_prior`` and ``count_prior`` over all earlier rows, and ``<key>_value_prior`` and
    ``<key>_count_prior`` over earlier rows of the same level, for each key. A null level is a level."""
    d = with_priors(df, order_by, {"value": F.col(value), "count": F.lit(1).cast("long")}, {"": None, **{k: F.col(k) for k in keys}})
    return d.drop(*[c for c in d.columns if c.endswith(("value_all", "count_all")) and c not in df.columns])


def _level(within: Sequence[str]) -> Column | None:
    return F.to_json(F.struct(*within)) if within else None


def global_row_number(df: DataFrame, order_by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``row_no`` from 1 in the order of ``order_by`` and ``rows_in_all``, inside ``within``."""
    d = with_priors(df, order_by, {"__one": F.lit(1).cast("long")}, {"": _level(within)})
    return d.withColumns({"row_no": F.col("__one_prior") + 1, "rows_in_all": F.col("__one_all")}).drop("__one_prior", "__one_all")


def rank_share(prior: Column, n: Column) -> Column:
    """The percent rank of a row with ``prior`` rows before it, of ``n``."""
    return F.when(n > 1, prior / (n - 1)).otherwise(0.0)


def percent_rank(df: DataFrame, order_by: Sequence[str], within: Sequence[str]) -> DataFrame:
    """``df`` with ``percent_rank`` inside ``within``; ``order_by`` must be a total order there."""
    d = global_row_number(df, order_by, within)
    return d.withColumn("percent_rank", rank_share(F.col("row_no") - 1, F.col("rows_in_all"))).drop("row_no", "rows_in_all")


def running_totals(df: DataFrame, sums: dict[str, str], order_by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """``df`` with the sums up to and with each row in the order of ``order_by``, a total order inside ``within``.

    sums: name of the running sum -> column. Rows where a column of ``within`` is null are left out. ``df`` is read three
    times, so it is written first: it holds counts a distinct value, not rows.
    """
    df = written(df, "counts")
    for c in within:
        df = df.where(F.col(c).isNotNull())
    d = with_priors(df, [*within, *order_by], {n: F.col(c) for n, c in sums.items()}, {"__t": _level(within)})
    return d.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"__t_{n}_prior") + F.coalesce(F.col(c), F.lit(0))).alias(n) for n, c in sums.items()])


def quantiles(df: DataFrame, column: str, shares: Sequence[float], within: Sequence[str] = ()) -> DataFrame:
    """(within, ``q``): the exact quantiles of the column's values, by linear interpolation, as an array in order of
    ``shares``; nulls don't count. Works on counts of distinct values in ranges: no task holds all of them."""
    g = df.where(F.col(column).isNotNull()).groupBy(*within, F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    d = running_totals(g, {"__upto": "__n"}, ["__v"], within)
    totals = d.groupBy(*within).agg(F.sum("__n").alias("__all"))
    d = d.join(F.broadcast(totals), list(within)) if within else d.crossJoin(F.broadcast(totals))  # a few groups; one row
    every = F.transform(F.array(*[F.lit(float(x)) for x in shares]), lambda x, i: F.struct(i.alias("i"), (x * (F.col("__all") - 1)).alias("h")))
    near = F.filter(every, lambda s: (F.floor(s.h) < F.col("__upto")) & (F.ceil(s.h) >= F.col("__upto") - F.col("__n")))
    x = d.select(*within, "__v", "__n", "__upto", F.explode(near).alias("s"))
    here = lambda at: (at < F.col("__upto")) & (at >= F.col("__upto") - F.col("__n"))
    low, high = F.floor("s.h"), F.ceil("s.h")
    one = x.groupBy(*within, F.col("s.i").alias("i"), F.col("s.h").alias("h")).agg(F.max(F.when(here(low), F.col("__v"))).alias("lo"), F.max(F.when(here(high), F.col("__v"))).alias("hi"))
    value = F.when((F.floor("h") == F.ceil("h")) | (F.col("lo") == F.col("hi")), F.col("lo")).otherwise((F.ceil("h") - F.col("h")) * F.col("lo") + (F.col("h") - F.floor("h")) * F.col("hi"))
    return one.groupBy(*within).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s.v).alias("q"))
