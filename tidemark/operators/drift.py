"""Drift between a reference and a current sample: PSI, two-sample KS, and their report."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.kolmogorov import p_value
from tidemark.functions.scalars import substituted
from tidemark.operators.metrics import melt
from tidemark.operators.priors import quantiles, running_totals

# Limits of the classes.
MODERATE, SIGNIFICANT = 0.10, 0.25


def classify(v: Column) -> Column:
    return F.when(v >= SIGNIFICANT, "SIGNIFICANT").when(v >= MODERATE, "MODERATE").otherwise("stable")


def _long(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    both = melt(ref, features).withColumn("side", F.lit("r")).unionByName(melt(cur, features).withColumn("side", F.lit("c")))
    return both.where(F.col("p").isNotNull() & ~F.isnan("p") & (F.abs("p") != float("inf")))


def psi(ref: DataFrame, cur: DataFrame, features: Sequence[str], bins: int = 10, eps: float = 1e-6, max_levels: int = 20) -> DataFrame:
    """(feature, psi, status, degenerate) of all features in one pass.

    Up to ``max_levels`` values in the reference are compared level by level over both sides' levels; else by bins
    between the reference's quantiles. Fewer than three edges give 0 and ``degenerate``.
    """
    long = _long(ref, cur, features)
    shares = [i / bins for i in range(bins + 1)]
    ref_rows = long.where("side = 'r'")
    edges = ref_rows.groupBy("feature").agg(F.count_distinct("p").alias("levels")).join(quantiles(ref_rows, "p", shares, ["feature"]).select("feature", F.array_distinct("q").alias("edges")), "feature")
    d = long.join(F.broadcast(edges), "feature")  # one row a feature
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    cell = F.when(F.col("levels") <= max_levels, F.col("p")).otherwise(F.size(F.filter(inner, lambda e: e <= F.col("p"))).cast("double"))
    g = d.groupBy("feature", "levels", F.size("edges").alias("n_edges"), cell.alias("cell")).agg(F.sum((F.col("side") == "r").cast("long")).alias("r"), F.sum((F.col("side") == "c").cast("long")).alias("c"))
    every = W.partitionBy("feature")
    e = F.greatest(F.col("r") / F.sum("r").over(every), F.lit(eps))
    a = F.greatest(F.try_divide(F.col("c"), F.sum("c").over(every)), F.lit(eps))
    term = g.select("feature", ((F.col("levels") > max_levels) & (F.col("n_edges") < 3)).alias("degenerate"), ((a - e) * F.log(a / e)).alias("term"))
    return term.groupBy("feature", "degenerate").agg(F.sum("term").alias("psi")).select("feature", F.when(F.col("degenerate"), 0.0).otherwise(F.col("psi")).alias("psi"), "degenerate").withColumn("status", classify(F.col("psi")))


def ks_two_sample(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, ks, p_value): the statistic over all distinct values, and its two-sided probability, exact up to 10,000
    values a side. Rows are not sampled, so large sides have the p-values of their own sizes."""
    g = _long(ref, cur, features).groupBy("feature", "p").agg(F.sum((F.col("side") == "r").cast("long")).alias("r"), F.sum((F.col("side") == "c").cast("long")).alias("c"))
    upto = running_totals(g, {"r_so": "r", "c_so": "c"}, ["p"], ["feature"])
    d = upto.join(F.broadcast(upto.groupBy("feature").agg(F.sum("r").alias("n"), F.sum("c").alias("m"))), "feature")  # a row a feature
    d = d.groupBy("feature", "n", "m").agg(F.max(F.abs(F.try_divide("r_so", "n") - F.try_divide("c_so", "m"))).alias("ks"))
    return d.select("feature", "ks", _p_values(F.col("n"), F.col("m"), F.col("ks")).alias("p_value"))


def _p_values(n: Column, m: Column, ks: Column) -> Column:
    """Null where a side has no values."""

    def each(n: pd.Series, m: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series([p_value(int(a), int(b), float(d)) if d == d and d is not None else None for a, b, d in zip(n, m, ks, strict=True)], dtype="float64")

    return F.pandas_udf(each, "double")(n, m, ks)  # a row a feature


def compare(ref: DataFrame, cur: DataFrame, features: Sequence[str], serving: dict[str, str] | None = None) -> DataFrame:
    """(feature, psi, status, degenerate, ks, p_value, ref_mean, cur_mean, mean_ratio), the worst first. Features without
    finite values on a side are left out; ``serving`` names the columns that the reference side reads in their stead."""
    if serving:
        ref = ref.select(*substituted(features, serving))
    long = _long(ref, cur, features)
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("p")))
    means = long.groupBy("feature").agg(mean("r").alias("ref_mean"), mean("c").alias("cur_mean")).where("ref_mean is not null and cur_mean is not null")
    ratio = F.when(F.col("ref_mean") == 0, float("inf")).otherwise(F.try_divide("cur_mean", "ref_mean"))
    return means.withColumn("mean_ratio", ratio).join(psi(ref, cur, features), "feature").join(ks_two_sample(ref, cur, features), "feature").orderBy(F.desc("psi"), "feature")


def gate(report: DataFrame) -> DataFrame:
    """One row: how many features drift significantly, and whether the gate holds."""
    bad = F.coalesce(F.sum((F.col("status") == "SIGNIFICANT").cast("long")), F.lit(0))
    return report.agg(bad.alias("significant"), F.coalesce(F.sum((F.col("status") == "MODERATE").cast("long")), F.lit(0)).alias("moderate")).withColumn("passed", F.col("significant") == 0)
