"""Data-quality gates: each gives the rows that break a rule, so that an empty result is a pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.settings import DAY_US
from tidemark.sources.transactions import micros

#: The runtime contract's ranges (fixed values): column -> (least, most), None for no bound.
RANGES: dict[str, tuple[float | None, float | None]] = {
    "amt": (0, None), "distance_km": (0, None), "night": (0, 1), "hour": (0, 23), "day_of_week": (0, 6), "is_online": (0, 1), "category_risk": (0, 1), "state_risk": (0, 1), "merchant_risk": (0, 1),
    "card_txn_cnt": (0, None), "card_mean_amt": (0, None), "card_std_amt": (0, None), "txns_24h": (0, None), "txns_7d": (0, None), "hour_sin": (-1, 1), "hour_cos": (-1, 1),
}


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def contract_violations(df: DataFrame, key: str, features: Sequence[str], ranges: Mapping[str, tuple[float | None, float | None]] = RANGES) -> DataFrame:
    """(rule, violations) of every broken rule, over all rows in one pass: absent columns, null keys, values that are
    not finite, values out of range."""
    spark = df.sparkSession
    absent = [c for c in [key, *features] if c not in df.columns]
    here = [c for c in features if c in df.columns]
    rules: dict[str, Column] = {} if key in absent else {f"null:{key}": F.col(key).isNull()}
    for c in here:
        rules[f"finite:{c}"] = ~_finite(c)
        lo, hi = ranges.get(c, (None, None))
        if lo is not None or hi is not None:
            low = F.lit(False) if lo is None else F.col(c) < lo
            rules[f"range:{c}"] = _finite(c) & (low | (F.lit(False) if hi is None else F.col(c) > hi))
    rows = [(f"missing:{c}", 1) for c in absent]
    out = spark.createDataFrame(rows, "rule string, violations long")
    if rules:
        one = df.agg(*[F.coalesce(F.sum(v.cast("long")), F.lit(0)).alias(r) for r, v in rules.items()])
        found = one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("violations")) for r in rules])).alias("x")).select("x.*")
        out = out.unionByName(found.where("violations > 0"))
    return out


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, nulls), one pass."""
    cols = list(columns or df.columns)
    one = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(c, F.lit(0)).alias("nulls")) for c in cols])).alias("x")).select("x.*")


def class_distribution(df: DataFrame, split: str = "dataset_split", label: str = "is_fraud") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"), F.sum(label).alias("positives")).withColumn("positive_pct", F.round(F.lit(100.0) * F.col("positives") / F.col("n"), 3))


def row_count_gap(df: DataFrame, expected: int) -> DataFrame:
    return df.agg(F.count("*").alias("actual")).withColumn("expected", F.lit(expected).cast("long")).where("actual <> expected")


def counts_before(df: DataFrame, key: str, ts: str, ident: str, days: int) -> DataFrame:
    """(ident, expected): how many rows of the key lie in the ``days`` before each row, itself and its peers left out.

    Not by range frames: each row asks at its time and at ``days`` before how many rows came earlier; the running count
    over rows and questions in time answers both, and the difference is the window's count.
    """
    us = micros(ts)
    d = df.select(key, F.col(ident).alias("ident"), us.alias("at"))
    asks = d.select(key, "ident", F.explode(F.array(F.struct(F.col("at").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("at") - days * DAY_US).alias("at"), F.lit(-1).alias("sign")))).alias("q"))
    line = d.select(key, "ident", "at", F.lit(1).alias("mark"), F.lit(0).alias("sign")).unionByName(asks.select(key, "ident", "q.at", F.lit(0).alias("mark"), "q.sign"))
    so = F.sum("mark").over(W.partitionBy(key).orderBy("at", "mark").rowsBetween(W.unboundedPreceding, 0))  # questions before rows of the same time
    return line.withColumn("so", so).where("mark = 0").groupBy("ident").agg(F.sum(F.col("so") * F.col("sign")).alias("expected")).withColumnRenamed("ident", ident)


def history_not_prior(mart: DataFrame, key: str = "cc_num", ts: str = "trans_date_trans_time", ident: str = "trans_num") -> DataFrame:
    """Rows whose card count isn't that of the 90 days before them, or whose key's first event has velocity."""
    d = mart.select(key, ts, ident, F.col("card_txn_cnt").alias("recorded"), "txns_24h", "txns_7d").join(counts_before(mart, key, ts, ident, 90), ident)
    first = d.join(mart.groupBy(key).agg(F.min(ts).alias("first_ts")), key)
    return first.where((F.col("recorded") != F.col("expected")) | ((F.col(ts) == F.col("first_ts")) & ((F.col("txns_24h") != 0) | (F.col("txns_7d") != 0)))).select(ident, "recorded", "expected")


def window_bounds(mart: DataFrame, ts: str = "trans_date_trans_time") -> DataFrame:
    """One row: the last development time, the first locked one, and what makes the lock fail."""
    role, split = F.col("evaluation_role"), F.col("dataset_split")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return mart.agg(
        F.max(F.when(role == "development_holdout", F.col(ts))).alias("last_development"),
        F.min(F.when(role == "locked_evaluation", F.col(ts))).alias("first_locked"),
        count(role == "development_holdout").alias("development_rows"),
        count(role == "locked_evaluation").alias("locked_rows"),
        count((split == "train") & (role != "model_development")).alias("train_in_test_roles"),
    )


def window_not_locked(mart: DataFrame, ts: str = "trans_date_trans_time") -> DataFrame:
    return window_bounds(mart, ts).where("development_rows = 0 or locked_rows = 0 or train_in_test_roles > 0 or last_development > first_locked")


def degenerate_scale(mart: DataFrame, limit: float = 1000.0, least: int = 5) -> DataFrame:
    z, r = F.col("amt_z_card"), F.col("amt_over_mean_card")
    return mart.where(((F.col("card_txn_cnt") < least) & (z != 0)) | (F.abs(z) > limit) | (F.abs(r) > limit)).select("trans_num", "card_txn_cnt", "amt_z_card", "amt_over_mean_card")


def encoding_not_temporal(mart: DataFrame, key: str, label: str = "is_fraud", ts: str = "trans_date_trans_time", recorded: str | None = None, m: float = 20.0, cold: float = 0.005, tolerance: float = 1e-10, ident: str = "trans_num") -> DataFrame:
    """Training rows whose encoding differs from its reconstruction, and those that have none.

    The reconstruction shares nothing with the encoder: totals a day, and a day and level, summed over the days before,
    and windows inside a day for the rest, the smoothing written out. No task holds a level's rows.
    """
    recorded = recorded or f"{key}_risk"
    train = mart.where("dataset_split = 'train'").withColumn("__day", F.to_date(ts))
    none, before = F.lit(0), lambda *of: W.partitionBy(*of).orderBy("__day").rowsBetween(W.unboundedPreceding, -1)  # noqa: E731  # a row a day
    running = lambda d, s, c, w: [F.coalesce(F.sum("s").over(w), none).alias(s), F.coalesce(F.sum("c").over(w), none).alias(c)]
    per = train.groupBy("__day", F.col(key).alias("__level")).agg(F.sum(label).alias("s"), F.count("*").alias("c"))
    days = per.groupBy("__day").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    days, levels = days.select("__day", *running(days, "s0", "c0", before())), per.select(F.col("__day").alias("__of"), "__level", *running(per, "k0", "n0", before("__level")))
    in_day, in_level = (W.partitionBy("__day", *c).orderBy(ts, ident).rowsBetween(W.unboundedPreceding, -1) for c in ((), (key,)))
    d = train.repartition("__day").withColumns({"s1": F.coalesce(F.sum(label).over(in_day), none), "c1": F.count("*").over(in_day), "k1": F.coalesce(F.sum(label).over(in_level), none), "n1": F.count("*").over(in_level)})
    d = d.join(levels, (F.col("__day") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__level"))).withColumns({"ks": F.col("k0") + F.col("k1"), "kc": F.col("n0") + F.col("n1")})
    d = d.join(F.broadcast(days), "__day")
    rate = F.coalesce(F.try_divide((F.col("s0") + F.col("s1")).cast("double"), F.col("c0") + F.col("c1")), F.lit(cold))
    d = d.withColumn("expected", (F.col("ks") + F.lit(m) * rate) / (F.col("kc") + F.lit(m)))
    return d.where(F.col(recorded).isNull() | (F.abs(F.col(recorded) - F.col("expected")) > tolerance)).select(ident, F.col(recorded).alias("recorded"), "expected")


def split_stats(df: DataFrame, features: Sequence[str], split: str = "dataset_split") -> DataFrame:
    """(feature, train_mean, test_mean, train_zero, test_zero): long form, then one pivot."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")
    long = df.select(split, pairs).select(split, "x.*")
    g = long.groupBy("feature").pivot(split, ["train", "test"]).agg(F.avg("v").alias("mean"), F.avg((F.col("v") == 0).cast("double")).alias("zero"))
    return g.select("feature", *[F.col(f"{s}_{m}") for m in ("mean", "zero") for s in ("train", "test")])


def serving_skew(df: DataFrame, features: Sequence[str] = ("txns_24h", "txns_7d"), low: float = 0.5, high: float = 2.0, gap: float = 0.25) -> DataFrame:
    """(feature, rule, value) of features whose test mean or share of zeros is far from train; no ratio is a violation."""
    s = split_stats(df, features).withColumn("ratio", F.try_divide("test_mean", "train_mean"))
    bad_ratio = s.where(F.col("ratio").isNull() | ~F.col("ratio").between(low, high)).select("feature", F.lit("mean_ratio").alias("rule"), F.col("ratio").alias("value"))
    zero = F.abs(F.col("test_zero") - F.col("train_zero"))
    return bad_ratio.unionByName(s.where(zero > gap).select("feature", F.lit("zero_fraction").alias("rule"), zero.alias("value")))


def audit_pack(df: DataFrame, key: str, required: Sequence[str], expected_rows: int | None = None, non_negative: Sequence[str] = ()) -> DataFrame:
    """(check_name, value, passed): rows, columns, nulls, duplicates and negatives as one table."""
    spark = df.sparkSession
    absent = [c for c in required if c not in df.columns]
    aggs = [F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"nulls:{c}") for c in required if c in df.columns]]
    aggs += [F.sum((F.col(c) < 0).cast("long")).alias(f"negative:{c}") for c in non_negative]
    one = df.agg(*aggs)
    checks = [("row_count", F.col("rows"), F.lit(True) if expected_rows is None else F.col("rows") == expected_rows), ("duplicate_keys", F.col("rows") - F.col("distinct_keys"), F.col("rows") == F.col("distinct_keys"))]
    checks += [(a, F.coalesce(F.col(f"`{a}`"), F.lit(0)), F.coalesce(F.col(f"`{a}`"), F.lit(0)) == 0) for a in one.columns if ":" in a]
    out = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), v.cast("long").alias("value"), p.alias("passed")) for n, v, p in checks])).alias("x")).select("x.*")
    return out.unionByName(spark.createDataFrame([("missing_columns", len(absent), not absent)], "check_name string, value long, passed boolean"))


def pipeline_checks(df: DataFrame, score: str, critical: Sequence[str], split: str = "dataset_split", feature: str = "txns_24h") -> DataFrame:
    """(check_name, value, passed) after a run: nulls in critical columns, velocity ratio, scores strictly inside (0, 1)."""
    s = split_stats(df, [feature], split).select((F.try_divide("test_mean", "train_mean")).alias("ratio"))
    one = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in critical], F.sum((~F.col(score).between(0, 1) | F.col(score).isin(0.0, 1.0) | F.col(score).isNull()).cast("long")).alias("__s")).crossJoin(F.broadcast(s))
    checks = [(f"nulls:{c}", F.col(c).cast("double"), F.col(c) == 0) for c in critical]
    checks += [("velocity_ratio", F.col("ratio"), F.coalesce(F.col("ratio").between(0.5, 2.0), F.lit(False))), ("scores_out_of_range", F.col("__s").cast("double"), F.col("__s") == 0)]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), v.alias("value"), p.alias("passed")) for n, v, p in checks])).alias("x")).select("x.*")
