"""Exact metrics of scored rows: ranking, thresholds, costs, calibration, subgroups.

Scored rows are first grouped by score; everything cumulative then runs over distinct scores, cut into ranges: totals a
range are summed first, then the rows inside each, so scores may be as many as rows. Groups (``by``) are few; rows
without a group are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.priors import quantiles, running_totals


def score_table(scores: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y", weight: str | None = None) -> DataFrame:
    """(by, p, pos, n, tp, seen, total_pos, total): counts a distinct score, and cumulative ones at or above it."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    g = scores.groupBy(*by, F.col(p).alias("p")).agg(F.sum(F.col(y) * w).alias("pos"), F.sum(w).alias("n"))
    d = running_totals(g.withColumn("__down", -F.col("p")), {"tp": "pos", "seen": "n"}, ["__down"], by).drop("__down")
    totals = d.groupBy(*by).agg(F.sum("pos").alias("total_pos"), F.sum("n").alias("total"))
    return d.join(F.broadcast(totals), list(by)) if by else d.crossJoin(F.broadcast(totals))  # a row a group; one row


def average_precision(scores: DataFrame, by: Sequence[str] = (), **cols) -> DataFrame:
    """Step sum over distinct scores in descending order; null without positives."""
    t = score_table(scores, by, **cols)
    return t.groupBy(*by).agg(F.sum(F.try_divide("pos", "total_pos") * (F.col("tp") / F.col("seen"))).alias("average_precision"))


def roc_auc(scores: DataFrame, by: Sequence[str] = (), **cols) -> DataFrame:
    """Mid-rank form, ties counted half; null without both classes."""
    t = score_table(scores, by, **cols)
    neg, below = F.col("n") - F.col("pos"), (F.col("total") - F.col("total_pos")) - (F.col("seen") - F.col("tp"))
    term = F.col("pos") * (below + neg / 2.0)
    return t.groupBy(*by).agg(F.try_divide(F.sum(term), F.max(F.col("total_pos") * (F.col("total") - F.col("total_pos"))).cast("double")).alias("roc_auc"))


def confusion(scores: DataFrame, threshold: float | Column, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, pos = F.col(p) >= thr, F.col(y) == 1
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    d = scores.groupBy(*by).agg(count(hit & pos).alias("tp"), count(hit & ~pos).alias("fp"), count(~hit & pos).alias("fn"), count(~hit & ~pos).alias("tn"))
    zero = F.lit(0.0)
    d = d.withColumns({"precision": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero), "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero)})
    return d.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))


def threshold_f1(scores: DataFrame, by: Sequence[str] = (), **cols) -> DataFrame:
    """(threshold, f1): the best of all distinct scores, the least threshold of equals; 0.5 without positives."""
    t = score_table(scores, by, **cols)
    pr, rc = F.col("tp") / F.col("seen"), F.try_divide("tp", "total_pos")
    t = t.withColumn("f1", F.coalesce(2 * pr * rc / (pr + rc + 1e-12), F.lit(0.0)))
    return t.groupBy(*by).agg(F.when(F.max("total_pos") > 0, F.max_by("p", F.struct("f1", -F.col("p")))).otherwise(0.5).alias("threshold"), F.max("f1").alias("f1"))


def cost_at(scores: DataFrame, threshold: float, review_cost: float = 25.0, by: Sequence[str] = (), p: str = "p", y: str = "y", amt: str = "amt") -> DataFrame:
    """Alerts, hits, misses and their cost at one threshold."""
    d = confusion(scores, threshold, by, p, y)
    lost = F.sum(F.when((F.col(p) < threshold) & (F.col(y) == 1), F.col(amt)).otherwise(0.0)).alias("missed_amt")
    saved = F.sum(F.when((F.col(p) >= threshold) & (F.col(y) == 1), F.col(amt)).otherwise(0.0)).alias("recovered_amt")
    money = scores.groupBy(*by).agg(lost, saved)
    d = d.join(money, list(by)) if by else d.crossJoin(F.broadcast(money))  # one row each
    d = d.withColumns({"alerts": F.col("tp") + F.col("fp"), "review": (F.col("tp") + F.col("fp")) * F.lit(review_cost)})
    return d.withColumn("total_cost", F.col("missed_amt") + F.col("review")).drop("tn", "f1")


def _cuts(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """The distinct quantiles in order: as many numbers as shares at most."""
    found = quantiles(df, column, shares).first()
    return sorted(set(found.q)) if found else []


def threshold_grid(scores: DataFrame, n: int = 400, low: float = 0.90, high: float = 0.9999, p: str = "p") -> list[float]:
    """Distinct quantiles of the score: ``n`` numbers at most."""
    share = [low + (high - low) * i / (n - 1) for i in range(n)]
    return _cuts(scores, p, share)


def cost_curve(scores: DataFrame, grid: Sequence[float], review_cost: float = 25.0, p: str = "p", y: str = "y", amt: str = "amt") -> DataFrame:
    """One row a threshold: rows fall into the bucket of the thresholds at or below them, then sums from above."""
    edges = F.array(*[F.lit(float(t)) for t in grid])
    bucket = F.size(F.filter(edges, lambda t: t <= F.col(p)))
    g = scores.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(y).alias("pos"), F.sum(F.when(F.col(y) == 1, F.col(amt)).otherwise(0.0)).alias("bad"))
    spark = scores.sparkSession
    base = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "bucket int, threshold double").join(g, "bucket", "full_outer").na.fill(0, ["n", "pos"]).na.fill(0.0, ["bad"])
    up = W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, 0)  # as many rows as thresholds
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = base.select("threshold", F.sum("n").over(up).alias("alerts"), F.sum("pos").over(up).alias("tp"), F.sum("pos").over(every).alias("all_pos"), (F.sum("bad").over(every) - F.sum("bad").over(up)).alias("missed_amt")).where("threshold is not null")
    return d.select("threshold", "alerts", "tp", (F.col("alerts") - F.col("tp")).alias("fp"), (F.col("all_pos") - F.col("tp")).alias("fn"), F.coalesce(F.try_divide("tp", "alerts"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", "all_pos"), F.lit(0.0)).alias("recall"), "missed_amt", (F.col("missed_amt") + F.col("alerts") * F.lit(review_cost)).alias("total_cost"))


def operating_points(scores: DataFrame, days: int, budget_per_day: float = 10.0, review_cost: float = 25.0, n: int = 400) -> DataFrame:
    """(point, threshold, ...): the cheapest threshold, and the one nearest to the alert budget; ties to the least."""
    curve = cost_curve(scores, threshold_grid(scores, n), review_cost)
    budget = F.abs(F.col("alerts") - F.lit(float(budget_per_day * days)))
    cols = F.struct(*curve.columns)
    one = curve.agg(F.min_by(cols, F.struct(F.round("total_cost", 6), "threshold")).alias("cost_minimising"), F.min_by(cols, F.struct(budget, "threshold")).alias("alert_budget"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("point"), *[F.col(f"{x}.{c}").alias(c) for c in curve.columns]) for x in ("cost_minimising", "alert_budget")])).alias("x")).select("x.*")


def uniform_edges(bins: int) -> list[float]:
    return [i / bins for i in range(1, bins)]


def quantile_edges(scores: DataFrame, bins: int, p: str = "p") -> list[float]:
    """Interior edges at the score's quantiles, without repeats."""
    return _cuts(scores, p, [i / bins for i in range(1, bins)])


def reliability(scores: DataFrame, edges: Sequence[float], by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """(by, bin, n, mean_p, mean_y, gap): a bin holds its lower edge, the last one both."""
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(p))) if len(edges) else F.lit(0)
    return scores.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y")).withColumn("gap", F.abs(F.col("mean_p") - F.col("mean_y")))


def calibration(scores: DataFrame, edges: Sequence[float] | None = None, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """(by, rows, brier, ece, mce, base_rate, brier_skill)."""
    t = reliability(scores, uniform_edges(10) if edges is None else edges, by, p, y)
    e = t.groupBy(*by).agg(F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))
    b = scores.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"), F.avg(y).alias("base_rate"))
    d = e.join(b, list(by)) if by else e.crossJoin(F.broadcast(b))  # one row each
    return d.withColumn("brier_skill", 1.0 - F.try_divide(F.col("brier"), F.col("base_rate") * (1.0 - F.col("base_rate"))))


def alert_region(scores: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    return calibration(scores.where(F.col(p) >= threshold), uniform_edges(5), p=p)


def amount_bands(scores: DataFrame, amt: str = "amt", bands: int = 4) -> DataFrame:
    """``scores`` with ``amount_band``: quantile bands closed above, the least value in the first, equal edges merged."""
    edges = _cuts(scores, amt, [i / bands for i in range(1, bands)])
    return scores.withColumn("amount_band", F.concat(F.lit("q"), (F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(amt))) + 1).cast("string")) if edges else F.lit("q1"))


def subgroups(scores: DataFrame, threshold: float, slices: Sequence[str], min_rows: int = 100, min_positives: int = 5, p: str = "p", y: str = "y") -> DataFrame:
    """(slice_name, slice_value, n, positives, alert_rate, precision, recall, brier) of groups with enough support; all slices in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("slice_name"), F.coalesce(F.col(s).cast("string"), F.lit("<missing>")).alias("slice_value")) for s in slices])).alias("s")
    d = scores.select(p, y, pairs).select(p, y, "s.*")
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    g = d.groupBy("slice_name", "slice_value").agg(F.count("*").alias("n"), F.sum(y).alias("positives"), F.sum((hit & pos).cast("long")).alias("tp"), F.sum(hit.cast("long")).alias("alerts"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"))
    return g.where((F.col("n") >= min_rows) & (F.col("positives") >= min_positives)).select("slice_name", "slice_value", "n", "positives", (F.col("alerts") / F.col("n")).alias("alert_rate"), F.coalesce(F.try_divide("tp", "alerts"), F.lit(0.0)).alias("precision"), F.try_divide("tp", "positives").alias("recall"), "brier")


def score_summary(scores: DataFrame, by: Sequence[str] = (), p: str = "p") -> DataFrame:
    one = scores.groupBy(*by).agg(F.min(p).alias("min_p"), F.max(p).alias("max_p"), F.avg(p).alias("mean_p"), F.stddev_pop(p).alias("std_p"))
    mid = quantiles(scores, p, [0.5], by).select(*by, F.get("q", F.lit(0)).alias("median_p"))
    d = one.join(F.broadcast(mid), list(by), "left") if by else one.join(F.broadcast(mid), how="left")  # a row a group
    return d.select(*by, "min_p", "max_p", "mean_p", "median_p", "std_p")


def histogram(scores: DataFrame, bins: int = 10, p: str = "p") -> DataFrame:
    """(bin, n): equal widths on [0, 1], the last bin closed."""
    return scores.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) of every pair of columns, one pass."""
    pairs = [(x, z) for i, x in enumerate(columns) for z in columns[i:]]
    one = df.agg(*[F.corr(x, z).alias(f"{x}|{z}") for x, z in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(z).alias("b"), F.col(f"`{x}|{z}`").alias("corr")) for x, z in pairs])).alias("x")).select("x.*")


def melt(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("p")) for f in features])).alias("x")
    return df.select(*keep, pairs).select(*keep, "x.*")


def univariate_power(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, roc_auc, pr_auc, lift, verdict): each feature as a score of the label."""
    long = melt(df, features, label).withColumnRenamed(label, "y").where("p is not null")
    ap, auc = average_precision(long, ["feature"]), roc_auc(long, ["feature"])
    base = long.groupBy("feature").agg(F.avg("y").alias("base"), F.count_distinct("p").alias("levels"))
    away = F.abs(F.col("roc_auc") - 0.5)
    verdict = F.when(F.col("levels") < 2, "no signal").when(away < 0.02, "none").when(away < 0.10, "weak").otherwise("useful")
    return base.join(ap, "feature").join(auc, "feature").select("feature", "roc_auc", F.col("average_precision").alias("pr_auc"), F.try_divide("average_precision", "base").alias("lift"), verdict.alias("verdict"))


def operating_metrics(scores: DataFrame, threshold: float, by: Sequence[str] = (), p: str = "p", y: str = "y", us: str = "ts_us") -> DataFrame:
    """AP, Brier, alerts, alerts a day, precision and recall at a threshold."""
    from tidemark.functions.scalars import elapsed_days

    c = confusion(scores, threshold, by, p, y)
    m = scores.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"), elapsed_days(F.min(us), F.max(us)).alias("days"))
    ap = average_precision(scores, by, p=p, y=y)
    d = c.join(m, list(by)).join(ap, list(by)) if by else c.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(ap))  # one row each
    return d.select(*by, "average_precision", "brier", (F.col("tp") + F.col("fp")).alias("alerts"), ((F.col("tp") + F.col("fp")) / F.col("days")).alias("alerts_per_day"), "precision", "recall")


def model_comparison(scores: DataFrame, champion: str = "ensemble", p: str = "p", y: str = "y") -> DataFrame:
    """(model, average_precision, roc_auc, brier, is_best, champion_is_best) of scores in long form with ``model``."""
    d = average_precision(scores, ["model"], p=p, y=y).join(roc_auc(scores, ["model"], p=p, y=y), "model").join(scores.groupBy("model").agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier")), "model")
    best = d.agg(F.max_by("model", F.struct("average_precision", "model")).alias("best"))
    return d.crossJoin(F.broadcast(best)).select("model", "average_precision", "roc_auc", "brier", (F.col("model") == F.col("best")).alias("is_best"), (F.col("best") == champion).alias("champion_is_best"))  # one row


def triggered(scores: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    return scores.withColumn("triggered", F.col(p) >= threshold)


def top_alerts(scores: DataFrame, k: int = 1, by: Sequence[str] = (), p: str = "p", key: str = "trans_num") -> DataFrame:
    """The k best-scored triggered rows (of each group); an error with the greatest score if none is triggered."""
    hit = scores.where("triggered")
    if by:
        return hit.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(p), key))).where(F.col("rank") <= k)
    if not hit.limit(1).count():
        raise ValueError(f"no alert is triggered; the greatest score is {scores.agg(F.max(p)).first()[0]}")
    return hit.orderBy(F.desc(p), key).limit(k)
