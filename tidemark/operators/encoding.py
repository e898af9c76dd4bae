"""Target encodings: prequential for training rows, frozen for rows to score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.priors import with_priors


def smoothed(total: Column, n: Column, prior: Column, m: float) -> Column:
    return (total + m * prior) / (n + m)


def level_totals(train: DataFrame, key: str, label: str) -> DataFrame:
    return train.groupBy(key).agg(F.sum(label).alias("level_sum"), F.count("*").alias("level_n"))


def train_sums(label: str, split: str = "dataset_split") -> dict[str, Column]:
    """What ``with_priors`` sums for the encodings: labels, rows and labelled rows of the training part."""
    train = F.col(split) == "train"
    return {"value": F.when(train, F.col(label)), "count": train.cast("long"), "known": (train & F.col(label).isNotNull()).cast("long")}


def encoded(d: DataFrame, keys: Sequence[str], split: str = "dataset_split", m: float = 20.0, cold: float = 0.005) -> DataFrame:
    """``d``, which has the priors of ``train_sums`` over all rows and each key, with ``<key>_risk`` and ``<key>_risk_serving``.

    Training rows are encoded from strictly earlier training rows, shrunk to the earlier overall rate; all rows by the
    frozen map of the whole training part for serving, where an unseen level gets the overall rate.
    """
    rate, overall = F.coalesce(F.try_divide("value_prior", "count_prior"), F.lit(cold)), F.try_divide("value_all", "known_all")
    out = {}
    for k in keys:
        frozen = F.when(F.col(f"{k}_count_all") > 0, smoothed(F.col(f"{k}_value_all"), F.col(f"{k}_count_all"), overall, m))
        out[f"{k}_risk_serving"] = F.coalesce(frozen, overall)
        out[f"{k}_risk"] = F.when(F.col(split) == "train", smoothed(F.col(f"{k}_value_prior"), F.col(f"{k}_count_prior"), rate, m)).otherwise(out[f"{k}_risk_serving"])
    return d.withColumns(out)


def target_encode(df: DataFrame, keys: Sequence[str], label: str, order_by: Sequence[str], split: str = "dataset_split", m: float = 20.0, cold: float = 0.005) -> DataFrame:
    """All rows with ``<key>_risk`` (prequential in train, frozen elsewhere) and ``<key>_risk_serving`` (frozen); one
    exchange of rows for all keys. Rows of no split are left out."""
    d = with_priors(df.where(F.col(split).isNotNull()), order_by, train_sums(label, split), {"": None, **{k: F.col(k) for k in keys}})
    return encoded(d, keys, split, m, cold).select(*df.columns, *[f"{k}_risk{x}" for k in keys for x in ("", "_serving")])


def encoding_map(df: DataFrame, key: str, label: str, order_by: Sequence[str], ident: str, split: str = "dataset_split", m: float = 20.0, cold: float = 0.005) -> DataFrame:
    """(ident, <key>_risk, <key>_risk_serving): one map of one encoding for all rows, training and scoring parts united.

    For callers that keep maps as tables; ``join_maps`` puts them back on rows.
    """
    d = df.select(ident, key, label, split, *[c for c in order_by if c not in (ident, key, label, split)])
    return target_encode(d, [key], label, order_by, split, m, cold).select(ident, f"{key}_risk", f"{key}_risk_serving")


def join_maps(df: DataFrame, maps: Sequence[DataFrame], ident: str) -> DataFrame:
    """``df`` with the columns of each map, null where a map doesn't have the row."""
    for one in maps:
        df = df.join(one, ident, "left")
    return df


def in_sample_mean(rows: DataFrame, train: DataFrame, key: str, label: str) -> DataFrame:
    """The leaky encoding, kept to show that the gates catch it: a level's own mean, 0 if unseen."""
    means = train.groupBy(key).agg(F.avg(label).alias("__mean"))
    return rows.join(means, key, "left").withColumn(f"{key}_leaky", F.coalesce("__mean", F.lit(0.0))).drop("__mean")
