"""Quality selection by importance resampling.

Two generative models over hashed words and word pairs, one of target text and one of all raw text, give each document
the logarithm of its importance weight. Sums of unlike length are held against what good documents of that length have
(their mean and spread); this standing over a temperature, plus Gumbel noise, is the key whose k largest are the sample:
draws without replacement in proportion to exp(standing / temperature). Noise decides among documents whose standings
are within about a temperature. k is a parameter; where it isn't given, it is the number of documents that stand, before
noise, as high as a share ``keep`` of the labelled target documents does that the model was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, table
from tidemark.llm.flat import mix, slices, view, word_hashes

BUCKETS = 1 << 14
LABELLED = 20_000  # bound of the sample of labelled target documents
KEEP = 0.999
SEED = 17
TEMPERATURE = 0.1  # in deviations of good documents
_ODD = np.uint64(0x9FB21C651E98DF25)


def ngram_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and every pair of neighbouring words."""
    h, rows = word_hashes(data, offs)
    pair = mix(h[:-1] * _ODD ^ h[1:])
    same = rows[:-1] == rows[1:] if len(rows) else np.zeros(0, bool)
    size = np.uint64(BUCKETS)
    return np.concatenate([h % size, pair[same] % size]).astype(np.int64), np.concatenate([rows, rows[1:][same]])


def bucket_counts(docs: DataFrame, target: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts a bucket over the target rows and over all rows. target: doc_ids, LABELLED at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch):
                at, rows = ngram_buckets(*view(part.column("text")))
                total[1] += np.bincount(at, minlength=BUCKETS)
                chosen = part.column("target").to_numpy(zero_copy_only=False).astype(bool)
                total[0] += np.bincount(at[chosen[rows]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], ["bucket", "target", "raw"])

    flagged = docs.join(F.broadcast(target.select("doc_id", F.lit(True).alias("target"))), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    rows = flagged.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()
    out = np.zeros((2, BUCKETS))
    for r in rows:  # one row a bucket
        out[:, r.bucket] = r.target, r.raw
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    return np.log((target + smooth) / (target.sum() + smooth * len(target))) - np.log((raw + smooth) / (raw.sum() + smooth * len(raw)))


def with_weight(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``docs`` with ``log_weight``, the log importance weight of each text (0 without words), and ``__ngrams``, their number."""
    known = docs.sparkSession.sparkContext.broadcast(ratio)
    docs = docs.drop("log_weight", "__ngrams")
    schema = T.StructType([*docs.schema, T.StructField("log_weight", T.DoubleType()), T.StructField("__ngrams", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, rows = ngram_buckets(*view(part.column("text")))
                part = part.append_column("log_weight", pa.array(np.bincount(rows, known.value[at], part.num_rows).astype(np.float64)))
                yield part.append_column("__ngrams", pa.array(np.bincount(rows, minlength=part.num_rows).astype(np.int64)))

    return docs.mapInArrow(run, schema)


def gumbel(column: str = "doc_id", seed: int = SEED) -> Column:
    """Gumbel noise that depends on the id and the seed alone, so that a task that runs again draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def spread(n: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """(mean, own, shared) of log weights: of n n-grams the mean is n * mean, the variance n * own + n^2 * shared.

    The n-grams of one document lean the same way, so its sum does not spread with the root of its length alone.
    """
    n, weights = np.asarray(n, float), np.asarray(weights, float)
    mean = weights.sum() / max(n.sum(), 1.0)
    over = (weights - n * mean) ** 2
    w = 1 / (1 + n)
    a, y = np.stack([n * w, n * n * w], 1), over * w
    got = np.linalg.lstsq(a, y, rcond=None)[0]
    if (got < 0).any():  # one of both alone
        got = np.where(got < 0, 0.0, (a * y[:, None]).sum(0) / np.maximum((a * a).sum(0), 1e-300))
    return float(mean), float(got[0]), float(got[1])


def standing(fit: tuple[float, float, float]) -> Column:
    """log_weight in deviations from what good documents of as many n-grams have."""
    mean, own, shared = fit
    n = F.col("__ngrams")
    return (F.col("log_weight") - n * F.lit(mean)) / F.sqrt(1 + n * F.lit(own) + n * n * F.lit(shared))


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value, by histograms that narrow down: only bin counts reach the driver."""
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo:
            break
        at = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
        got = keys.where(F.col(column).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("bin")).collect()
        for b in got:
            if b.n >= k:
                lo, hi = b.lo, b.hi
                break
            k -= b.n
    return lo


def target_ids(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """Labelled documents of good quality and not toxic: ``bound`` at most, by a hash of their id."""
    per = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return per.where("q = 1 and coalesce(t, 0) = 0").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, k: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """The sampled rows of ``docs`` with ``log_weight`` and ``sample_key``.

    Null and empty texts have weight 0 and compete like others; without held-out labelled targets and without ``k`` every
    row stays. Rows that share a doc_id draw the same noise; rows that tie with the k-th key all stay; a k of as many as
    there are rows keeps all. Other columns pass through.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    tmp = Scratch(docs.sparkSession, "op1")
    target = tmp.write(target_ids(labels), "target")
    held = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(5)) == 0  # a fifth judges, the rest is fitted
    found, raw = bucket_counts(docs.select("doc_id", "text"), target.where(~held))
    ratio = log_ratio(found, raw) if found.sum() else np.zeros(BUCKETS)
    weights = tmp.write(with_weight(docs.select("doc_id", "text"), ratio).select("doc_id", "log_weight", "__ngrams"), "weights")
    judges = weights.join(F.broadcast(target.where(held)), "doc_id", "left_semi")
    rows = judges.select("__ngrams", "log_weight").collect()  # LABELLED at most, but for repeated ids
    stands = standing(spread([r["__ngrams"] for r in rows], [r.log_weight for r in rows]) if rows else (0.0, 0.0, 0.0))
    key = stands / temperature + gumbel()
    keyed = with_weight(docs, ratio).withColumn("sample_key", key).drop("__ngrams")
    if k is None:
        least = judges.agg(F.percentile(stands, F.lit(1 - keep))).first()[0]
        if least is not None:
            k = weights.where(stands >= least).count()
    out = keyed
    if k is not None:
        keys = weights.select(key.alias("sample_key"))
        if k < keys.count():
            out = keyed.where(F.col("sample_key") >= kth_largest(keys, "sample_key", k)) if k > 0 else keyed.limit(0)
    tmp.drop()
    return out


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "sample_key")
