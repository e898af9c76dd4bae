"""Day-block bootstrap intervals of average precision, over vectors of replicates.

A replicate draws as many days as there are, with replacement. How often it takes a day is a number a replicate, so a day
has one array of them, and a score's counts become arrays by its days. Scores are dealt to ordered chunks; a chunk's totals
are arrays, handed on from chunk to chunk, and one pass over a chunk's scores keeps running arrays of positives and rows.
What is shuffled grows with the scores, not with scores times replicates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.priors import with_chunks
from tidemark.storage import n_partitions, written

CHUNKS = 256  # at most; their totals, arrays of replicates, meet in the driver (2 MB at 500 replicates)
BLOCK = 2048  # rows whose arrays a task holds at once


def numbered_days(scores: DataFrame, day: str = "day") -> DataFrame:
    """(day, i): the calendar days in order, from 0; as many as the calendar has."""
    return scores.select(F.col(day).alias("day")).where("day is not null").distinct().withColumn("i", F.row_number().over(W.orderBy("day")) - 1)


def multiplicities(days: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, i, times) of numbered days: each replicate draws every day's place anew.

    The draw is the first 13 hexadecimal digits of the MD5 of seed, replicate and place, modulo the number of days: any
    engine can draw the same.
    """
    spark: SparkSession = days.sparkSession
    n = F.col("n_days")
    draws = spark.range(replicates).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(days.agg(F.count("*").alias("n_days")))).where(n > 0)  # one row
    draws = draws.select("replicate", "n_days", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("draw"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "replicate", "draw").cast("binary")), 1, 13), 16, 10).cast("long")
    return draws.select("replicate", (drawn % n).cast("int").alias("i")).groupBy("replicate", "i").agg(F.count("*").alias("times"))


def day_weights(times: DataFrame, replicates: int, n_days: int) -> np.ndarray:
    """An array of replicates a day. Days are bounded by the calendar."""
    t = times.toArrow()
    out = np.zeros((n_days, replicates), np.int64)
    out[t["i"].to_numpy(), t["replicate"].to_numpy()] = t["times"].to_numpy()
    return out


def _totals(d: DataFrame, sent) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positives and rows of each chunk, as arrays of replicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            w = sent.value
            chunk, i, pos, n = (b.column(c).to_numpy() for c in ("__chunk", "i", "pos", "n"))
            for c in np.unique(chunk).tolist():
                at = chunk == c
                now = [(w[i[at]] * x[at, None]).sum(axis=0) for x in (pos, n)]
                held[c] = [a + b for a, b in zip(held[c], now, strict=True)] if c in held else now
        yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), *(pa.array([h[j].tolist() for h in held.values()], pa.list_(pa.int64())) for j in (0, 1))], ["chunk", "pos", "n"])

    sums = d.groupBy("__chunk", "i").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))  # a row a chunk and day
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in sums.mapInArrow(run, "chunk int, pos array<long>, n array<long>").collect():
        pos, n = np.array(r.pos), np.array(r.n)
        out[r.chunk] = (out[r.chunk][0] + pos, out[r.chunk][1] + n) if r.chunk in out else (pos, n)
    return out


def _steps(d: DataFrame, sent, carried: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(replicate, step): each chunk's part of the sum of positives times precision over distinct scores."""
    before = d.sparkSession.sparkContext.broadcast(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, left, chunk, state, total = sent.value, None, None, None, None

        def take(rows: list[np.ndarray], whole: bool) -> list[np.ndarray] | None:
            """Adds the steps of full groups of one score; what may go on in the next rows is returned."""
            nonlocal state, total, chunk
            while len(rows[0]):
                if rows[0][0] != chunk:
                    chunk = rows[0][0]
                    state = [x.astype(np.float64) for x in before.value[int(chunk)]]
                of = np.searchsorted(rows[0], chunk, "right")  # rows of this chunk
                cut = of
                if of == len(rows[0]) and not whole:
                    cut = int(np.searchsorted(rows[1][:of], rows[1][of - 1]))
                for lo in _blocks(rows[1][:cut]):
                    down, i, pos, n = (x[lo] for x in rows[1:])
                    first = np.flatnonzero(np.append(True, down[1:] != down[:-1]))
                    p, m = (np.add.reduceat(w[i] * x[:, None], first, axis=0) for x in (pos, n))
                    tp, seen = state[0] + np.cumsum(p, axis=0), state[1] + np.cumsum(m, axis=0)
                    now = (p * tp / np.maximum(seen, 1)).sum(axis=0)
                    total = now if total is None else total + now
                    state = [tp[-1], seen[-1]]
                rows = [x[cut:] for x in rows]
                if cut < of:
                    return rows
            return None

        for b in batches:
            rows = [b.column(c).to_numpy() for c in ("__chunk", "__down", "i", "pos", "n")]
            left = take([np.concatenate(x) for x in zip(left, rows, strict=True)] if left else rows, False)
        if left:
            take(left, True)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["replicate", "step"])

    return d.repartition("__chunk").sortWithinPartitions("__chunk", "__down").select("__chunk", "__down", "i", "pos", "n").mapInArrow(run, "replicate long, step double")


def _blocks(down: np.ndarray) -> Iterator[slice]:
    """Slices of BLOCK rows, longer where one score goes on."""
    lo = 0
    while lo < len(down):
        hi = min(lo + BLOCK, len(down))
        hi = int(np.searchsorted(down, down[hi - 1], "right"))
        yield slice(lo, hi)
        lo = hi


def replicate_ap(scores: DataFrame, days: DataFrame, times: DataFrame, replicates: int, p: Sequence[str] = ("p",), y: str = "y", day: str = "day") -> DataFrame:
    """(replicate, ap_<p>...) of one or two score columns under the same draws; one-class replicates are left out, and
    rows without a score, label or day."""
    spark = scores.sparkSession
    sent = spark.sparkContext.broadcast(day_weights(times, replicates, days.count()))
    out = None
    for c in p:
        rows = scores.select(F.col(day).alias("day"), (-F.col(c).cast("double")).alias("__down"), F.col(y).cast("long").alias("y")).where("__down is not null and y is not null")
        counts = written(rows.join(F.broadcast(days), "day").groupBy("__down", "i").agg(F.sum("y").alias("pos"), F.count("*").alias("n")), "day-scores")  # a row a calendar day
        d = with_chunks(counts, ["__down"], min(CHUNKS, 2 * n_partitions(spark)))
        totals, carried = _totals(d, sent), {}
        so_far = (np.zeros(replicates, np.int64),) * 2
        for k in sorted(totals):
            carried[k] = so_far
            so_far = (so_far[0] + totals[k][0], so_far[1] + totals[k][1])
        valid = spark.createDataFrame([(r, int(so_far[0][r])) for r in np.flatnonzero((so_far[0] > 0) & (so_far[0] < so_far[1])).tolist()], "replicate long, positives long")  # a row a replicate
        ap = _steps(d, sent, carried).groupBy("replicate").agg(F.sum("step").alias("step")).join(valid, "replicate").select("replicate", (F.col("step") / F.col("positives")).alias(f"ap_{c}"))
        out = ap if out is None else out.join(ap, "replicate")
    return out


def day_block_ci(scores: DataFrame, replicates: int = 500, seed: int = 42, p: str = "p", y: str = "y", day: str = "day") -> DataFrame:
    """(low, high, valid): the 2.5 and 97.5 % quantiles over valid replicates; null for fewer than two days."""
    days = written(numbered_days(scores, day), "days")
    ap = replicate_ap(scores, days, multiplicities(days, replicates, seed), replicates, [p], y, day)
    q = ap.agg(F.percentile(f"ap_{p}", F.lit(0.025)).alias("low"), F.percentile(f"ap_{p}", F.lit(0.975)).alias("high"), F.count("*").alias("valid"))
    enough = days.agg((F.count("*") >= 2).alias("ok"))
    return q.crossJoin(F.broadcast(enough)).select(F.when(F.col("ok"), F.col("low")).alias("low"), F.when(F.col("ok"), F.col("high")).alias("high"), "valid")  # one row each


def paired_delta_ci(scores: DataFrame, champion: str, candidate: str, replicates: int = 500, seed: int = 42, y: str = "y", day: str = "day") -> DataFrame:
    """(low, high, valid, enough): the interval of AP(candidate) - AP(champion) on the same draws."""
    if replicates < 20:
        raise ValueError("at least 20 replicates")
    days = written(numbered_days(scores, day), "days")
    ap = replicate_ap(scores, days, multiplicities(days, replicates, seed), replicates, [champion, candidate], y, day).withColumn("d", F.col(f"ap_{candidate}") - F.col(f"ap_{champion}"))
    return ap.agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.count("*").alias("valid")).withColumn("enough", F.col("valid") >= max(20, replicates // 4))
