"""Approximate nearest neighbours by a permutation index.

A vector is known by its nearest pivots in order. The index is a table of parts of a bounded number of vectors: each holds
its vectors and one inverted list a pivot, of (vector, rank) postings. Queries go to the parts in blocks; in a part a query
adds up the footrule distance over the lists of its own pivots, and the nearest share of the part by that distance is ranked
again by the cosine on the original vectors in double precision. A task holds one part and one block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import Scratch, n_partitions, table

PIVOTS = 128  # the sample that the index is fitted on: so many vectors, by a hash of their id
LENGTH = 64  # pivots that a vector is posted under
SHARE, FLOOR = 0.25, 20  # of a part, and neighbours asked for times so many at least, that are ranked again
PART_ROWS, QUERY_ROWS = 16_384, 1024  # vectors in a part, queries in a block, at most


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors that take part, as doubles. Null, zero and non-finite ones don't; of vectors of unlike
    lengths those of the most frequent length (ties: the longer) do."""
    v = F.col(vector).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).where(fine).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (size.d if size else 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def permutations(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each row in order; equal vectors have equal permutations."""
    near = np.stack([(x * p).sum(axis=1) for p in pivots], axis=1)
    return np.argsort(-near, axis=1, kind="stable")[:, :length].astype(np.int16)


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


PART = "part long, n int, ids binary, vectors binary, perms binary, starts binary, rows binary, ranks binary"


def postings(perm: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, rows, ranks): pivot p's list is rows[starts[p]:starts[p + 1]], with the ranks that it has there."""
    flat = perm.ravel()
    by = np.argsort(flat, kind="stable")
    return np.searchsorted(flat[by], np.arange(n_pivots + 1)).astype(np.int32), (by // perm.shape[1]).astype(np.int32), (by % perm.shape[1]).astype(np.int16)


def blocks(rows: DataFrame, pivots: np.ndarray, length: int, size: int, lists: bool) -> DataFrame:
    """``rows`` (vec_id, v) in blocks of ``size`` at most, numbered apart; with inverted lists where they are the index."""
    known = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            nonlocal at
            ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
            x = np.concatenate([matrix(b.column("v")) for b in held])
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            perm = permutations(unit(x), known.value, length)
            inverted = postings(perm, len(known.value)) if lists else [np.zeros(0, np.int32)] * 3
            at += 1
            return pa.RecordBatch.from_pylist([dict(zip(names, (at, len(ids), *(np.ascontiguousarray(c).tobytes() for c in (ids, x, perm, *inverted))), strict=True))], pa.schema(list(zip(names, kinds, strict=True))))

        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == size:
                    yield block()
                    held.clear()
        if held:
            yield block()

    names = [c.split()[0] for c in PART.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
    return rows.mapInArrow(run, PART)


class _Part:
    """A part of the index, or a block of queries, as arrays."""

    def __init__(self, row: dict):
        n = row["n"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
        self.perm = np.frombuffer(row["perms"], np.int16).reshape(n, -1)
        self.starts, self.rows, self.ranks = (np.frombuffer(row[c], t) for c, t in (("starts", np.int32), ("rows", np.int32), ("ranks", np.int16)))
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))

    def search(self, q: _Part, k: int, share: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query_id, vec_id, score): the k best in this part of each query."""
        n, length = self.perm.shape
        m = min(n, max(FLOOR * k, int(np.ceil(share * n))))
        out = []
        for i in range(len(q.ids)):
            # footrule with absent pivots at rank `length`; it starts from nothing shared, up to a term all rows have
            dist = np.full(n, length * (length + 1) // 2, np.int64)
            for rank, p in enumerate(q.perm[i].tolist()):
                at = slice(self.starts[p], self.starts[p + 1])
                s = self.ranks[at].astype(np.int64)
                dist[self.rows[at]] += np.abs(s - rank) - (length - rank) - (length - s)
            if m < n:
                edge = np.partition(dist, m - 1)[m - 1]
                near = np.flatnonzero(dist < edge)
                near = np.concatenate([near, np.flatnonzero(dist == edge)[: m - len(near)]])  # ties to smaller ids
            else:
                near = np.arange(n)
            near = near[self.ids[near] != q.ids[i]]
            if len(near):
                score = (self.x[near] * q.x[i]).sum(axis=1) / (self.norm[near] * q.norm[i])
                best = np.lexsort((self.ids[near], -score))[:k]
                out.append((np.full(len(best), q.ids[i]), self.ids[near[best]], score[best]))
        return out


def nearest(vectors: DataFrame, queries: str, k: int = 5, pivots: int = PIVOTS, length: int = LENGTH, share: float = SHARE, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each usable row that the condition ``queries`` names.

    All rows are indexed; each query asks every part, as a query of the contract asks every row. The index is written and
    moves once, the queries once a part. Rows with equal ids are one candidate each but never their own neighbour; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    tmp = Scratch(spark, "op5")
    rows = usable(vectors, id_column, vector)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    fitted = np.unique(unit(np.array([r.v for r in sample])), axis=0)
    length = min(length, len(fitted))
    index = tmp.write(blocks(rows, fitted, length, PART_ROWS, True), "index")
    asked = tmp.write(blocks(rows.where(F.expr(queries)), fitted, length, QUERY_ROWS, False), "queries")
    # parts are numbered without gaps, so that a block of queries knows all of them: a row a task
    tasks = index.groupBy(F.shiftright("part", 32).alias("task")).count()
    tasks = tasks.select("task", (F.sum("count").over(W.orderBy("task")) - F.col("count") - 1).alias("before"))
    total = index.count()
    index = index.join(F.broadcast(tasks), F.shiftright("part", 32) == F.col("task")).withColumn("part", F.col("before") + F.col("part").bitwiseAND(F.lit((1 << 32) - 1))).drop("task", "before")
    every = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"))))
    both = index.withColumn("kind", F.lit(0)).unionByName(every.withColumn("kind", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["kind"] == 0:
                    here, at = _Part(row), row["part"]
                    continue
                assert at == row["part"], "queries without their part"
                found = here.search(_Part(row), k, share)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    dealt = both.repartition(n_partitions(spark), "part").sortWithinPartitions("part", "kind")
    out = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
