"""Spelling variants: words one edit apart, found with a bit-sliced position index.

The index holds, for every (position, letter), the set of words with that letter there, as bits. A query word walks
through its letters once and keeps sets of words, 64 a machine word: those equal so far, and those with one replaced,
one additional or one missing letter so far, the latter two compared at shifted positions.

Words that are one edit apart have equal text before or after the middle, so the vocabulary is cut into cells that share
a length class and one half, and an index holds the words of some cells. A cell of more than CELL words is cut again by
the halves of what may differ; at the last level its words differ in one place, which bounds it by the alphabet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, n_partitions, table

CELL = 1024  # words of a cell, and of an index
LEAST = 7  # code points of a word
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class PositionIndex:
    """Bitsets of the words with a letter at a position. Words are Latin-1 bytes."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.lens = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        word = np.repeat(np.arange(self.n), self.lens)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        self.keys, at = np.unique(place << 8 | flat, return_inverse=True)
        self.width = -(-self.n // 64)
        self.bits = self._pack(at, word, len(self.keys) + 1)  # the last row is empty
        self.sizes, at = np.unique(self.lens, return_inverse=True)
        self.of_len = self._pack(at, np.arange(self.n), len(self.sizes) + 1)

    def _pack(self, rows: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, self.width), np.uint64)
        np.bitwise_or.at(out, (rows, words >> 6), np.uint64(1) << (words & 63).astype(np.uint64))
        return out

    def _having(self, keys: np.ndarray, wanted: np.ndarray, bits: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return bits[np.where(keys[at] == wanted, at, len(bits) - 1)]

    def near(self, queries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all that are exactly one inserted, deleted or replaced letter apart."""
        found = [(np.zeros(0, np.int64),) * 2]
        lens = np.array([len(q) for q in queries], np.int64)
        for m in np.unique(lens).tolist():
            rows = np.flatnonzero(lens == m)
            q = np.frombuffer(b"".join([queries[i] for i in rows]), np.uint8).reshape(len(rows), m).astype(np.int64)
            has = lambda place, letter: self._having(self.keys, place << 8 | letter, self.bits)  # noqa: B023, E731
            shape = (len(rows), self.width)
            equal = np.full(shape, ~np.uint64(0))
            replaced, more, less = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
            for i in range(m):
                here, after = has(i, q[:, i]), has(i + 1, q[:, i])
                before = has(i - 1, q[:, i]) if i else np.zeros(shape, np.uint64)
                replaced = replaced & here | equal & ~here
                more = (more | equal) & after  # the word has a letter that the query lacks; it stands one further on
                less = less & before | equal  # the word lacks this letter; what follows stands one earlier
                equal = equal & here
            sized = lambda k: self._having(self.sizes, np.array([k]), self.of_len)
            hit = replaced & sized(m) | (more | equal) & sized(m + 1) | less & sized(m - 1)
            a, b = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little"))
            found.append((rows[a], b))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def occurrences(docs: DataFrame, typo_every: int = 31, text: str = "text") -> DataFrame:
    """(word, n): the words of LEAST or more letters that occur twice or more. Runs of letters, A-Z lower-cased; a run
    whose checksum with its doc_id (null: the word null) ``typo_every`` divides loses a letter. Null text has no runs."""
    low = F.translate(F.col(text).cast("string"), _UPPER, _UPPER.lower())
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{LEAST},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    lost = (h % F.char_length("run")).cast("int")
    word = F.when(h % typo_every == 0, F.concat(F.substring("run", F.lit(1), lost), F.substring("run", lost + 2, F.char_length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


def _celled(rows: DataFrame) -> DataFrame:
    """``rows`` (size, lo, hi, word) with what a cell's words share: the text before lo and after hi, counted in the
    longer word, of ``size`` letters."""
    return rows.withColumns({"head": F.substring("word", F.lit(1), F.col("lo")), "tail": F.right("word", F.col("size") - F.col("hi"))})


def _halves(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    mid = F.floor((lo + hi) / 2).cast("int")
    return rows.withColumn("half", F.explode(F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi"))))).withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi")}).drop("half")


_CELL = ["size", "lo", "hi", "head", "tail"]


def _search(cells: DataFrame, limit: int) -> DataFrame:
    """(word, near, near_n) inside the cells, each of ``limit`` words at most: an index holds whole cells of one size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_no, last, held, at = -1, None, [], []

        def found() -> pa.RecordBatch:
            cell = np.array(at)
            # a cell of one word has no pairs
            keep = np.flatnonzero(np.bincount(cell - cell[0])[cell - cell[0]] > 1)
            words = [held[i][0].encode("latin-1") for i in keep]
            q, v = PositionIndex(words).near(words) if len(keep) else (np.zeros(0, np.int64),) * 2
            lens = np.array([len(w) for w in words], np.int64)
            # pairs of two shorter words belong to the size below
            own = (cell[keep[q]] == cell[keep[v]]) & (np.maximum(lens[q], lens[v]) == last[0]) if len(keep) else np.zeros(0, bool)
            q, v = keep[q[own]].tolist() if len(keep) else [], keep[v[own]].tolist() if len(keep) else []
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in q], pa.string()), pa.array([held[i][0] for i in v], pa.string()), pa.array([held[i][1] for i in v], pa.int64())], ["word", "near", "near_n"])

        for batch in batches:
            for *cell, word, n in zip(*(batch.column(c).to_pylist() for c in [*_CELL, "word", "n"]), strict=True):
                if cell != last:
                    if held and (cell[0] != last[0] or len(held) >= limit):
                        yield found()
                        held, at = [], []
                    cell_no, last = cell_no + 1, cell
                held.append((word, n))
                at.append(cell_no)
        if held:
            yield found()

    n = n_partitions(cells.sparkSession)
    return cells.repartition(n, *_CELL).sortWithinPartitions(*_CELL).select(*_CELL, "word", "n").mapInArrow(run, "word string, near string, near_n long")


def near_words(words: DataFrame, tmp: Scratch, limit: int = CELL) -> DataFrame:
    """(word, near, near_n) of all pairs of ``words`` (word, n; distinct) that are one edit apart, each once a direction."""
    m = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(m, m + 1)).alias("size"))
    rows = _celled(_halves(rows, F.lit(0), F.col("size")))
    out = None
    for level in range(64):
        # a cell with one place left isn't cut: it holds one word a letter and the word without it
        heavy = tmp.write(rows.where("hi - lo > 1").groupBy(*_CELL).agg(F.count("*").alias("in_cell")).where(F.col("in_cell") > limit).drop("in_cell"), f"heavy-{level}")
        last = heavy.isEmpty()
        pairs = _search(rows if last else rows.join(heavy, _CELL, "left_anti"), limit)
        out = pairs if out is None else out.unionByName(pairs)
        if last:
            break
        rows = tmp.write(_celled(_halves(rows.join(heavy, _CELL, "left_semi").drop("head", "tail"), F.col("lo"), F.col("hi"))), f"finer-{level}")
    return out.dropDuplicates(["word", "near"])


def variants(words: DataFrame, ratio: int = 10, limit: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n; distinct, n at least 1).

    A form is the near word of largest n (ties: the smallest in code-point order), if n is ``ratio`` times the word's;
    a root ends the chain of forms. Counts grow by ``ratio`` a step, so a chain's length is bounded by their logarithm.
    An empty table gives no rows; other columns are not read.
    """
    tmp = Scratch(words.sparkSession, "op13")
    words = tmp.write(words.select("word", "n"), "words")
    near = near_words(words, tmp, limit).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    d = words.join(near, "word", "left").withColumns({"n_near": F.coalesce("n_near", F.lit(0)).cast("long"), "form_n": -F.col("best.less")})
    d = d.select("word", "n", "n_near", *[F.when(F.col("form_n") >= ratio * F.col("n"), c).alias(a) for c, a in ((F.col("best.form"), "form"), (F.col("form_n"), "form_n"))])
    d = tmp.write(d, "forms")
    step = d.where("form is not null").select(F.col("word").alias("at"), F.col("form").alias("next"))
    most = d.agg(F.max("n")).first()[0] or 1
    out = d.withColumn("root", F.coalesce("form", "word"))
    for _ in range(math.ceil(math.log(max(most, 2), ratio))):
        out = out.join(step, F.col("root") == F.col("at"), "left").withColumn("root", F.coalesce("next", "root")).drop("at", "next")
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(occurrences(table(spark, sf_dir, "documents")))
