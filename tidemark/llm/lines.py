"""Removal of line runs that repeat across the corpus, by content-defined chunks of lines.

A rolling hash over the hashes of two lines runs down a text; where it is divisible, a chunk ends after the second line, so
that boundaries follow from the lines at hand and an inserted line moves none but those beside it. Chunks of several
lines that occurred before (least doc_id, then position) go once their bytes have been compared with the first
occurrence. A repeated run seldom begins or ends at a boundary; what is left of it shows in the windows of two
neighbouring lines that lie in no chunk that goes: those across boundaries and in chunks that stay. They are treated the same way.
Together, each repeated run of two lines or more goes to its full length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, table
from tidemark.llm.flat import SPACE, hash_runs, mix, powers, slices, view

DIVISOR = 4  # a boundary stands after one line in so many
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def text_lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each line; an end leaves out the line feed. What follows a text's last feed is a line only if
    it isn't empty."""
    feeds = np.flatnonzero(data == 10)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    # a line starts where a text starts and after each feed; it ends before a feed or where its text ends
    feed_row = np.searchsorted(offs, feeds, "right") - 1
    starts = np.concatenate([offs[full], feeds + 1])
    ends = np.concatenate([feeds, offs[full + 1]])
    row = np.concatenate([full, feed_row])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = ends[np.lexsort((ends, np.concatenate([feed_row, full])))]
    real = starts < offs[row + 1]
    return row[real], starts[real], ends[real]


def line_chunks_of(data: np.ndarray, offs: np.ndarray, divisor: int = DIVISOR) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(chunks, windows) of the texts in the buffer, in order.

    Chunks: row, start, size, lines, h1, h2. Windows of two neighbouring lines that aren't both blank: chunk (that of the
    first line), start, size, h1, h2, inner (both lines in that chunk). Sizes leave out the last line feed.
    """
    row, starts, ends = text_lines(data, offs)
    if not len(row):
        z, u = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return {"row": z, "start": z, "size": z, "lines": z, "h1": u, "h2": u}, {"chunk": z, "start": z, "size": z, "h1": u, "h2": u, "inner": z.astype(bool)}
    h = hash_runs(data, starts, ends)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=solid[1:])
    a, b, same = h[:-1], h[1:], row[:-1] == row[1:]
    rolling = mix(a * _ODD ^ b)
    # the boundary after a line depends on it and the line before it in its text
    ends_chunk = np.append(~same, True)
    ends_chunk[1:] |= same & (rolling % np.uint64(divisor) == 0)
    first = np.append(0, np.flatnonzero(ends_chunk)[:-1] + 1)
    last = np.flatnonzero(ends_chunk)
    n = last - first + 1
    place = powers(int(n.max()))[np.arange(len(h)) - np.repeat(first, n)]
    one, two = (np.add.reduceat(x * place, first) for x in (h, mix(h)))
    chunks = {"row": row[first], "start": starts[first], "size": ends[last] - starts[first], "lines": np.where(solid[ends[last]] > solid[starts[first]], n, 1), "h1": mix(one ^ n.astype(np.uint64)), "h2": mix(two)}
    keep = np.flatnonzero(same & (solid[ends[1:]] > solid[starts[:-1]]))
    of = np.repeat(np.arange(len(first)), n)
    windows = {"chunk": of[keep], "start": starts[keep], "size": ends[keep + 1] - starts[keep], "h1": rolling[keep], "h2": mix(b[keep] * _ODD ^ mix(a[keep])), "inner": of[keep] == of[keep + 1]}
    return chunks, windows


_WINDOW = "start:bigint,size:bigint,h1:bigint,h2:bigint,inner:boolean"
CHUNK = f"doc_id long, own long, start long, size long, lines int, h1 long, h2 long, windows array<struct<{_WINDOW}>>"


def _own() -> Column:
    """With doc_id, the name of a row: rows that share both are copies of one place."""
    return F.xxhash64(F.col("text").cast("string"))


def line_chunks(docs: DataFrame) -> DataFrame:
    """The chunks of every text: doc_id and a hash of the text, which name the row; byte start and size, lines (1 where all
    are blank), a 128-bit hash, and the windows that begin in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offs = view(part.column("text"))
                c, w = line_chunks_of(data, offs)
                ids, own = (part.column(x).to_numpy(zero_copy_only=False).astype(np.int64)[c["row"]] for x in ("doc_id", "own"))
                at = offs[c["row"]]
                inside = pa.StructArray.from_arrays([pa.array(x) for x in (w["start"] - at[w["chunk"]], w["size"], w["h1"].view(np.int64), w["h2"].view(np.int64), w["inner"])], ["start", "size", "h1", "h2", "inner"])
                ends = np.searchsorted(w["chunk"], np.arange(len(ids) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inside)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (ids, own, c["start"] - at, c["size"], c["lines"].astype(np.int32), c["h1"].view(np.int64), c["h2"].view(np.int64))), lists], ["doc_id", "own", "start", "size", "lines", "h1", "h2", "windows"])

    return docs.select(F.col("doc_id").cast("long"), _own().alias("own"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(run, CHUNK)


_KEY = ["h1", "h2", "size"]
_PLACE = ["doc_id", "own", "start"]


def _later() -> Column:
    """Whether a place isn't the first one and doesn't overlap it."""
    return (F.col("doc_id") != F.col("first.doc_id")) | (F.col("own") != F.col("first.own")) | (F.col("start") > F.col("first.start") + F.col("size"))


def _firsts(rows: DataFrame) -> DataFrame:
    """The first place of each key that occurs twice or more. It is grouped by a struct, so that its join deals both sides
    anew and Spark may split the rows of a key that is everywhere."""
    return rows.groupBy(F.struct(*_KEY).alias("key")).agg(F.count("*").alias("n"), F.min(F.struct(*_PLACE)).alias("first")).where("n > 1").select("key.*", "first")


def repeats(docs: DataFrame, coarse: bool = True) -> DataFrame:
    """(doc_id, own, cut): start and size of every chunk and window that equals an earlier one byte for byte and doesn't
    overlap it.

    Windows inside a chunk that goes aren't looked at: where the chunk has an earlier place, so have they. Should the
    bytes of a chunk differ from those of its hash, all windows are looked at (``coarse`` false).
    """
    tmp = Scratch(docs.sparkSession, "op3")
    chunks = tmp.write(line_chunks(docs), "chunks")
    several = chunks.where("lines > 1")
    marked = tmp.write(several.hint("merge").join(_firsts(several), _KEY, "left"), "marked") if coarse else several.withColumn("first", F.lit(None).cast("struct<doc_id:bigint,own:bigint,start:bigint>"))
    across = F.when(F.col("first").isNotNull() & _later(), F.filter("windows", lambda w: ~w.inner)).otherwise(F.col("windows"))
    left = marked.select("doc_id", "own", across.alias("windows")).unionByName(chunks.where("lines = 1").select("doc_id", "own", "windows"))
    windows = tmp.write(left.select("doc_id", "own", F.explode("windows").alias("w")).select("doc_id", "own", "w.start", *[f"w.{k}" for k in _KEY]), "windows")
    pairs = windows.hint("merge").join(_firsts(windows), _KEY).select(*_PLACE, *_KEY, "first", F.lit(False).alias("chunk"))
    wanted = tmp.write(marked.where("first is not null").select(*_PLACE, *_KEY, "first", F.lit(True).alias("chunk")).unionByName(pairs), "wanted")
    tmp.drop("chunks", "marked", "windows")
    lists = wanted.groupBy("doc_id", "own").agg(F.collect_set(F.struct("start", *_KEY, "first", "chunk")).alias("__want"))
    bodies = docs.select(F.col("doc_id").cast("long"), _own().alias("own"), F.encode("text", "UTF-8").alias("raw")).join(lists, ["doc_id", "own"])
    bodies = bodies.select("doc_id", "own", "raw", F.explode("__want").alias("w")).select("doc_id", "own", "w.*", F.substring("raw", F.col("w.start").cast("int") + 1, F.col("w.size").cast("int")).alias("body"))
    bodies = tmp.write(bodies, "bodies")
    tmp.drop("wanted")
    kept = bodies.where(F.struct(*_PLACE) == F.col("first")).groupBy(F.struct(*_KEY, "chunk").alias("key")).agg(F.min("body").alias("kept")).select("key.*", "kept")
    same = tmp.write(bodies.where(_later()).hint("merge").join(kept, [*_KEY, "chunk"]).select("doc_id", "own", "start", "size", "chunk", (F.col("body") == F.col("kept")).alias("same")), "same")
    tmp.drop("bodies")
    if coarse and not same.where("chunk and not same").isEmpty():
        tmp.drop()
        return repeats(docs, coarse=False)
    cut = tmp.write(same.where("same").groupBy("doc_id", "own").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("cut")), "cuts")
    tmp.drop("same")
    return cut


def _without(texts: pa.Array, cuts: pa.Array) -> tuple[list[str | None], list[int], list[int]]:
    """Each text without its cuts (start and size in bytes, ascending), with how many runs and lines go."""
    out, runs, lines = [], [], []
    for t, c in zip(texts.to_pylist(), cuts.to_pylist(), strict=True):
        gone: list[list[int]] = []
        k = 0
        if c and t is not None:
            raw = t.encode()
            for at_, size in ((x["start"], x["size"]) for x in c):
                end = min(len(raw), at_ + size + 1)
                if gone and at_ <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], end)
                else:
                    gone.append([at_, end])
            k = sum(raw.count(b"\n", lo, hi) + (raw[hi - 1 : hi] != b"\n") for lo, hi in gone)
            stay = zip([0, *(hi for _, hi in gone)], [*(lo for lo, _ in gone), len(raw)], strict=True)
            t = b"".join([raw[lo:hi] for lo, hi in stay]).decode()
        out.append(t)
        runs.append(len(gone))
        lines.append(k)
    return out, runs, lines


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``text`` without repeated runs of lines, and ``removed_chunks`` (runs) and ``removed_lines`` of each row.

    The line feed after a removed run goes with it. Null texts stay null, empty ones empty; a text without line feed
    has no run of two lines and stays. Rows with a null doc_id stay as they are and are no one's first occurrence.
    Rows that share doc_id and text are copies of one place: all keep what the first keeps; rows that share a doc_id alone
    are rows of their own. Other columns pass through.
    """
    cut = repeats(docs).withColumnRenamed("cut", "__cut")
    named = docs.drop("removed_chunks", "removed_lines", "__cut").withColumn("__own", _own())
    joined = named.join(cut.withColumnRenamed("own", "__own"), ["doc_id", "__own"], "left").drop("__own").select(*[c for c in docs.columns if c not in ("removed_chunks", "removed_lines", "__cut")], "__cut").withColumns({"removed_chunks": F.lit(0), "removed_lines": F.lit(0).cast("long")})
    schema = T.StructType([f for f in joined.schema if f.name != "__cut"])
    at, runs_at, lines_at = (joined.schema.names.index(c) for c in ("text", "removed_chunks", "removed_lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, runs, lines = _without(part.column("text"), part.column("__cut"))
                cols = {at: pa.array(texts, pa.string()), runs_at: pa.array(runs, pa.int32()), lines_at: pa.array(lines, pa.int64())}
                for i, c in cols.items():
                    part = part.set_column(i, part.schema.names[i], c)
                yield part.drop_columns("__cut")

    return joined.mapInArrow(run, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
