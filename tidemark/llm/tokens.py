"""Token ids in a compact binary format: frequency ranks in byte-aligned variable-length coding.

A block holds whole documents. Its sections are doc ids (int64), lengths (uint32), control bytes (four 2-bit byte
counts each) and data bytes (1 to 4 bytes a rank, little-endian). Decoding looks the control bytes up in a table of
256 x 4 lengths and gathers; no loop over values. Blocks are rows of Parquet, so any store that Spark writes to will
do, and a lost executor's output is written again by Spark's committer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.bpe import CACHE_ENTRIES, Chunks, tokenizer_path
from tidemark.llm.common import Scratch, n_partitions, table, text_or_empty
from tidemark.llm.flat import slices

BLOCK_IDS = 1 << 19
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    quads = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    quads[: len(v)] = code
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    raw = v.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) <= code[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values that ``pack`` wrote."""
    lens = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lens) - lens
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(n, np.uint32)
    for i in range(int(lens.max(initial=0))):
        has = np.flatnonzero(lens > i)
        out[has] |= raw[at[has] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


class ByteBpe:
    """The library's byte-level encoding, each distinct chunk encoded once.

    A blank after a character that is no white space always begins a pre-token, so a text's ids are those of its first
    chunk and of ' ' + chunk for the others. Texts where that does not hold (white space before a blank, a blank at
    the end, special tokens) go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.blank = np.array([(self.tok.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.chunks = Chunks()

    def unsafe(self, chunk: str) -> bool:
        return not chunk or chunk[-1].isspace() or any(s in chunk for s in self.special)

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The library's ids without the places in the text, which take it as long as the ids."""
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[str], _special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        joined = " " + " ".join(chunks)
        if any(s in joined for s in self.special):
            bad = np.array([self.unsafe(c) for c in chunks])
        else:
            bad = np.array([not c or c[-1].isspace() for c in chunks])
        if bad.any():
            joined = "".join(" " + c for c, b in zip(chunks, bad.tolist(), strict=True) if not b)
        ids = np.array(self.ids([joined])[0], np.int64)
        lens = np.zeros(len(chunks), np.int64)
        starts = np.flatnonzero(self.blank[ids]) if len(ids) else np.zeros(0, np.int64)
        assert len(starts) == (~bad).sum(), "a blank inside a chunk"
        lens[~bad] = np.diff(np.append(starts, len(ids)))
        return ids, lens

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        seen = self.chunks
        parts = [t.split(" ") for t in texts]
        rows = [list(map(seen.__getitem__, p[1:])) for p in parts]
        found = seen.gather(rows, self.learn)
        none = seen.n == 0
        odd = lambda p: (len(p) > 1 and self.unsafe(p[0])) or any(s in p[0] for s in self.special)
        heads = [i for i, p in enumerate(parts) if not odd(p) and not none[rows[i]].any()]
        whole = sorted({*range(len(texts))} - {*heads})
        for i, x in zip(heads, self.ids([parts[i][0] for i in heads]), strict=True):
            found[i] = np.concatenate([np.array(x, np.int32), found[i]])
        for i in whole:
            found[i] = np.array(self.ids([texts[i]])[0], np.int32)
        if len(seen) > CACHE_ENTRIES:
            self.chunks = Chunks()
        return found


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def token_ids(docs: DataFrame, path: str, end_id: int = 0, text: str = "text") -> DataFrame:
    """(doc_id, ids): each text's ids and ``end_id``, as little-endian unsigned integers of ``width(path)`` bytes."""
    kind = f"<u{width(path)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in slices(batch):
                ids = [np.append(x, end_id).astype(kind).tobytes() for x in bpe.encode([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def width(path: str) -> int:
    """Bytes that an id of the tokenizer takes while it isn't packed yet."""
    return 2 if loaded(path).tok.get_vocab_size() <= 1 << 16 else 4


def frequency_ranks(ids: DataFrame, size: int) -> np.ndarray:
    """All ids that occur, the most frequent first, ties to the smaller id: as many as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                got = np.bincount(np.frombuffer(raw.as_buffer(), f"<u{size}"))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))], np.int64)


BLOCKS = "part int, before long, n_ids long, doc_ids binary, lengths binary, control binary, data binary"


def encode_blocks(ids: DataFrame, ranked: np.ndarray, width: int, n: int) -> DataFrame:
    """The blocks of ``ids`` in ascending doc_id order (null first; ties by a hash of their ids): range-partitioned, then
    packed. The hash is part of the range, so that rows which share a doc_id or have none may go to several tasks."""
    spark = ids.sparkSession
    known = spark.sparkContext.broadcast(ranked)  # the vocabulary's size at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = known.value
        rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.int64)
        rank[order] = np.arange(len(order))
        held: list[tuple[int, int | None, bytes]] = []
        size, before = 0, 0

        def block() -> pa.RecordBatch:
            ids = rank[np.frombuffer(b"".join(x[2] for x in held), f"<u{width}")]
            control, data = pack(ids)
            doc_ids = pa.array([x[1] for x in held], pa.int64())
            # a null doc_id is written as the smallest long
            raw = doc_ids.fill_null(-(2**63)).to_numpy().astype("<i8").tobytes()
            lengths = np.array([len(x[2]) // width for x in held], "<u4").tobytes()
            return pa.RecordBatch.from_pylist([{"part": held[0][0], "before": before, "n_ids": size, "doc_ids": raw, "lengths": lengths, "control": control, "data": data}], schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                held.append(row)
                size += len(row[2]) // width
                if size >= BLOCK_IDS:
                    yield block()
                    held, before, size = [], before + size, 0
        if held:
            yield block()

    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), *((c, pa.binary()) for c in ("doc_ids", "lengths", "control", "data"))])
    return ids.withColumn("tie", F.xxhash64("ids")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(run, BLOCKS)


def decode_blocks(blocks: DataFrame, ranked: np.ndarray) -> DataFrame:
    """(part, doc_id, at, ids) of every document in the blocks; ``at`` counts the ids of its part before it."""
    known = blocks.sparkSession.sparkContext.broadcast(ranked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = known.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = order[unpack(row["control"], row["data"], row["n_ids"])].astype("<u4") if row["n_ids"] else np.zeros(0, "<u4")
                n = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                at = row["before"] + np.cumsum(n) - n
                ends = np.cumsum(n)
                docs = np.frombuffer(row["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), row["part"], np.int32)),
                        pa.array(docs, mask=docs == -(2**63)),
                        pa.array(at),
                        pa.array([ids[b - k : b].tobytes() for b, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary()),
                    ],
                    ["part", "doc_id", "at", "ids"],
                )

    return blocks.mapInArrow(run, "part int, doc_id long, at long, ids binary")


def digest(decoded: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of decoded documents, starts counted over all parts."""
    ends = blocks.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n"))  # one row a part
    starts = ends.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))

    return decoded.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def write_tokens(docs: DataFrame, path: str, end_id: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Encodes ``docs`` and writes their blocks to the shared folder: (blocks as read back, the ranked ids).

    Null text is empty and has the end id alone; a null doc_id comes first; rows with the same doc_id are ordered by
    a hash of their ids; other columns are not read. Text is read once, ids are shuffled once.
    """
    tmp = Scratch(docs.sparkSession, "op2")
    ids = tmp.write(token_ids(docs, path, end_id), "ids")
    size = width(path)
    ranked = frequency_ranks(ids, size)
    blocks = tmp.write(encode_blocks(ids, ranked, size, n_partitions(docs.sparkSession)), "blocks")
    tmp.drop("ids")
    return blocks, ranked


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, ranked = write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return digest(decode_blocks(blocks, ranked), blocks)
