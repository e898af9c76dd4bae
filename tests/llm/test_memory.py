"""What Python workers hold: bounded by slices of text while they work, and little between tasks."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, flat, lines


def test_workers_keep_no_chunks_after_encoding(spark):
    path = bpe.tokenizer_path("word_bpe_49k.json")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.md5(F.col("id").cast("string"))).alias("text"))
    assert bpe.encode_documents(docs, path).where("n_tokens > 0").count() == 400

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(x.chunks) for x in bpe._LOADED.values())], pa.int64())], ["n"])

    assert spark.range(400).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0


def test_lines_are_removed_slice_by_slice(spark, monkeypatch):
    made = {}
    docs = spark.createDataFrame([(1, "a\nb\nc\n"), (2, "x\na\nb\nc\ny\n")], "doc_id long, text string")
    plain = type(docs).mapInArrow

    def noted(self, func, schema, *args, **more):
        made["run"] = func
        return plain(self, func, schema, *args, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    out = lines.drop_repeats(docs)
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["a\nb\nc\n", "x\ny\n"]

    n, size = 60, 100_000
    body = "x" * (size - 5) + "\n"
    cut = pa.array([[{"start": 0, "size": 3}] if i % 2 else None for i in range(n)], pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["a\nb\n" + body] * n), cut, pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int64())], ["doc_id", "text", "__cut", "removed_chunks", "removed_lines"])
    parts = list(made["run"](iter([batch])))
    assert max(p.column("text").nbytes for p in parts) <= flat.SLICE_BYTES + 4 * n and len(parts) > 1
    rows = [r for p in parts for r in p.to_pylist()]
    assert rows == [{"doc_id": i, "text": body if i % 2 else "a\nb\n" + body, "removed_chunks": i % 2, "removed_lines": 2 * (i % 2)} for i in range(n)]


@pytest.mark.parametrize("seed", [0, 3])
def test_hashing_runs_costs_few_bytes_a_byte(seed):
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 1 << 21, dtype=np.uint8)
    starts = np.sort(rng.choice(len(data), 300_000, replace=False))
    ends = np.append(starts[1:], len(data)) - rng.integers(0, 2, len(starts))
    ends = np.maximum(ends, starts)
    tracemalloc.start()
    got = flat.hash_runs(data, starts, ends, seed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 28 * len(data)
    for i in [0, 1, 2, 777, len(starts) - 1, *np.flatnonzero(ends == starts)[:2].tolist()]:
        n = int(ends[i] - starts[i])
        total = np.sum(flat._BYTE[data[starts[i] : ends[i]]] * flat.powers(n)[:n], dtype=np.uint64)
        assert got[i] == flat.mix(np.array([total]) ^ flat.mix(np.array([n + seed], np.uint64)))[0]


def test_slices_skip_what_lies_under_nulls():
    texts = pa.array(["a" * 30, None, "b" * 30, "", "c" * 40, None])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    assert [p.column("text").to_pylist() for p in flat.slices(batch, limit=60)] == [["a" * 30, None, "b" * 30, ""], ["c" * 40, None]]
