"""Byte-pair encoding in batched numpy merge rounds, and decoding.

The symbols of many words lie in one flat array. A round looks up every neighbouring pair by binary search over the
sorted pair keys, takes each word's lowest rank, and merges that pair everywhere in the word at once. The tokenizer
file gives vocabulary and merges; its normalizer and splitter run in the library, the merging here.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table
from tidemark.llm.flat import slices

CACHE_ENTRIES = 800_000  # distinct chunks whose ids a task remembers (about 150 MB); only speed depends on it


_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split(), but not to the tokenizer


class Chunks(dict):
    """Distinct chunks by number, and the ids of each, gathered for many texts at once."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.special: dict[str, int] = {}
        self.start, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def __missing__(self, chunk: str) -> int:
        self.fresh.append(chunk)
        self[chunk] = n = len(self)
        return n

    def fixed(self, name: str, i: int) -> int:
        """The number of a special token, kept under a key that no chunk can equal, as it holds a blank."""
        self.special[key := f"{name} "] = i
        return self[key]

    def _append(self, ids: np.ndarray, n: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def gather(self, rows: list[list[int]], learn) -> list[np.ndarray]:
        """Learns the fresh chunks, then looks up all: the ids of each row."""
        if self.fresh:
            fresh, self.fresh = self.fresh, []
            self._append(*learn(fresh, self.special))
        lens = [len(r) for r in rows]
        codes = np.fromiter(chain.from_iterable(rows), np.int64, sum(lens))
        n = self.n[codes]
        total = np.cumsum(n)
        first = total - n
        flat = self.ids[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.start[codes] - first, n)]
        ends = np.concatenate([[0], total])[np.cumsum([0, *lens])]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class WordBpe:
    """Encodes and decodes as the tokenizers library does with a word-end BPE file without a decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model, tok = spec["model"], Tokenizer.from_file(path)
        self.normalize = tok.normalizer.normalize_str if tok.normalizer else str
        self.split = tok.pre_tokenizer.pre_tokenize_str
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        size = 1 + max([*self.vocab.values(), *special.values()])
        self.tokens = [""] * size
        for s, i in [*self.vocab.items(), *special.items()]:
            self.tokens[i] = s
        left, right, to = [], [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(self.vocab[a])
            right.append(self.vocab[b])
            to.append(self.vocab[a + b])
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.to = key[order], order.astype(np.int64), np.array(to, np.int64)
        self.chunks = Chunks()

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges to the end. sym: ids; word: each symbol's word, ascending. The same pair of arrays, shorter."""
        done_s, done_w = [], []
        none = len(self.key)
        while len(sym):
            pair = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.key, pair), none - 1)
            rank = np.where((self.key[at] == pair) & (word[:-1] == word[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            lens = np.diff(np.append(first, len(sym)))
            low = np.repeat(best, lens)
            live = low < none
            if not live.all():
                done_s.append(sym[~live])
                done_w.append(word[~live])
                sym, word, rank, low = sym[live], word[live], rank[live], low[live]
                if not len(sym):
                    break
            hit = rank == low
            start = hit.copy()
            start[1:] &= ~hit[:-1]
            idx = np.arange(len(hit))
            since = idx - np.maximum.accumulate(np.where(start, idx, 0))
            hit &= since % 2 == 0  # of overlapping equal pairs, every other one from the left
            gone = np.zeros(len(sym), bool)
            gone[1:] = hit[:-1]
            sym = np.where(hit, self.to[np.where(hit, rank, 0)], sym)[~gone]
            word = word[~gone]
        if not done_s:
            return sym, word
        sym, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def learn(self, chunks: list[str], special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``chunks`` one after another, and each chunk's number of ids."""
        sym: list[int] = []
        lens: list[int] = []
        of: list[int] = []
        vocab, end = self.vocab, self.end
        for i, c in enumerate(chunks):
            for piece, _ in () if c in special else self.split(self.normalize(c)):
                ids = [vocab[x] for x in piece[:-1]]
                ids.append(vocab[piece[-1] + end])
                sym += ids
                lens.append(len(ids))
                of.append(i)
            if c in special:
                sym.append(special[c])
                lens.append(1)
                of.append(i)
        if not sym:
            return np.zeros(0, np.int64), np.zeros(len(chunks), np.int64)
        s, w = self.merge(np.array(sym, np.int64), np.repeat(np.arange(len(lens)), lens))
        return s, np.bincount(np.array(of)[w], minlength=len(chunks))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. White space only ends chunks: normalizing and splitting never reach across it."""
        seen = self.chunks
        rows: list[list[int]] = []
        for t in texts:
            if self.cut and "<" in t and self.cut.search(t):
                row: list[int] = []
                for i, p in enumerate(self.cut.split(t)):
                    row += [seen.fixed(p, self.special[p])] if i % 2 else map(seen.__getitem__, self._chunks(p))
                rows.append(row)
            else:
                rows.append(list(map(seen.__getitem__, self._chunks(t))))
        out = seen.gather(rows, self.learn)
        if len(seen) > CACHE_ENTRIES:
            self.chunks = Chunks()
        return out

    @staticmethod
    def _chunks(t: str) -> list[str]:
        return re.split("[\\t-\\r ]+", t) if _ODD_SPACE.search(t) else t.split()

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings with a blank between: what the library gives where a file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One encoder a Python worker, kept between its tasks; the chunks that a task has learned go with the task."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, SHA-256 of the ids and of the text decoded from them; ``ids`` if asked.

    Null text counts as empty (no ids, the digest of nothing); rows with equal or null doc_id are separate rows; other
    columns are not read. No shuffle: tasks map batches; a slice of 2 MB of text and the chunks learned bound what a worker
    holds, and between tasks it holds the encoder alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        try:
            for batch in batches:
                for part in slices(batch):
                    found = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                    ids = [x.astype("<u4").tobytes() for x in found]
                    cols = [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4")).encode()).hexdigest() for x in ids]),
                    ]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        cols.append(pa.array(ids, pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            bpe.chunks = Chunks()  # workers outlive the query, and later steps need the memory

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
