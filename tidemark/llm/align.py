"""Alignment of two tokenizers' ids over the same bytes, and how often ids meet across the corpus.

Both tokenizers encode whole texts. Where an entry of each ends at the same byte and the next entry of each begins with
a space, an anchor cuts the text into windows of ids. A window's alignment (groups between shared ends, linked ids)
follows from its ids alone, so it is worked out once a worker for each pair of id tuples and looked up afterwards.

A cached encoding is that of the whole text: a space after a character that is no white space begins a pre-token of
the byte-level tokenizer, and no entry of the other one goes on after a word with a space, so neither merges across it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import tokenizer_path
from tidemark.llm.common import Scratch, table
from tidemark.llm.flat import mix, slices

CACHE_ENTRIES = 400_000  # distinct chunks, and windows, that a worker remembers; only speed depends on it
FREQUENT = 1 << 20  # id pairs whose counts are sent to all tasks (16 MB); counts of the others are joined
_CUT = re.compile(r"(?<=\S) ")
_SPACE_MARK = "▁"


def _expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of all runs start..start+len, one run after another."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1 characters for themselves,
    other bytes, in order, for the characters from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Store:
    """Runs of numbers one after another, by run number."""

    def __init__(self, *kinds: type):
        self.flat = [np.zeros(0, k) for k in kinds]
        self.start, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def append(self, n: np.ndarray, *flat: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat[0]) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.flat = [np.concatenate([a, b.astype(a.dtype)]) for a, b in zip(self.flat, flat, strict=True)]

    def gather(self, runs: np.ndarray) -> list[np.ndarray]:
        at = _expand(self.start[runs], self.n[runs])
        return [f[at] for f in self.flat]


class _Chunks(dict):
    """Chunks of text by number, with the ids of both tokenizers."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.a, self.b = _Store(np.int32), _Store(np.int32)
        self.good = np.zeros(0, bool)

    def __missing__(self, chunk: str) -> int:
        self.fresh.append(chunk)
        self[chunk] = n = len(self)
        return n


class _Windows(dict):
    """Windows by their ids: number, printed groups, counts, and linked pairs with how often each is linked."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.groups, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs = _Store(np.int64, np.int64)


class Aligner:
    """Encodes texts with a byte-level BPE file (A) and a piece model (B) and aligns their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(byte_path)
        self.tok.encode_special_tokens = True
        self.sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet = byte_level_alphabet()
        size = self.tok.get_vocab_size()
        added = self.tok.get_added_tokens_decoder()
        entries = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [e.encode() if i in added else bytes(alphabet[c] for c in e) for i, e in enumerate(entries)]
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        if any(re.search(f"[^{_SPACE_MARK}]{_SPACE_MARK}", p) for p in pieces):
            raise ValueError("an entry goes on after a word with a space")
        self.blank = self.sp.piece_to_id(_SPACE_MARK)
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.space_a, self.space_b = (np.array([x[:1] == b" " for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.chunks, self.windows = _Chunks(), _Windows()

    def _ids(self, text: str) -> tuple[list[int], list[int]]:
        """Both encodings of a text that begins with a space, which the piece model adds itself."""
        return self.tok.encode(text, add_special_tokens=False).ids, self.sp.encode(text[1:]) if len(text) > 1 else [self.blank]

    def _learn(self) -> None:
        fresh, self.chunks.fresh = self.chunks.fresh, []
        if not fresh:
            return
        whole = [c for c in fresh if not c[-1].isspace()]
        raw = [c.encode() for c in whole]
        joined = b"".join(raw)
        ends = np.cumsum([len(r) for r in raw])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if whole:
            for ids, pieces, lens in zip(self._ids("".join(whole)), (self.bytes_a, self.bytes_b), (self.len_a, self.len_b), strict=True):
                ids = np.array(ids, np.int64)
                upto = np.cumsum(lens[ids])
                at = np.minimum(np.searchsorted(upto, ends), len(ids) - 1)
                if b"".join([pieces[i] for i in ids.tolist()]) != joined or (upto[at] != ends).any():
                    break
                found.append((ids, np.diff(at + 1, prepend=0)))
        if len(found) < 2:  # some chunk doesn't read back; each by itself tells which
            whole, found = [], [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        alone = [c for c in fresh if c[-1].isspace()] if whole else fresh
        each = [self._ids(c) for c in alone]
        good = np.ones(len(fresh), bool)
        order = {c: i for i, c in enumerate([*whole, *alone])}
        for i, (c, (a, b)) in enumerate(zip(alone, each, strict=True)):
            good[len(whole) + i] = all(b"".join([p[x] for x in ids]) == c.encode() for p, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        tmp = [_Store(np.int32), _Store(np.int32)]
        for k, store in enumerate(tmp):
            store.append(np.concatenate([found[k][1], np.array([len(e[k]) for e in each], np.int64)]), np.concatenate([found[k][0], np.array([x for e in each for x in e[k]], np.int64)]))
        back = np.array([order[c] for c in fresh])
        for store, part in zip((self.chunks.a, self.chunks.b), tmp, strict=True):
            store.append(part.n[back], *part.gather(back))
        self.chunks.good = np.concatenate([self.chunks.good, good[back]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(ids of A, ids of B, numbers a text of each, whether a text reads back): texts that don't have no ids."""
        rows = [[self.chunks[" " + c] for c in _CUT.split(t)] if t else [] for t in texts]
        self._learn()
        lens = np.array([len(r) for r in rows], np.int64)
        codes = np.fromiter((c for r in rows for c in r), np.int64, int(lens.sum()))
        row = np.repeat(np.arange(len(rows)), lens)
        good = np.bincount(row, ~self.chunks.good[codes], len(rows)) == 0
        codes, row = codes[good[row]], row[good[row]]
        (a,), (b,) = self.chunks.a.gather(codes), self.chunks.b.gather(codes)
        n_a, n_b = (np.bincount(row, s.n[codes], len(rows)).astype(np.int64) for s in (self.chunks.a, self.chunks.b))
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks = _Chunks()
        return a, b, n_a, n_b, good & (lens > 0)

    def _cut(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, ...]:
        """The windows: where each starts among the ids of A and of B, and how many a text has."""
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        spaced = np.zeros(int(end_a[-1]) + 1, bool)
        spaced[end_b[:-1]] = self.space_b[b[1:]]
        anchor = spaced[end_a]
        anchor[:-1] &= self.space_a[a[1:]]
        text_end = np.cumsum(n_a)[n_a > 0]
        anchor[text_end - 1] = True
        stop_a = np.flatnonzero(anchor) + 1
        stop_b = np.searchsorted(end_b, end_a[anchor]) + 1
        start_a, start_b = np.append(0, stop_a[:-1]), np.append(0, stop_b[:-1])
        of = np.searchsorted(np.cumsum(n_a), start_a, "right")
        return start_a, stop_a - start_a, start_b, stop_b - start_b, np.bincount(of, minlength=len(n_a))

    def _align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        """Groups and links of new windows, given one after another."""
        n = len(n_a)
        in_a, in_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        mark = np.zeros(int(end_a[-1]) + 1, bool)
        mark[end_b] = True
        shared = mark[end_a]
        ends = end_a[shared]
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        of = in_a[shared]  # a group's window
        self.windows.groups = np.concatenate([self.windows.groups, np.bincount(of, minlength=n)])
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        self.windows.links = np.concatenate([self.windows.links, np.bincount(of, size_a * size_b, n).astype(np.int64)])
        # each group's distinct ids with their counts; the product of both sides
        (ga, ia, ca), (gb, ib, cb) = (self._distinct(g, x) for g, x in ((group_a, a), (group_b, b)))
        first_b, kinds_b = np.searchsorted(gb, np.arange(len(ends))), np.bincount(gb, minlength=len(ends))
        left = np.repeat(np.arange(len(ga)), kinds_b[ga])
        right = _expand(first_b[ga], kinds_b[ga])
        pair, times = ia[left].astype(np.int64) * len(self.bytes_b) + ib[right], ca[left] * cb[right]
        window = of[ga[left]]
        order = np.lexsort((pair, window))
        pair, times, window = pair[order], times[order], window[order]
        new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (window[1:] != window[:-1])))
        self.windows.pairs.append(np.bincount(window[new], minlength=n), pair[new], np.add.reduceat(times, new))
        # "a1,a2|b1;a3|b2": ids in order, A's before B's in each group, then one line a window
        tokens = np.concatenate([a, b])
        group = np.concatenate([group_a, group_b])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((np.arange(len(tokens)), side, group))
        group, side = group[order], side[order]
        after = np.where(np.append(group[1:] != group[:-1], True), 2, np.where(np.append(side[1:] != side[:-1], True), 1, 0))
        after[(after == 2) & np.append(of[group[1:]] != of[group[:-1]], True)] = 3
        signs = (",", "|", ";", "\n")
        self.windows.text += "".join([f"{t}{signs[s]}" for t, s in zip(tokens[order].tolist(), after.tolist(), strict=True)]).split("\n")[:-1]

    @staticmethod
    def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        key, n = np.unique(group.astype(np.int64) << 32 | ids.astype(np.int64), return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, n

    def _numbers(self, a: np.ndarray, b: np.ndarray, cut: tuple[np.ndarray, ...]) -> np.ndarray:
        """The number of each window; windows of a slice are told apart by a hash first, then looked up by their ids."""
        start_a, len_a, start_b, len_b, _ = cut
        h = np.zeros(len(start_a), np.uint64)
        for ids, start, lens in ((a, start_a, len_a), (b, start_b, len_b)):
            place = np.arange(len(ids)) - np.repeat(start, lens)
            h = mix(h) + np.add.reduceat(mix(ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), start) + lens.astype(np.uint64)
        _, first, same = np.unique(h, return_index=True, return_inverse=True)
        for ids, start, lens in ((a, start_a, len_a), (b, start_b, len_b)):
            if (lens != lens[first][same]).any() or (ids != ids[_expand(start[first][same], lens)]).any():
                first, same = np.arange(len(h)), np.arange(len(h))  # two windows with one hash: each for itself
                break
        known = self.windows
        raw_a, raw_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        number, fresh = np.zeros(len(first), np.int64), []
        for i, (sa, na, sb, nb) in enumerate(zip(start_a[first].tolist(), len_a[first].tolist(), start_b[first].tolist(), len_b[first].tolist(), strict=True)):
            key = (raw_a[4 * sa : 4 * (sa + na)], raw_b[4 * sb : 4 * (sb + nb)])
            at = known.get(key)
            if at is None:
                known[key] = at = len(known)
                fresh.append(first[i])
            number[i] = at
        if fresh:
            f = np.array(fresh)
            self._align(a[_expand(start_a[f], len_a[f])], len_a[f], b[_expand(start_b[f], len_b[f])], len_b[f])
        return number[same]

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """Per text: n_a, n_b, n_groups, n_links, groups (printed), and its linked pairs, each once, with their counts."""
        a, b, n_a, n_b, _ = self.encode(texts)
        n = len(texts)
        if not len(a):
            zero = np.zeros(n, np.int64)
            return {"n_a": zero, "n_b": zero, "n_groups": zero, "n_links": zero, "groups": [""] * n, "n_pairs": zero, "pairs": zero[:0], "times": zero[:0]}
        cut = self._cut(a, b, n_a, n_b)
        numbers, known, per = self._numbers(a, b, cut), self.windows, cut[4]
        row = np.repeat(np.arange(n), per)
        stops = np.cumsum(per).tolist()
        names, told = numbers.tolist(), known.text
        groups = [";".join([told[w] for w in names[e - k : e]]) for e, k in zip(stops, per.tolist(), strict=True)]
        # a text's windows, each once with how often it stands there; then their pairs
        key, often = np.unique(row << 32 | numbers, return_counts=True)
        window = key & 0xFFFFFFFF
        pair, times = known.pairs.gather(window)
        width = known.pairs.n[window]
        of, times = np.repeat(key >> 32, width), times * np.repeat(often, width)
        order = np.lexsort((pair, of))
        pair, times, of = pair[order], times[order], of[order]
        new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])))
        out = {
            "n_a": n_a, "n_b": n_b, "groups": groups, "n_pairs": np.bincount(of[new], minlength=n), "pairs": pair[new], "times": np.add.reduceat(times, new),
            "n_groups": np.bincount(row, known.groups[numbers], n).astype(np.int64), "n_links": np.bincount(row, known.links[numbers], n).astype(np.int64),
        }
        if len(known) > CACHE_ENTRIES:
            self.windows = _Windows()
        return out


_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(byte_path: str, piece_path: str) -> Aligner:
    """One aligner a Python worker, kept between its tasks."""
    key = (byte_path, piece_path)
    if key not in _LOADED:
        _LOADED[key] = Aligner(*key)
    return _LOADED[key]


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _lists(values: np.ndarray, lens: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)), pa.int32()), pa.array(values, pa.int64()))


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", with_groups: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of ``docs``; ``groups`` if asked.

    A pair is id of A x entries of B + id of B; ``times`` says how often the text links it. Null and empty texts, and
    those that don't read back from their entries, have zeros, no pairs and an empty digest. Rows that share a doc_id are
    rows of their own; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(byte_path, piece_path)
        for batch in batches:
            for part in slices(batch):
                d = both.align([t or "" for t in part.column("text").to_pylist()])
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in d["groups"]]
                cols = [part.column("row"), part.column("doc_id"), *(pa.array(d[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(digests, pa.string()), _lists(d["pairs"], d["n_pairs"]), _lists(d["times"], d["n_pairs"])]
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                if with_groups:
                    cols.append(pa.array(d["groups"], pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, ALIGNED + ", groups string" * with_groups)


def pair_counts(aligned: DataFrame, entries_b: int) -> DataFrame:
    """(pair, n, best): how many rows link each pair, and whether that is its A id's highest."""
    n = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.floor(F.col("pair") / entries_b))
    top = n.groupBy("a").agg(F.max("n").alias("top"))  # a row an entry of A
    return n.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _looked_up(aligned: DataFrame, known: DataFrame) -> DataFrame:
    """``aligned`` with n_best and count_sum over the pairs in ``known``, and the other pairs as ``pairs`` and ``times``."""
    held = known.toArrow().sort_by("pair")
    sent = known.sparkSession.sparkContext.broadcast((held["pair"].to_numpy(), held["n"].to_numpy(), held["best"].to_numpy()))
    schema = ALIGNED + ", n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            offs = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))
            wanted = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, wanted), max(len(pair) - 1, 0))
            hit = pair[at] == wanted if len(pair) else np.zeros(len(wanted), bool)
            found = np.where(hit, n[at], 0) * times if len(pair) else np.zeros(len(wanted), np.int64)
            tops = np.where(hit & best[at], times, 0) if len(pair) else found
            sums = [np.append(0, np.cumsum(x)) for x in (tops, found, ~hit)]
            s_best, s_count, left = (s[offs[1:]] - s[offs[:-1]] for s in sums)
            cols = [batch.column(c) for c in batch.schema.names[:7]]
            yield pa.RecordBatch.from_arrays([*cols, _lists(wanted[~hit], left), _lists(times[~hit], left), pa.array(s_best, pa.int64()), pa.array(s_count, pa.int64())], [*batch.schema.names[:7], "pairs", "times", "n_best", "count_sum"])

    return aligned.mapInArrow(run, schema)


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def with_pair_counts(aligned: DataFrame, entries_b: int, tmp: Scratch, frequent: int = FREQUENT) -> DataFrame:
    """The result rows of written ``aligned`` rows. About ``frequent`` pairs of largest count, and a hundredth of a percent
    of all, are looked up in every task; the others stand in few rows each, and are joined."""
    counts = tmp.write(pair_counts(aligned, entries_b), "counts")
    total = counts.count()
    if total <= frequent:
        return _looked_up(aligned, counts).select(*_RESULT)
    limit = counts.agg(F.percentile_approx("n", F.lit(1 - frequent / total), F.lit(10_000))).first()[0]
    d = tmp.write(_looked_up(aligned, counts.where(F.col("n") > limit)), "looked-up")
    rest = d.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    times = F.col("times")
    rare = rest.join(counts.where(F.col("n") <= limit), F.col("pairs") == F.col("pair")).groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("b"), F.sum(times * F.col("n")).alias("c"))
    zero = F.lit(0)
    return d.join(rare, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", zero), "count_sum": F.col("count_sum") + F.coalesce("c", zero)}).select(*_RESULT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_path, piece_path = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    tmp = Scratch(spark, "op11")
    aligned = tmp.write(align_documents(table(spark, sf_dir, "documents"), byte_path, piece_path), "aligned")
    return with_pair_counts(aligned, len(loaded(byte_path, piece_path).bytes_b), tmp)
