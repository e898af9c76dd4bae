"""Words, lines and shingles of many texts as flat numpy arrays over one byte buffer.

Every function works on a slice of a few MB, so that a task's memory does not depend on its number of rows; one
document is never split, so a very long text costs memory in proportion to its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): a bijection that spreads each input bit over all output bits."""
    x = x + _G
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_ODD = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _ODD, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts hold ``limit`` bytes, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    offs = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte run data[start:end]; empty runs hash by their length 0.

    Places are of four bytes where they fit, and values are multiplied in place: a byte of text costs about 26.
    """
    lens = ends - starts
    out = np.zeros(len(starts), np.uint64)
    if total := int(lens.sum()):
        full = lens > 0
        s, n = starts[full], lens[full]
        first = np.cumsum(n) - n
        kind = np.int32 if max(total, len(data)) < 1 << 31 else np.int64
        at = np.arange(total, dtype=kind)
        at += np.repeat((s - first).astype(kind), n)
        vals = _BYTE[data[at]]
        at -= np.repeat(s.astype(kind), n)
        vals *= powers(int(n.max()))[at]
        out[full] = np.add.reduceat(vals, first)
    return mix(out ^ mix(lens.astype(np.uint64) + np.uint64(seed)))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word in the buffer."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word, A-Z lower-cased if asked."""
    starts, ends, rows = words(data, offs)
    return hash_runs(LOWER[data] if lower else data, starts, ends), rows


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct k-word shingles as sorted 64-bit hashes: (hash, row), rows ascending.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    h, rows = word_hashes(data, offs)
    n = len(offs) - 1
    count = np.bincount(rows, minlength=n)
    first = np.cumsum(count) - count
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.full(len(h), k, np.uint64)
    for i in range(k):
        nxt = np.zeros(len(h), np.uint64)
        left = max(0, len(h) - i)
        nxt[:left] = h[i : i + left]
        acc = mix(acc * _ODD ^ nxt)
    place = np.arange(len(h)) - first[rows]
    keep = place + k <= count[rows]
    sh, at = acc[keep], rows[keep]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        extra = np.empty(len(few), np.uint64)
        for j, r in enumerate(few):  # at most k - 1 words each
            x = np.array([count[r]], np.uint64)
            for i in range(first[r], first[r] + count[r]):
                x = mix(x * _ODD ^ h[i : i + 1])
            extra[j] = x[0]
        sh, at = np.concatenate([sh, extra]), np.concatenate([at, few])
    order = np.lexsort((sh, at))
    sh, at = sh[order], at[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (at[1:] != at[:-1])
    return sh[new], at[new]
