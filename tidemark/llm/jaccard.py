"""Jaccard join on word n-grams by signature trees.

1. Copies. Sets are known by two digests; of equal sets one goes on.
2. Candidates. Of a set that links with another, at most floor((1 - threshold) * size) elements are in no other set. The
   elements of a fixed part of the hash space are counted over all sets; a set with more unique ones than that links
   with nothing and is done. The rest, whose texts move, are few where texts are mostly their own.
3. Cells. Two sets that link differ in at most D elements, D from their sizes and the threshold; that holds too when
   the same frequent elements (passages that many candidates share) are left out of both. The hash space is cut into
   more than D segments, so that two linked sets hold the very same elements in some segment. Candidates that share
   a segment's content are tied loosely; the components of these ties are cells. Every link lies inside one cell, so
   cells need no comparison with each other and nothing is lost.
4. Trees. Each cell's sets become leaves of a tree whose nodes hold OR-combined token bitmaps and size ranges. A
   traversal of the tree against itself prunes node pairs by the largest overlap that they could have, and pairs
   already known to be connected; the rest is verified on the sets.
5. Large cells are cut into blocks: trees a block, then over the blocks' least documents, then what is outside a cell's
   largest component against all its blocks. No task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.llm.common import Scratch, n_partitions, table, with_ids, without_ids
from tidemark.llm.components import components
from tidemark.llm.flat import mix, shingle_sets, slices, view

LEAF, FAN = 16, 4
BLOCK_DOCS, BLOCK_BYTES = 4096, 32 << 20
PART = 3  # one element in so many is counted over all sets
SAMPLE, FREQUENT = 16, 8  # of one candidate in so many, elements of so many candidates count as frequent, at least
MOST_FREQUENT = 1 << 22  # frequent elements at most: beyond it, elements must be in more candidates to count
HELD_KEYS = 1 << 20  # keys that a task compares before it sends them
BUCKET = 1 << 21  # counted elements that one bucket holds, on average


@lru_cache(maxsize=None)
def bands(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size bands up to ``largest``: first size, number of segments, most segments in which linked sets differ."""
    ratio = max(1.5, den / num)
    first, segments, differ, lo = [], [], [], 1
    while lo <= largest:
        hi = math.floor(lo * ratio)  # the band's largest size
        d = 2 * hi * (den - num) // (den + num)
        n_min = max(1, lo * num // den)

        def empty(k: int, n: int = n_min) -> float:
            return k * (1 - 1 / k) ** n  # expected empty segments of the band's smallest set

        def fallback(k: int, d: int = d) -> float:
            lam = max(empty(k), 1e-12)
            return 1 - sum(math.exp(i * math.log(lam) - lam - math.lgamma(i + 1)) for i in range(k - d))

        if d <= 64:  # few enough to try all
            best = min(range(d + 1, d + 2 + max(1, d // 3)), key=lambda k: (fallback(k) > 1e-2, fallback(k) if fallback(k) > 1e-2 else k))
        else:  # two deviations above the mean
            best = d + 1
            while best - d <= empty(best) + 2 * math.sqrt(empty(best)):
                best += 1 + (best - d) // 16
        first.append(lo)
        segments.append(best)
        differ.append(d)
        lo = hi + 1
    return np.array(first, np.int64), np.array(segments, np.int64), np.array(differ, np.int64)


def _pooled(keys: list[np.ndarray], own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, own) pairs in order of key, with where a key begins and how often it stands."""
    k, o = np.concatenate(keys), np.concatenate(own)
    order = np.lexsort((o, k))
    k, o = k[order], o[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    k, o = k[new], o[new]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(first)
    return k, o, at, np.diff(np.append(at, len(k)))


def _six(x: np.ndarray) -> bytes:
    """The low six bytes of each value."""
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _whole(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """(bucket, keys, sets) of rows sorted by bucket, one bucket at a time."""
    at, keys, own = None, [], []
    for batch in batches:
        for bucket, k6, s6 in zip(batch.column("bucket").to_pylist(), batch.column("keys"), batch.column("sets"), strict=True):
            if bucket != at and keys:
                yield at, keys, own
                keys, own = [], []
            at = bucket
            keys.append(_whole(k6.as_buffer()))
            own.append(_whole(s6.as_buffer()))
    if keys:
        yield at, keys, own


_MANY = np.uint64(0)  # in place of a set's digest: an element that some task has found in several sets


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, some, d1, d2) of each row: its set's size, how many of them are counted, two digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, rows = shingle_sets(*view(part.column("text")), k)
                d1, d2 = _digests(h, rows, part.num_rows)
                n = np.bincount(rows, minlength=part.num_rows)
                some = np.bincount(rows[h % np.uint64(PART) == 0], minlength=part.num_rows)
                cols = [part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n, some)), *(pa.array(x.view(np.int64)) for x in (d1, d2))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "some", "d1", "d2"])

    return docs.mapInArrow(run, "doc_id long, n long, some long, d1 long, d2 long")


def _digests(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    count = np.bincount(rows, minlength=n)
    full = np.flatnonzero(count)
    for salt in (0, 7):
        total = np.zeros(n, np.uint64)
        if len(full):
            total[full] = np.add.reduceat(mix(h ^ np.uint64(salt)), (np.cumsum(count) - count)[full])
        total[total == _MANY] = 1
        out.append(total)
    return out[0], out[1]


def shared(docs: DataFrame, k: int, elements: int) -> DataFrame:
    """(d1, shared): how many of a set's counted elements are in another set too. elements: how many there are in all.

    Elements go to buckets as six bytes beside six of their set's digest: a false match makes a candidate too many.
    What a task itself finds in several sets it credits there and sends once, so no element fills a bucket.
    """
    buckets = max(n_partitions(docs.sparkSession), -(-elements // BUCKET))
    low = np.uint64((1 << 48) - 1)

    def send(keys: list[np.ndarray], own: list[np.ndarray], task: int) -> pa.RecordBatch:
        key, doc, at, times = _pooled(keys, own)
        several = times > 1
        lead = np.where(several, _MANY, doc[at])
        bucket = ((key[at] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # in order of key
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        to = np.append(cut[1:], len(at))
        credit, n = np.unique(doc[np.repeat(several, times)], return_counts=True)
        rows = [(int(bucket[a]), _six(key[at[a:b]]), _six(lead[a:b])) for a, b in zip(cut.tolist(), to.tolist(), strict=True)]
        if len(credit):
            rows.append((-1 - task, _six(credit), _six(n.astype(np.uint64))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["bucket", "keys", "sets"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        keys, own, held = [], [], 0
        for batch in batches:
            for part in slices(batch):
                h, rows = shingle_sets(*view(part.column("text")), k)
                d1, _ = _digests(h, rows, part.num_rows)
                counted = h % np.uint64(PART) == 0
                keys.append(h[counted])
                own.append(np.maximum(d1 & low, 1)[rows[counted]])
                held += int(counted.sum())
                if held >= HELD_KEYS:
                    yield send(keys, own, task)
                    keys, own, held = [], [], 0
        if held:
            yield send(keys, own, task)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each set is credited with, in buckets of sets: one row a pair of buckets, however many sets it holds."""
        for bucket, keys, own in _buckets(batches):
            if bucket < 0:
                doc, n = np.concatenate(keys), np.concatenate(own)
            else:
                _, doc, first, times = _pooled(keys, own)
                known = np.repeat((times > 1) | (doc[first] == _MANY), times) & (doc != _MANY)
                doc, n = np.unique(doc[known], return_counts=True)
            to = (doc % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to, doc, n = to[order], doc[order], n[order].astype(np.uint64)
            cut = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
            ends = np.append(cut[1:], len(to))
            rows = [(int(to[a]), _six(doc[a:b]), _six(n[a:b])) for a, b in zip(cut, ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["bucket", "keys", "sets"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs_of, n_of in _buckets(batches):
            doc, n = np.concatenate(docs_of), np.concatenate(n_of)
            ids, at = np.unique(doc, return_inverse=True)
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, at, n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total)], ["d", "shared"])

    n = n_partitions(docs.sparkSession)
    form = "bucket long, keys binary, sets binary"

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n, "bucket").sortWithinPartitions("bucket")

    return dealt(dealt(docs.mapInArrow(deal, form)).mapInArrow(count, form)).mapInArrow(tally, "d long, shared long")


def frequent(texts: DataFrame, k: int) -> np.ndarray:
    """A bitmap over hashed shingles that has the frequent ones of ``texts`` set (and a few others that share their bits).

    What it holds only steers which documents meet: any fixed choice of elements to leave out keeps all links. It has
    sixteen bits an element, so what it holds and its error don't depend on the size of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            for part in slices(batch):
                held.append(shingle_sets(*view(part.column("text")), k)[0])
                if sum(map(len, held)) >= HELD_KEYS:
                    yield send()
                    held = []
        if held:
            yield send()

    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SAMPLE)) == 0)
    tmp = Scratch(texts.sparkSession, "op7-frequent")
    often = tmp.write(some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "often")
    # powers of two: the least that leaves no more than MOST_FREQUENT
    power = F.floor(F.log2("n")).cast("int")
    left, least = 0, 0
    for r in sorted(often.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.p):  # 63 rows at most
        if left + r.n > MOST_FREQUENT:
            least = r.p + 1
            break
        left += r.n
    bits = max(1 << 15, 1 << (16 * left).bit_length())
    at = F.pmod(F.col("h"), F.lit(bits)) + 1
    maps = often.where(power >= least).groupBy(F.bitmap_bucket_number(at).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in maps:
        out[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    tmp.drop()
    return out


def is_frequent(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h.view(np.int64) % (8 * len(bitmap))).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def segment_keys(h: np.ndarray, rows: np.ndarray, n: np.ndarray, num: int, den: int, rare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of each segment of each set: in its own size band, and in the next where larger partners may lie.
    rare: which elements segments are made of; sizes and bounds stay those of the whole sets.

    Two sets that link agree in more segments than differ[band] leaves; only where both have so many empty segments that
    agreement might lie in those alone could they share no key. Such sets also give a key for each of their first
    elements, rare ones first, then in order of hash: linked sets share one of the first n - ceil(n * threshold) + 1.
    """
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, segments, differ = bands(num, den, 1 << max(8, int(n.max() * den // num + 1).bit_length()))
    own = np.searchsorted(first, n, "right") - 1
    reach = np.searchsorted(first, n * den // num, "right") - 1
    keys, at = [], []
    for step in (0, 1):
        emit = (n > 0) & (own + step <= reach)
        band = np.where(emit, own + step, 0)
        use = emit[rows] if rare is None else emit[rows] & rare
        hh, rr = h[use], rows[use]
        k = segments[band]
        seg = ((hh >> np.uint64(32)) * k[rr].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        new = np.ones(len(hh), bool)
        new[1:] = (rr[1:] != rr[:-1]) | (seg[1:] != seg[:-1])
        runs = np.flatnonzero(new)
        total = np.add.reduceat(mix(hh ^ np.uint64(0x5A5A5A5A)), runs) if len(runs) else np.zeros(0, np.uint64)
        r, s = rr[runs], seg[runs]
        keys.append(mix(total + mix((band[r] << 32 | s).astype(np.uint64))))
        at.append(r)
        filled = np.bincount(r, minlength=len(n))
        few = emit & (k - filled >= k - differ[band])
        if few.any():
            within = np.arange(len(h)) - (np.cumsum(n) - n)[rows]
            if rare is not None:
                within = np.empty_like(within)
                order = np.lexsort((h, ~rare, rows))
                within[order] = np.arange(len(h)) - (np.cumsum(n) - n)[rows[order]]
            prefix = few[rows] & (within < (n - -(-n * num // den) + 1)[rows])
            keys.append(mix(h[prefix] ^ np.uint64(0xC3C3C3C3)))
            at.append(rows[prefix])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(at) if at else np.zeros(0, np.int64)


def ties(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Distinct (a, b): documents that share a segment's content with the least one of a key.

    Keys repeated within a task become ties there, so a frequent key costs the shuffle one row for a task's buffer.
    """
    common = docs.sparkSession.sparkContext.broadcast(frequent(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            key, doc = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            lead = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            tied = np.unique(np.stack([lead[~new], doc[~new]], axis=1), axis=0) if (~new).any() else np.zeros((0, 2), np.int64)
            tied = tied[tied[:, 0] != tied[:, 1]]
            own = mix(mix(tied[:, 0].astype(np.uint64)) ^ tied[:, 1].astype(np.uint64))
            centre = np.concatenate([np.zeros(int(new.sum()), np.int64), tied[:, 0]])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[new], own]).view(np.int64)),
                    pa.array(np.concatenate([doc[new], tied[:, 1]])),
                    pa.array(centre, mask=np.arange(len(centre)) < new.sum()),
                ],
                ["key", "doc_id", "centre"],
            )

        for batch in batches:
            for part in slices(batch):
                h, rows = shingle_sets(*view(part.column("text")), k)
                key, at = segment_keys(h, rows, np.bincount(rows, minlength=part.num_rows).astype(np.int64), num, den, ~is_frequent(common.value, h))
                keys.append(key)
                ids.append(part.column("doc_id").to_numpy(zero_copy_only=False)[at])
                if sum(map(len, keys)) >= HELD_KEYS:
                    yield send()
                    keys, ids = [], []
        if keys and sum(map(len, keys)):
            yield send()

    found = docs.mapInArrow(run, "key long, doc_id long, centre long")
    least = F.min("doc_id").over(W.partitionBy("key"))
    return found.select(F.coalesce("centre", least).alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with ``elements``, the sorted shingle hashes as bytes, in place of the text."""
    schema = T.StructType([*(f for f in docs.schema if f.name != "text"), T.StructField("elements", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, rows = shingle_sets(*view(part.column("text")), k)
                n = np.bincount(rows, minlength=part.num_rows)
                own = [h[b - c : b].tobytes() for b, c in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
                yield part.drop_columns("text").append_column("elements", pa.array(own, pa.binary()))

    return docs.mapInArrow(run, schema)


class _Union:
    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def tree_links(sets: list[np.ndarray], labels: list[int], chosen: list[bool] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join what is not yet connected: a spanning forest of the links between documents of unlike labels.

    chosen: at least one document of a pair must be chosen, if given.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]) if len(sets[i]) else 0))
    sets = [sets[i] for i in order]
    mark = None if chosen is None else np.array([chosen[i] for i in order])
    joined = _Union([labels[i] for i in order])
    size = np.array([len(s) for s in sets], np.int64)
    bits = min(1 << 14, max(256, 1 << int(2 * size.max()).bit_length()))
    maps = np.zeros((len(sets), bits // 64), np.uint64)
    flat = np.concatenate(sets) & np.uint64(bits - 1)
    np.bitwise_or.at(maps, (np.repeat(np.arange(len(sets)), size), (flat >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (flat & np.uint64(63)))
    slack = size - np.bitwise_count(maps).sum(axis=1)  # elements that share a bit with another of their set

    # levels[0]: leaves; a node: OR of bitmaps, least and largest size, largest slack
    levels, bm, lo, hi, sl, step = [], maps, size, size, slack, LEAF
    while True:
        at = np.arange(0, len(lo), step)
        bm, lo, hi, sl = np.bitwise_or.reduceat(bm, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at)
        levels.append((bm, lo, hi, sl))
        step = FAN
        if len(lo) == 1:
            break
    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        bm, lo, hi, sl = levels[depth]
        keep = np.zeros(len(a), bool)
        for s in range(0, len(a), 4096):
            x, y = a[s : s + 4096], b[s : s + 4096]
            most = np.bitwise_count(bm[x] & bm[y]).sum(axis=1).astype(np.int64) + np.minimum(sl[x], sl[y])
            most = np.minimum(most, np.minimum(hi[x], hi[y]))
            keep[s : s + 4096] = (most * (num + den) >= num * (lo[x] + lo[y])) & (hi[x] * den >= num * lo[y]) & (hi[y] * den >= num * lo[x])
        a, b = a[keep], b[keep]
        if depth:
            n = len(levels[depth - 1][1])
            da, db = np.divmod(np.arange(FAN * FAN), FAN)
            a, b = (a[:, None] * FAN + da).ravel(), (b[:, None] * FAN + db).ravel()
            fits = (a < n) & (b < n) & (a <= b)
            a, b = a[fits], b[fits]
    found: list[tuple[int, int]] = []
    near = np.argsort(b - a, kind="stable")
    for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
        i, j = np.arange(x * LEAF, min((x + 1) * LEAF, len(sets))), np.arange(y * LEAF, min((y + 1) * LEAF, len(sets)))
        roots = {joined.find(int(v)) for v in (*i, *j)}
        if len(roots) == 1:
            continue
        most = np.bitwise_count(maps[i][:, None] & maps[j][None]).sum(axis=2).astype(np.int64) + np.minimum(slack[i][:, None], slack[j][None])
        both = size[i][:, None] + size[j][None]
        ok = (most * (num + den) >= num * both) & (np.minimum(size[i][:, None], size[j][None]) * (num + den) >= num * both) & (i[:, None] < j[None])
        if mark is not None:
            ok &= mark[i][:, None] | mark[j][None]
        for p, q in zip(*(v.tolist() for v in np.nonzero(ok)), strict=True):
            u, v = int(i[p]), int(j[q])
            if (ru := joined.find(u)) != (rv := joined.find(v)):
                both_have = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                if den * both_have >= num * (len(sets[u]) + len(sets[v]) - both_have) and both_have:
                    joined.up[max(ru, rv)] = min(ru, rv)
                    found.append((order[u], order[v]))
    return found


def _by_group(groups: DataFrame, keys: list[str], num: int, den: int, labels: bool) -> DataFrame:
    """Trees of each group of (keys, doc_id, elements, label, chosen); groups stream by in key order.

    labels: (a, b) is each document and the least document that it is connected with; else (a, b) are labels to join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def send() -> pa.RecordBatch:
            ids, own = [x[0] for x in held], [x[2] for x in held]
            got = tree_links([np.frombuffer(x[1], np.uint64) for x in held], own, [x[3] for x in held], num, den) if len(held) > 1 else []
            if labels:
                order = sorted(range(len(ids)), key=ids.__getitem__)
                joined = _Union([ids[i] for i in order])
                place = {i: r for r, i in enumerate(order)}  # in order of id, a root is its component's least id
                for i, j in got:
                    u, v = joined.find(place[i]), joined.find(place[j])
                    joined.up[max(u, v)] = min(u, v)
                a, b = ids, [ids[order[joined.find(place[i])]] for i in range(len(ids))]
            else:
                a, b = [own[i] for i, _ in got], [own[j] for _, j in got]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in keys]
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "elements", "label", "chosen")), strict=True)
            for key, row in zip(zip(*cols, strict=True), rows, strict=True):
                if key != at:
                    if held:
                        yield send()
                    at, held = key, []
                held.append(row)
        if held:
            yield send()

    n = n_partitions(groups.sparkSession)
    return groups.repartition(n, *keys).sortWithinPartitions(*keys).select(*keys, "doc_id", "elements", "label", "chosen").mapInArrow(run, "a long, b long")


def _sized(count: Column, size: Column) -> Column:
    """Into how many blocks so many sets of so many elements go."""
    return F.greatest(F.ceil(count / BLOCK_DOCS), F.ceil(size * 8 / BLOCK_BYTES)).cast("long")


def _blocks(docs: DataFrame) -> DataFrame:
    """``docs`` of cells of two or more, with the cell's number of ``blocks`` and their own ``block``."""
    size = docs.groupBy("cell").agg(_sized(F.count("*"), F.sum("n")).alias("blocks"), F.count("*").alias("in_cell"))
    return docs.join(size.where("in_cell > 1"), "cell").drop("in_cell").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))


def links(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, d1, d2, ..) of every row, and (id, component) of the documents that link with another.

    component: the least document connected.
    """
    tmp = Scratch(docs.sparkSession, "op7")
    every = tmp.write(profiles(docs, k), "profiles")
    key = ["d1", "d2", "n"]
    total = every.agg(F.sum("some")).first()[0] or 0
    known = tmp.write(shared(docs, k, total), "shared")
    alone = F.expr(f"n * {den - num} div {den}")  # elements that are in no set linked with it, at most
    low = F.greatest(F.col("d1").bitwiseAND(F.lit((1 << 48) - 1)), F.lit(1))
    reps = every.where("n > 0").groupBy(*key, "some").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    reps = tmp.write(reps.join(known.withColumnRenamed("d", "low"), low == F.col("low"), "left"), "reps")
    chosen = tmp.write(reps.where(F.col("some") - F.coalesce("shared", F.lit(0)) <= alone).select("doc_id", "n"), "chosen")
    texts = tmp.write(with_ids(docs, chosen.select("doc_id").distinct()), "texts")
    tmp.drop("shared")
    loose = tmp.write(ties(texts, k, num, den), "ties")
    cells = components(loose).select(F.col("id").alias("doc_id"), F.col("component").alias("cell"))
    plan = tmp.write(_blocks(chosen.groupBy("doc_id").agg(F.max("n").alias("n")).join(cells, "doc_id")), "plan")
    tmp.drop("ties")
    sets = sets_of(texts.hint("merge").join(plan.select("doc_id", "cell", "block"), "doc_id"), k)
    found = tmp.write(_by_group(sets.withColumns({"label": F.col("doc_id"), "chosen": F.lit(True)}), ["cell", "block"], num, den, True), "labels").select(F.col("a").alias("rep"), F.col("b").alias("label"))
    wide = plan.where("blocks > 1")
    if wide.limit(1).count():
        found = _large(tmp, wide, texts, found, k, num, den)
    tmp.drop("texts")
    # copies, and rows that share a doc_id, tie what they belong to
    copies = every.join(reps.where("copies > 1").select(*key, F.col("doc_id").alias("rep")), key).select("doc_id", "rep")
    again = every.groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = every.where("n > 0").join(again, "doc_id").join(reps.select(*key, F.col("doc_id").alias("rep")), key)
    twice = tmp.write(twice.select("rep", F.col("doc_id").alias("label")).where("rep <> label").distinct(), "twice")
    pairs = found.where("rep <> label")
    if twice.limit(1).count():
        pairs = components(pairs.unionByName(twice), "rep", "label").select(F.col("id").alias("rep"), F.col("component").alias("label"))
    pairs = tmp.write(pairs.groupBy("rep").agg(F.min("label").alias("label")), "pairs")
    own = pairs.select(F.col("rep").alias("id"), F.col("label").alias("component"))
    of_copies = copies.join(pairs, "rep", "left").select(F.col("doc_id").alias("id"), F.coalesce("label", "rep").alias("component"))
    out = tmp.write(own.unionByName(of_copies).groupBy("id").agg(F.min("component").alias("component")), "components")
    tmp.drop("reps", "chosen", "plan", "labels", "twice", "pairs")
    return every, out


def _large(tmp: Scratch, plan: DataFrame, texts: DataFrame, found: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``found`` (rep, label) with the labels of cells of several blocks joined across their blocks."""
    elements = tmp.write(sets_of(texts.hint("merge").join(plan.select("doc_id"), "doc_id"), k), "large").hint("merge")
    firsts = tmp.write(plan.join(found.withColumnRenamed("rep", "doc_id"), "doc_id"), "firsts")
    roots = elements.join(_blocks(firsts.where("label = doc_id").select("cell", "doc_id", "n")), "doc_id").withColumns({"label": F.col("doc_id"), "chosen": F.lit(True)})
    onto = tmp.write(_by_group(roots, ["cell", "block"], num, den, True).select(F.col("a").alias("label"), F.col("b").alias("onto")).distinct(), "onto")
    rows = tmp.write(firsts.join(onto, "label", "left").withColumn("label", F.coalesce("onto", "label")).drop("onto"), "rest")
    # what is outside its cell's largest component meets every block; a cell of one component is done
    main = rows.groupBy("cell", "label").count().groupBy("cell").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = rows.join(main, "cell").withColumn("minor", F.col("label") != F.col("main"))
    chunks = rest.where("minor").groupBy("cell").agg(_sized(F.count("*"), F.sum("n")).alias("chunks"))
    rest = tmp.write(elements.join(rest.join(chunks, "cell"), "doc_id"), "minor")
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    cols = ["cell", "block", "chunk", "doc_id", "elements", "label"]
    own = rest.where("not minor").withColumn("chunk", numbers("chunks")).select(*cols, F.lit(False).alias("chosen"))
    minor = rest.where("minor").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("chunks")))
    against = minor.drop("block").withColumn("block", numbers("blocks")).select(*cols, F.lit(True).alias("chosen"))
    # minor documents among themselves: chunk i with chunk j, in groups numbered below zero
    other = minor.drop("block").withColumn("other", numbers("chunks"))
    pair = F.struct(F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    among = other.withColumn("p", pair).select("cell", (-1 - F.col("p.i")).alias("block"), F.col("p.j").alias("chunk"), "doc_id", "elements", "label", F.lit(True).alias("chosen"))
    joins = tmp.write(_by_group(own.unionByName(against).unionByName(among), ["cell", "block", "chunk"], num, den, False), "joins")
    tmp.drop("large", "minor")
    changed = found.join(onto, "label", "left").select("rep", F.coalesce("onto", "label").alias("label"))
    if not joins.limit(1).count():
        return changed
    final = components(joins).select(F.col("id").alias("label"), F.col("component").alias("final"))
    return changed.join(final, "label", "left").select("rep", F.coalesce("final", "label").alias("label"))


def _plain(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (itself where nothing links; null for a null doc_id).

    Documents link where den * |intersection| >= num * |union| of their k-word shingles; words are lower-cased (A-Z).
    Null and empty texts link with nothing. Rows that share a doc_id count as one document that links wherever one of
    them does; a null doc_id links with nothing. Other columns are not read.
    """
    plain = _plain(docs, text)
    every, comp = links(plain.where("doc_id is not null"), k, num, den)
    named = every.select("doc_id", "n").join(comp, every.doc_id == comp.id, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    nobody = profiles(plain.where("doc_id is null"), k).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(nobody)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component: that of the least doc_id. Rows with a null doc_id stay."""
    _, comp = links(_plain(docs, "text").where("doc_id is not null"), k, num, den)
    return without_ids(docs, comp.where("id <> component").select(F.col("id").alias("doc_id")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), k=3, num=90)
