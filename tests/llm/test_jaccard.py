import itertools
import random
import re

import pytest

from tests.llm.conftest import ODD
from tidemark.llm import jaccard
from tidemark.llm.components import components


def sets(rows, k):
    out = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(rows, k, num):
    s = sets(rows, k)
    up = {i: i for i in s}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(s, 2):
        for x, y in itertools.product(s[a], s[b]):
            n = len(x & y)
            if n and 100 * n >= num * (len(x) + len(y) - n):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in s}


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    base = [rnd.choice(words) for _ in range(120)]
    for _ in range(120):
        t = list(base)
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append(" ".join(t))
    for _ in range(60):
        b = [rnd.choice(words) for _ in range(rnd.randint(1, 40))]
        for _ in range(rnd.randint(1, 4)):
            t = list(b)
            if rnd.random() < 0.7:
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append(" ".join(t).upper() if rnd.random() < 0.2 else " ".join(t))
    rows = list(enumerate(rows))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("block", "k", "num"), [(4096, 3, 90), (16, 5, 80)])
def test_components_equal_brute_force(planted, monkeypatch, block, k, num):
    rows, df = planted
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(df, k, num).collect()}
    assert got == brute(rows, k, num)


def test_odd_rows(odd, none):
    got = jaccard.jaccard_join(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[7].component_id == 0 and by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[1].component_id == 1 and by[4].n_shingles == 1 and by[None].component_id is None
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert jaccard.jaccard_join(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_common_passage_does_not_link(spark):
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(100)) + " " + passage) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in jaccard.jaccard_join(df, 3, 90).collect())


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (55, 55), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == got[100] == 100 and got[55] == 55


@pytest.mark.parametrize("num", [80, 90])
def test_linking_sets_share_a_key(num):
    """Pairs at the very limit of the threshold, of all sizes."""
    import numpy as np

    rng = np.random.default_rng(num)
    seen = 0
    for trial in range(500):
        n = int(rng.integers(1, 1500 if trial % 2 else 40))
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        y = np.delete(x, rng.permutation(len(x))[: int(rng.integers(0, int(n * (1 - num / 100)) + 1))])
        more = max(0, len(y) * 100 // num - len(x))
        y = np.unique(np.concatenate([y, rng.integers(0, 2**64, int(rng.integers(0, more + 1)), dtype=np.uint64)]))
        both, either = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if both and 100 * both >= num * either:
            seen += 1
            h, rows = np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)])
            for rare in (None, h % np.uint64(3) > 0, h % np.uint64(50) == 0, np.zeros(len(h), bool)):
                key, row = jaccard.segment_keys(h, rows, np.array([len(x), len(y)]), num, 100, rare)
                assert len(np.intersect1d(key[row == 0], key[row == 1]))
    assert seen > 300
