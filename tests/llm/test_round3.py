"""Alignment, sharding and spelling variants against plain versions."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tidemark.llm import align, sharding, variants
from tidemark.llm.bpe import tokenizer_path
from tidemark.storage import Scratch

TOUGH = [
    "a  b\n\n c <s> </s> \x00y　z ﬁ é",
    " leading and trailing ",
    "tab\tand \x1c odd \x85 spaces \n y\n  z",
    "already ▁ marked",
    "<|endoftext|> <0x41> don't we'll",
    "日本語のテキスト 🎉🎉🎉 ",
    "x" * 5000,
    " " * 700,
    "a" + " " * 33 + "b",
    "\n",
    "words words words words words",
]


def plain_alignment(docs):
    """Whole texts through the libraries, loops over tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    alphabet = align.byte_level_alphabet()
    links, rows = [], []
    for doc_id, text in docs:
        full = (" " + (text or "")).encode()
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != full or b"".join(bytes_b) != full:
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).astype(int), np.cumsum([len(x) for x in bytes_b]).astype(int)
        shared = sorted({*ends_a.tolist()} & {*ends_b.tolist()})
        groups = [([], []) for _ in shared]
        at = np.searchsorted(np.array(shared, int), np.arange(len(full) + 1)).tolist()
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for i, e in zip(ids, ends, strict=True):
                groups[at[e]][side].append(i)
        links.append(Counter((x, y) for g in groups for x in g[0] for y in g[1]))
        told = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        rows.append([doc_id, len(a), len(b), len(groups), sum(links[-1].values()), hashlib.sha256(told.encode()).hexdigest() if a else ""])
    n = Counter(p for c in links for p in c)
    top = defaultdict(int)
    for (x, _), k in n.items():
        top[x] = max(top[x], k)
    return sorted((str(r[0]), *r[1:5], sum(t for p, t in c.items() if n[p] == top[p[0]]), sum(t * n[p] for p, t in c.items()), r[5]) for r, c in zip(rows, links, strict=True))


def aligned_rows(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


PATHS = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@pytest.mark.parametrize("frequent", [1 << 20, 100])
def test_alignment_equals_plain(spark, odd, frequent):
    """Both ways of counting: all pairs looked up, and all but about a hundred joined."""
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(TOUGH)], "doc_id long, text string"))
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000))
    tmp = Scratch(spark, "test")
    rows = tmp.write(align.align_documents(docs, *PATHS), "aligned")
    got = aligned_rows(align.with_pair_counts(rows, 32_000, tmp, frequent))
    assert got == plain_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_query_and_odd_rows(spark, odd, none):
    from tidemark.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert aligned_rows(QUERIES["op11_alignment"](spark, SF)) == plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    tmp = Scratch(spark, "test")
    assert align.with_pair_counts(tmp.write(align.align_documents(none, *PATHS), "none"), 32_000, tmp).count() == 0
    marked = align.align_documents(odd, *PATHS, with_groups=True).where("doc_id = 4").select("groups").distinct().collect()
    assert [r.groups for r in marked] == ["530|624"]


def test_caches_only_matter_for_speed(monkeypatch):
    both, small = align.Aligner(*PATHS), align.Aligner(*PATHS)
    texts = [t + f" end{i}" for i, t in enumerate(TOUGH)]
    whole = both.align(texts)
    monkeypatch.setattr(align, "CACHE_ENTRIES", 3)
    parts = [small.align([t]) for t in texts]
    assert whole["groups"] == [p["groups"][0] for p in parts]
    assert whole["pairs"].tolist() == [x for p in parts for x in p["pairs"].tolist()] and whole["times"].tolist() == [x for p in parts for x in p["times"].tolist()]


KEYS = np.arange(200_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def test_draws_follow_weights():
    tree = sharding.Tree.even(2, 2, 4).reweighted(3, 5.0).reweighted(9, 0.0)
    share = np.bincount(tree.place(KEYS), minlength=16) / len(KEYS)
    want = np.array([5.0 if s == 3 else 0.0 if s == 9 else 1.0 for s in range(16)]) / 19
    assert np.abs(share - want).max() < 0.004 and share[9] == 0


def test_a_new_shard_takes_rows_only_into_itself():
    tree = sharding.Tree.even(2, 2, 4)
    for step, (region, rack) in enumerate([("region0", "rack0"), ("region1", "rack9"), ("region7", "rack0"), ("region0", "rack0")]):
        more = tree.grown(region, rack)
        a, b = tree.place(KEYS), more.place(KEYS)
        assert (b[a != b] == 16 + step).all()
        assert abs((a != b).mean() - 1 / (17 + step)) < 0.004
        tree = more


def test_a_changed_weight_moves_rows_in_its_subtree_only():
    tree = sharding.Tree.even(3, 3, 3)
    more = tree.reweighted(13, 2.0)  # region1, rack4
    a, b = tree.place(KEYS), more.place(KEYS)
    moved = a != b
    assert (b[moved] // 9 == 1).all()  # nothing moves into or inside other regions
    inside = moved & (a // 9 == 1)
    assert (b[inside] // 3 == 4).all()  # inside the region, only into its rack
    same_rack = inside & (a // 3 == 4)
    assert (b[same_rack] == 13).all()


def test_shards_have_gapless_slots_and_all_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(sharding, "FILE_BYTES", 20_000)  # several files a shard
    tree = sharding.Tree.even(1, 2, 1)
    got = sharding.write_shards(odd, tree, tree.grown("r", "k"))
    assert set(odd.columns) < set(got.columns)
    rows = got.select("doc_id", "text", "source", "shard", "slot", "grown_shard").collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.source) for r in rows))) == sorted(map(str, ((r.doc_id, r.text, r.source) for r in odd.collect())))
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 2) for r in rows)
    assert sharding.write_shards(none, tree).count() == 0


def test_sharding_query(spark):
    from tidemark.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_sharding"](spark, SF).collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"key"}
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_do_not_depend_on_the_session(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text")
    one = {r.doc_id: r.s for r in docs.select("doc_id", sharding.shard_of(F.col("doc_id"), sharding.Tree.even(2, 2, 4)).alias("s")).collect()}
    two = {r.doc_id: r.s for r in docs.repartition(7, "text").select("doc_id", sharding.shard_of(F.col("doc_id"), sharding.Tree.even(2, 2, 4)).alias("s")).collect()}
    assert one == two


def plain_words(docs):
    import re

    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(n, ratio=10):
    near = {w: [v for v in n if abs(len(w) - len(v)) < 2 and one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v)) if vs else None
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_variants_query(spark):
    from tidemark.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op13_variants"](spark, SF).collect()
    want = plain_variants(plain_words(docs))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def chained():
    rng = np.random.default_rng(5)
    n = {}
    for base, k in (("abcdefgh", 100_000), ("abcdefg", 9_000), ("abcdexg", 700), ("abcdxxg", 60), ("abxdxxg", 3), ("ééééééé", 50), ("éééééééé", 5), ("aaaaaaaa", 20), ("aaaaaaaaa", 20), ("a" * 400, 2), ("a" * 401, 30)):
        n[base] = k
    for _ in range(400):  # one head and one tail that very many words share
        n["prefix" + "".join(rng.choice(list("abcdé"), 4))] = int(rng.integers(2, 4000))
        n["".join(rng.choice(list("abcdé"), 4)) + "suffix"] = int(rng.integers(2, 4000))
    return n


@pytest.mark.parametrize("limit", [4, 50, 1024])
def test_variants_of_hot_cells_and_chains(spark, limit):
    n = chained()
    words = spark.createDataFrame(list(n.items()), "word string, n long").withColumn("size", F.lit("x"))
    assert {tuple(r) for r in variants.variants(words, limit=limit).collect()} == plain_variants(n)


def test_position_index_equals_plain():
    words = [w.encode("latin-1") for w in chained()] + [b"b", b"", b"ab"]
    q, v = variants.PositionIndex(words).near(words)
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)}
    assert set(zip(q.tolist(), v.tolist(), strict=True)) == want


def test_variants_of_odd_tables(spark, odd, none):
    assert variants.variants(variants.occurrences(none)).count() == 0
    got = {(r.word, r.n) for r in variants.occurrences(odd).collect()}
    assert got == set(plain_words([(r.doc_id, r.text) for r in odd.collect()]).items())
