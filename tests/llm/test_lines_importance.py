import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, SF
from tidemark.llm import importance, lines
from tidemark.llm.flat import view


def chunks(text):
    """Every two neighbouring lines that aren't both blank: (bytes, start, end, 2)."""
    raw, at, spans = text.encode(), 0, []
    for line in raw.split(b"\n"):
        spans.append((at, at + len(line)))
        at += len(line) + 1
    if spans[-1][0] == len(raw):
        spans.pop()
    both = [(raw[a:d], a, d, 2) for (a, _), (_, d) in zip(spans, spans[1:], strict=False)]
    return [(x.decode(), a, d, n) for x, a, d, n in both if x.strip(b" \t\n\v\f\r")]


def pieces(*texts):
    import pyarrow as pa

    data, offs = view(pa.array(texts))
    return data, *lines.line_chunks_of(data, offs)


def plain(rows):
    """The kept text of each document by a plain walk over all chunks in order."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        cut = []
        for body, a, b, _ in chunks(t):
            if body in seen:
                cut.append((a, b))
            seen.add(body)
        raw, kept, done = t.encode(), [], 0
        for a, b in cut:
            kept.append(raw[done:a])
            done = min(len(raw), b + 1)
        out[i] = b"".join([*kept, raw[done:]]).decode()
    return out


def test_chunks_cover_whole_lines():
    rnd = random.Random(1)
    text = "\n".join(f"line {rnd.randrange(10**6)}" for _ in range(200)) + "\n"
    data, c, w = pieces("one\ntwo", text, "", "\n\n")
    bodies = [data[a : a + k].tobytes().decode() for a, k in zip(c["start"], c["size"], strict=True)]
    assert "\n".join(b for b, r in zip(bodies, c["row"], strict=True) if r == 1) + "\n" == text
    assert [b.count("\n") + 1 for b, r in zip(bodies, c["row"], strict=True) if r == 1] == c["lines"][c["row"] == 1].tolist()
    assert 30 < (c["row"] == 1).sum() < 75 and set(c["lines"][c["row"] == 3]) == {1}
    assert [x[:2] for x in chunks(text)] == [(data[a : a + k].tobytes().decode(), a - c["start"][c["row"] == 1][0]) for a, k, r in zip(w["start"], w["size"], c["row"][w["chunk"]], strict=True) if r == 1]
    inner = np.bincount(w["chunk"], w["inner"], len(c["lines"]))
    assert (inner[c["row"] == 1] == c["lines"][c["row"] == 1] - 1).all()


def test_boundaries_resist_shifts():
    rnd = random.Random(2)
    text = "\n".join(f"line {rnd.randrange(10**6)}" for _ in range(400))
    cut = text.split("\n")
    moved = "\n".join(["new one", "and two", *cut[:200], "in between", *cut[200:]])
    _, a, _ = pieces(text)
    _, b, _ = pieces(moved)
    keys = [set(zip(x["h1"].tolist(), x["h2"].tolist(), x["size"].tolist(), strict=True)) for x in (a, b)]
    assert len(keys[0] - keys[1]) <= 3 and len(keys[0]) > 60


def test_large_chunks_carry_most_of_a_repeated_run(spark):
    """Copies of a long run: few windows are left to look at, and a wrong chunk hash changes nothing in the result."""
    rnd = random.Random(3)
    shared = [f"shared {rnd.randrange(10**6)}" for _ in range(80)]
    df = spark.createDataFrame([(i, "\n".join([f"own {i}", *shared[i:], f"end {i}"])) for i in range(12)], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in df.collect()}
    want = plain(sorted(rows.items()))
    assert {r.doc_id: r.text for r in lines.drop_repeats(df).collect()} == want
    assert {(r.doc_id, r.own): len(r.cut) for r in lines.repeats(df, coarse=False).collect()}.keys() == {(r.doc_id, r.own) for r in lines.repeats(df).collect()}
    few, many = (sum(len(r.cut) for r in lines.repeats(df, coarse=c).collect()) for c in (True, False))
    assert few < many / 1.5


def test_removal_equals_the_plain_walk(spark):
    rnd = random.Random(4)
    shared = [f"shared line {i}" for i in range(30)]
    rows = []
    for i in range(60):
        body = [f"own {i} {rnd.randrange(10**6)}" for _ in range(10)]
        at = rnd.randrange(10)
        rows.append((i, "\n".join(body[:at] + shared[rnd.randrange(10) :] + body[at:]) + "\n" * (i % 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lines.drop_repeats(df).collect()}
    want = plain(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert sum(r.removed_chunks for r in got.values()) >= 40
    assert all("own" in r.text for r in got.values())


def shared_runs(rows):
    """Brute force: (doc, first line, last line) of the maximal runs of lines whose neighbours, two by two, stood before."""
    first, out = {}, []
    for i, t in sorted(rows):
        ls = t.removesuffix("\n").split("\n")
        gone = set()
        for j, pair in enumerate(zip(ls, ls[1:])):
            k, at = first.setdefault(pair, (i, j))
            if (k != i or j > at + 1) and re.search(r"[^\x20\x09-\x0D]", "".join(pair)):
                gone |= {j, j + 1}
        out += [(i, j) for j in sorted(gone)]
    runs = []
    for i, j in out:
        if runs and runs[-1][0] == i and runs[-1][2] == j - 1:
            runs[-1] = (i, runs[-1][1], j)
        else:
            runs.append((i, j, j))
    return runs


def test_every_shared_run_goes_whole(spark):
    """Runs of two lines and more go in full, wherever they stand; the first occurrence, single lines and the rest stay."""
    rnd = random.Random(8)
    passages = [[f"passage {p} line {j} " + "w " * 30 for j in range(rnd.choice([2, 2, 3, 4, 9]))] for p in range(40)]
    rows, want = [], {}
    for i in range(120):
        p = i % 40
        own = [f"own {i} {j}" for j in range(rnd.randrange(1, 6))]
        at = rnd.randrange(len(own) + 1)
        rows.append((i, "\n".join([*own[:at], *passages[p], *own[at:], f"mark {i}", "a common line", f"tail {i}"]) + "\n" * (i % 2)))
        want[i] = "\n".join([*own[:at], *(passages[p] if i < 40 else []), *own[at:], f"mark {i}", "a common line", f"tail {i}"]) + "\n" * (i % 2)
    got = {r.doc_id: r for r in lines.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.text for i, r in got.items()} == want
    runs = shared_runs(rows)
    assert len(runs) == sum(r.removed_chunks for r in got.values()) == 80
    assert sum(b - a + 1 for _, a, b in runs) == sum(r.removed_lines for r in got.values())


def test_recall_of_shared_runs_in_documents(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").where("text like '%\n%'")
    rows = {r.text: r.doc_id for r in docs.orderBy(F.desc("doc_id")).collect()}
    rows = [(i, t) for t, i in rows.items()]
    got = {r.doc_id: r for r in lines.drop_repeats(spark.createDataFrame(rows, docs.schema)).collect()}
    runs, text = shared_runs(rows), dict(rows)
    long = [r for r in runs if sum(len(x.split()) for x in text[r[0]].split("\n")[r[1] : r[2] + 1]) > 50]
    assert long
    for i in {i for i, *_ in long}:
        gone = {j for k, a, b in runs if k == i for j in range(a, b + 1)}
        left = [x for j, x in enumerate(text[i].split("\n")) if j not in gone and x.strip()]
        assert [x for x in got[i].text.split("\n") if x.strip()] == left


def test_a_line_that_follows_itself(spark):
    df = spark.createDataFrame([(1, "a\na\na\na\nb"), (2, "x\na\na\ny")], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.removed_lines) for r in lines.drop_repeats(df).collect()} == {1: ("a\na\nb", 2), 2: ("x\ny", 2)}


def test_line_dedup_on_odd_rows(odd, none):
    got = lines.drop_repeats(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[0].text == ODD[0][1] and by[0].key == "x" and by[0].size == "z"
    assert by[None].text == ODD[-1][1]
    assert lines.drop_repeats(none).count() == 0


def test_kth_largest(spark):
    rnd = np.random.default_rng(1)
    v = [float(x) for x in rnd.normal(size=500)] + [1.5] * 40
    df = spark.createDataFrame([(x,) for x in v], "x double")
    s = sorted(v, reverse=True)
    for k in (1, 7, 60, 300, len(v)):
        assert importance.kth_largest(df, "x", k, bins=8) == s[k - 1]


def test_resampling_keeps_good_and_rejects_junk(spark):
    sf = SF.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where("doc_id % 3 = 0").toPandas()
    kept = {r.doc_id for r in importance.resample(docs, labels.where("doc_id % 3 <> 0")).select("doc_id").collect()}
    good, junk = held[(held.quality == 1) & (held.toxic == 0)], held[held.quality == 0]
    assert good.doc_id.isin(kept).mean() >= 0.98
    assert junk.doc_id.isin(kept).mean() <= 0.5


def test_long_good_documents_leave_short_junk_no_room(spark):
    """On a table with long documents, junk goes at every length; good documents that the model never saw stay."""
    sf = SF.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(docs.select("doc_id"), "doc_id", "left_semi")
    # every eighth good document becomes a long one of thirty others of its kind, one after another
    good = labels.where("quality = 1 and toxic = 0").join(docs, "doc_id").select("doc_id", "text").orderBy("doc_id").toPandas()
    many = [("\n".join(good.text[(i + j) % len(good)] for j in range(30)), int(good.doc_id[i])) for i in range(0, len(good), 8)]
    long = spark.createDataFrame(many, "text string, doc_id long")
    docs = docs.join(F.broadcast(long.select("doc_id")), "doc_id", "left_anti").unionByName(long)
    held = labels.where("doc_id % 3 = 0").toPandas()
    kept = {r.doc_id for r in importance.resample(docs, labels.where("doc_id % 3 <> 0")).select("doc_id").collect()}
    words = {r.doc_id: len((r.text or "").split()) for r in docs.join(F.broadcast(labels.where("quality = 0").select("doc_id").distinct()), "doc_id").collect()}
    fine, junk = held[(held.quality == 1) & (held.toxic == 0)], held[held.quality == 0]
    short, far = junk[junk.doc_id.map(words) <= 200], fine[fine.doc_id.isin([d for _, d in many])]
    print("kept good, long good, junk, short junk", *(x.doc_id.isin(kept).mean() for x in (fine, far, junk, short)), len(far), len(short))
    assert fine.doc_id.isin(kept).mean() >= 0.98 and far.doc_id.isin(kept).mean() >= 0.98
    assert junk.doc_id.isin(kept).mean() <= 0.2 and short.doc_id.isin(kept).mean() <= 0.25


def test_a_pair_across_two_runs_that_go(spark):
    """Its lines stay where the runs stood first; the pair itself stands in neither of its documents."""
    rows = [(0, "x\na"), (1, "b\ny"), (2, "x\na\nb\ny"), (3, "a\nb")]
    got = {r.doc_id: r.text for r in lines.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "x\na", 1: "b\ny", 2: "", 3: ""}


def test_unlike_rows_that_share_an_id_lose_only_what_is_theirs(spark):
    """A cut stays in the row that it was found in; characters of several bytes stay whole."""
    rows = [(1, "p\nq\nr"), (5, "p\nq\nzz"), (5, "own words that stand nowhere else\nand more\nééé"), (5, "p\nq\nzz"), (6, "first\nsecond")]
    got = lines.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "p\nq\nr"), (5, "own words that stand nowhere else\nand more\nééé"), (5, "zz"), (5, "zz"), (6, "first\nsecond")]


def test_spread_of_weights():
    rnd = np.random.default_rng(3)
    n = rnd.integers(1, 2000, 4000)
    noisy = -0.2 * n + rnd.normal(size=4000) * np.sqrt(n * 0.5 + n * n * 0.001)
    mean, own, shared = importance.spread(n, noisy)
    assert abs(mean + 0.2) < 0.01 and 0 <= own < 2 and 0.0008 < shared < 0.0012


def test_resampling_equals_a_plain_version(spark):
    """Counts, weights, standings, keys and the choice, one document and one n-gram at a time."""
    import math
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: (r.text or "", r.u) for r in docs.select("*", F.xxhash64("doc_id", F.lit(importance.SEED)).alias("u")).collect()}
    folds = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(importance.SEED + 1)), F.lit(5)).alias("f")).collect()}
    by = {}
    for r in labels.collect():
        by.setdefault(r.doc_id, []).append((r.quality, r.toxic))
    good = {i for i, x in by.items() if min(q for q, _ in x) == 1 and max(t or 0 for _, t in x) == 0 and i in rows}

    def bucket(*words):  # of one n-gram alone
        raw = " ".join(words).encode()
        return int(importance.ngram_buckets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][-1])

    seen = {}
    grams = {}
    for i, (t, _) in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        grams[i] = [seen.setdefault(g, bucket(*g)) for g in [(x,) for x in w] + list(zip(w, w[1:], strict=False))]
    size = importance.BUCKETS
    target, raw = [0] * size, [0] * size
    for i, g in grams.items():
        for b in g:
            raw[b] += 1
            target[b] += i in good and folds[i] != 0
    ratio = [math.log((a + 1) / (sum(target) + size)) - math.log((b + 1) / (sum(raw) + size)) for a, b in zip(target, raw, strict=True)]
    weight = {i: sum(ratio[b] for b in g) for i, g in grams.items()}
    held = [i for i in good if folds[i] == 0]
    mean, own, shared = importance.spread([len(grams[i]) for i in held], [weight[i] for i in held])
    stand = {i: (weight[i] - len(g) * mean) / math.sqrt(1 + len(g) * own + len(g) ** 2 * shared) for i, g in grams.items()}
    key = {i: stand[i] / 0.5 - math.log(-math.log((((u % 2**64) >> 11) + 0.5) / 2**53)) for i, (_, u) in rows.items()}
    for k in (1, 100, 600):
        got = {r.doc_id: r for r in importance.resample(docs, labels, k=k, temperature=0.5).collect()}
        assert set(got) == set(sorted(key, key=lambda i: -key[i])[:k])
        assert all(abs(r.log_weight - weight[i]) < 1e-6 and abs(r.sample_key - key[i]) < 1e-6 for i, r in got.items())
    # without k: as many as stand as high as 99 % of held-out good ones; noise swaps some at the edge
    least = np.quantile([stand[i] for i in held], 0.01)
    k = sum(x >= least - 1e-9 for x in stand.values())
    got = {r.doc_id for r in importance.resample(docs, labels, keep=0.99, temperature=0.5).collect()}
    assert got == set(sorted(key, key=lambda i: -key[i])[:k]) != {i for i, x in stand.items() if x >= least}
    assert importance.resample(docs, labels, k=0).count() == 0 and importance.resample(docs, labels, k=10**6).count() == len(rows)


def test_resampling_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0), (7, 1, 0), (0, 1, 0), (None, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = importance.resample(odd, labels)
    assert {r.doc_id for r in got.select("doc_id").collect()} & {0, 7}
    assert set(odd.columns) <= set(got.columns)
    assert importance.resample(none, labels).count() == 0
    assert importance.resample(odd, labels.limit(0)).count() == len(ODD)
    first, again = (sorted(r.sample_key for r in importance.resample(odd, labels).collect()) for _ in range(2))
    assert first == again
