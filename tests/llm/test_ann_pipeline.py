import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tidemark.llm import ann


def test_recall_against_brute_force(spark):
    sf = SF.replace("0.001", "0.1")
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in e]), np.array([r.embedding for r in e], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.op5_ann(spark, sf).collect():
        got.setdefault(r.query_id, []).append(r)
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[i] = -9
        rows = sorted(got[ids[i]], key=lambda r: r.rank)
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and all(a.score >= b.score for a, b in zip(rows, rows[1:], strict=False))
        for r in rows:
            assert abs(r.score - s[np.searchsorted(ids, r.vec_id)]) < 1e-12
        hit += len({*ids[np.argsort(-s)[:5]]} & {r.vec_id for r in rows})
        total += 5
    assert hit / total >= 0.9


def test_recall_at_every_size_of_a_part(spark):
    """The shipped share alone, of small and large parts, against brute force."""
    e = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    for n in (300, 1000, 2000):
        part = e.orderBy(F.xxhash64("vec_id")).limit(n)
        rows = part.collect()
        ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        got = {}
        for r in ann.nearest(part.coalesce(1), "vec_id % 10 = 0").collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hit = total = 0
        for i in np.flatnonzero(ids % 10 == 0):
            s = u @ u[i]
            s[i] = -9
            hit += len({*ids[np.argsort(-s)[:5]]} & got[ids[i]])
            total += 5
        assert hit / total >= 0.9, (n, hit / total)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (50, [0.0, 1.0]), (100, []), (9, [1e-30, 1e-30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as v", "1 as perm", "2 as rank")
    got = ann.nearest(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 9), (0, 4, 50), (50, 1, 9), (50, 2, 0), (50, 3, 1), (50, 4, 2)]
    assert ann.nearest(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_parts_and_blocks_of_any_size(spark):
    """All pairs by brute force where everything is reranked, over many parts and query blocks; vectors without loss."""
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(700, 8)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(9)
    got = {}
    for r in ann.nearest(df, "vec_id % 3 = 0", k=4, share=1.0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 700, 3):
        s = u @ u[i]
        s[i] = -9
        best = np.lexsort((np.arange(700), -s))[:4]
        assert [got[i][k + 1][0] for k in range(4)] == best.tolist()
        assert np.allclose([got[i][k + 1][1] for k in range(4)], s[best], atol=1e-12)


def test_equal_vectors_tie_to_smaller_ids(spark):
    df = spark.range(3000).selectExpr("id as vec_id", "array(1.0, 2.0, 0.5) as embedding")
    got = [r.vec_id for r in ann.nearest(df, "vec_id = 0").orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5]


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from tidemark.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(p.STAGES):
        out = written(stage(spark, docs, SF), "test-stage")
        if i < len(p.STAGES) - 1:
            assert out.columns == columns and out.count() > 0, name
        if name == "quality classifier":
            good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").join(docs, "doc_id")
            assert good.join(out, "doc_id").count() >= 0.97 * good.count()
        if name == "line dedup":
            assert out.count() == docs.count()
        if name == "n-gram Jaccard join":
            assert out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
        docs = out
    assert docs.count() > n / 2 and "ids_sha256" in docs.columns


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_pipeline_of_odd_rows(spark, odd):
    """Nulls, empty and very long texts, repeated rows and clashing names through all five stages."""
    import corpus_pipeline as p
    from tidemark.llm.common import written

    docs = odd.withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    columns = docs.columns
    for i, (name, stage) in enumerate(p.STAGES):
        docs = written(stage(spark, docs, SF), "test-odd")
        if i < len(p.STAGES) - 1:
            assert docs.columns == columns, name
        rows = docs.select("doc_id", *(["text"] if "text" in docs.columns else [])).collect()
        ids = [r.doc_id for r in rows]
        if name == "quality classifier":
            assert {1, 2, None} <= set(ids)  # without words: weight 0, as likely good as not
        if name == "line dedup":
            text = {r.doc_id: r.text for r in rows}
            assert text[1] is None and text[2] == "" and text.get(7, "") == ""
        if name == "n-gram Jaccard join":
            assert 1 in ids and 7 not in ids and ids.count(2) == 1
        if name == "mixing sources to target weights":
            assert ids.count(1) == ids.count(2) == 1  # without words: once
    assert {"n_tokens", "ids_sha256"} <= set(docs.columns)
