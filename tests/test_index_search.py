import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.operators import index as I
from folioforge.operators import search as S

POINT = "point_id string, doc_id string, text string, dense array<float>, seq int"


def point(i, doc, text, seq=0, dense=(1.0, 0.0, 0.0)):
    return (f"p{i}", doc, text, list(dense), seq)


def rows(spark, path):
    return sorted((r.point_id, r.doc_id, r.text) for r in I.read_index(spark, path).collect())


def docs(spark, *ids):
    return spark.createDataFrame([(d,) for d in ids], "doc_id string")


def test_upsert_delete_and_redelivery(spark, tmp_path):
    path = str(tmp_path / "index")
    first = spark.createDataFrame([point(1, "a", "x"), point(2, "a", "y"), point(3, "b", "z")], POINT)
    I.create_index(spark, path, first)
    new = spark.createDataFrame([point(1, "a", "old", 1), point(1, "a", "new", 2), point(9, "c", "other doc")], POINT)
    for _ in range(2):
        I.upsert(spark, path, new, docs(spark, "a"), ["seq"])
        assert rows(spark, path) == [("p1", "a", "new"), ("p3", "b", "z")]
    I.upsert(spark, path, new.limit(0), docs(spark, "a"), ["seq"])
    assert rows(spark, path) == [("p3", "b", "z")]
    assert I.delete_documents(spark, path, ["b", "nope"]) == 1 and I.delete_documents(spark, str(tmp_path / "none"), ["b"]) == 0
    with pytest.raises(ValueError):
        I.delete_documents(spark, path, [""])
    with pytest.raises(ValueError):
        I.upsert(spark, path, spark.createDataFrame([point(1, "a", "x"), point(2, "a", "x", 0, (1.0, 2.0))], POINT), docs(spark, "a"), ["seq"])


def test_a_write_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    I.create_index(spark, path, spark.createDataFrame([point(1, "a", "x"), point(2, "b", "y")], POINT))
    before = rows(spark, path)
    with monkeypatch.context() as m:
        m.setattr(I._Log, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            I.upsert(spark, path, spark.createDataFrame([point(1, "a", "new")], POINT), docs(spark, "a"), ["seq"])
    assert rows(spark, path) == before
    log = I._Log(spark, path)
    with pytest.raises(Exception):
        log.commit(1, "other", False)  # the number is taken


def test_compaction_keeps_the_live_points(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "COMPACT_AFTER", 3)
    path = str(tmp_path / "index")
    I.create_index(spark, path, spark.createDataFrame([point(k, "abc"[k % 3], "old") for k in range(9)], POINT))
    for n in range(5):
        I.upsert(spark, path, spark.createDataFrame([point(0, "a", f"v{n}"), point(50, "zz", "of no document given")], POINT), docs(spark, "a"), ["seq"])
        assert [r for r in rows(spark, path) if r[1] == "a"] == [("p0", "a", f"v{n}")] and len(rows(spark, path)) == 7
    assert len(I._Log(spark, path).generations()) <= 3
    assert I.delete_documents(spark, path, ["b"]) == 3 and len(rows(spark, path)) == 4


def test_embedding_batches_and_retry(spark, tmp_path):
    mark = str(tmp_path / "tried")

    def encoder(texts):
        import os

        if len(texts) > 2:
            raise AssertionError("batch")
        if "slow" in texts and not os.path.exists(mark):
            open(mark, "w").close()
            raise TimeoutError
        return [[float(len(t)), 1.0] for t in texts]

    I.time.sleep, kept = (lambda s: None), I.time.sleep
    try:
        df = spark.createDataFrame([("a", "xx"), ("b", "slow"), ("c", None)], "chunk_id string, text string").coalesce(1)
        got = {r.id: r.dense for r in I.embed_texts(df, encoder, batch=2, retry_on=(TimeoutError,), retries=1).collect()}
    finally:
        I.time.sleep = kept
    assert got == {"a": [2.0, 1.0], "b": [4.0, 1.0], "c": [0.0, 1.0]}
    sparse = I.sparse_weights(spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", None)], "id string, text string"), "id", "text")
    assert [(r.id, len(r.sparse.indices)) for r in sparse.collect()] == [("a", 2)]
    assert I.hybrid(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), sparse).where("sparse is null").count() == 1


def test_dense_ties_filters_and_zero(spark):
    rows_ = [(1, "d", [1.0, 0.0, 0.0]), (2, "d", [0.0, 1.0, 0.0]), (3, "e", [2.0, 0.0, 0.0]), (4, "e", [0.0, 0.0, 0.0]), (5, "e", [1.0]), (6, "e", None), (3, "e", [2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows_, "vec_id bigint, doc_id string, dense array<float>")
    got = [(r.vec_id, round(r.score, 4)) for r in S.dense_top(df, [0.95, 0.05, 0.0], 4).collect()]
    assert got == [(1, 0.9986), (3, 0.9986), (2, 0.0526), (4, 0.0)]
    assert [r.vec_id for r in S.dense_top(df, [1.0, 0.0, 0.0], 4, doc_id="e").collect()] == [3, 4]
    for bad in (lambda: S.dense_top(df, [1.0], 0), lambda: S.check_query(" "), lambda: S.check_query("x", top_n=0)):
        with pytest.raises(ValueError):
            bad()


def test_fusion_and_reranking(spark):
    leg = lambda ids: spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)], "query_id int, id bigint, rank int")
    got = [(r.id, round(r.score, 6)) for r in S.fuse([leg([1, 2, 3]), leg([3, 4])], limit=3, prefetch=2).orderBy("rank").collect()]
    assert got == [(3, round(1 / 63 + 1 / 61, 6)), (1, round(1 / 61, 6)), (2, round(1 / 62, 6))]
    texts = spark.createDataFrame([(1, "nothing"), (3, "alpha beta"), (2, None)], "id bigint, text string")
    queries = spark.createDataFrame([(1, "alpha beta")], "query_id int, query string")
    fused = S.fuse([leg([1, 2, 3])], 3)
    assert [(r.id, r.relevance) for r in S.rerank(fused, texts, queries, 2).orderBy("rank").collect()] == [(3, 1.0), (1, 0.0)]
    hits = fused.join(texts, "id").withColumn("doc_id", F.lit(None).cast("string")).withColumn("section_path", F.lit("a > b"))
    import json

    found = json.loads(S.hits_json(hits).first().hits)["results"]
    assert [h["text"] for h in found] == ["nothing", "", "alpha beta"] and found[0]["doc_id"] == ""


def test_bm25_against_formula(spark):
    texts = {1: "a b b c", 2: "b", 3: "c c d e f", 4: "", 5: None}
    df = spark.createDataFrame([*texts.items(), (1, "a b b c")], "doc_id bigint, text string")
    got = {r.id: r.score for r in S.bm25_scores(df, spark.createDataFrame([(1, "b d zz")], "query_id int, query string")).collect()}
    n, avg = 3, (4 + 1 + 5) / 3
    idf = lambda d: np.log(1 + (n - d + 0.5) / (d + 0.5))
    w = lambda tf, length: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    assert got == pytest.approx({1: idf(2) * w(2, 4), 2: idf(2) * w(1, 1), 3: idf(1) * w(1, 5)})


def test_query_sets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(rng.choice(list("abcdefghij"), 12)), rng.integers(-2, 3, 8).astype(float).tolist()) for i in range(300)] + [(300, None, [0.0] * 8), (301, "", None)]
    df = spark.createDataFrame(texts + texts[:20], "doc_id bigint, text string, v array<double>")
    some = df.where("doc_id % 20 = 0").dropDuplicates(["doc_id"])
    asked, vectors = some.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), some.select(F.col("doc_id").alias("query_id"), F.col("v").alias("vector"))
    rounded = lambda scores: S.top_per_query(scores.withColumn("score", F.round("score", 6)), 10)
    for got, want in [(S.bm25_top_of_set(df, asked, 10), rounded(S.bm25_scores(df, asked)))]:
        got, want = ({(r.query_id, r["rank"]): (r.id, round(r.score, 5)) for r in x.collect()} for x in (got, want))
        assert got == want and len(got) >= 150
    held = {i: np.array(v) for i, _, v in texts if v is not None}
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    want = {}
    for q in [i for i in held if i % 20 == 0]:
        ranked = sorted((-np.floor(float(unit(held[q]) @ unit(v)) * 1e6 + 0.5) / 1e6, i) for i, v in held.items())[:10]
        want |= {(q, n + 1): (i, round(float(-s), 6)) for n, (s, i) in enumerate(ranked)}
    assert {(r.query_id, r["rank"]): (r.id, round(r.score, 6)) for r in S.dense_top_of_set(df, vectors, 10, 8, "doc_id", "v").collect()} == want
