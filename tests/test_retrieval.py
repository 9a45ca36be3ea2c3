import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import hybrid, lexical, vectors

DOCS = [(0, "a b c"), (1, "a a d"), (2, ""), (3, None), (4, "b b b e"), (5, "a b c"), (6, "zz")]


def python_bm25(query):
    docs = {i: (t or "").split() for i, t in DOCS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    out = {}
    for i, d in docs.items():
        f = Counter(d)
        s = sum(idf.get(t, 0) * f[t] * 2.5 / (f[t] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query.split())
        if any(f[t] for t in query.split()):
            out[i] = s
    return out


@pytest.mark.parametrize("query", ["a b", "a a e", "zz", "nothing", ""])
def test_bm25(spark, query):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    q = spark.createDataFrame([(7, query)], "qid long, text string")
    got = lexical.bm25_topk(docs, q, 3).orderBy("rank").collect()
    want = sorted(python_bm25(query).items(), key=lambda x: (-round(x[1], 9), x[0]))[:3]
    want = [(i, s) for i, s in want if s > 0]
    assert [r.row_idx for r in got] == [i for i, _ in want]
    assert all(math.isclose(r.score, s, rel_tol=1e-9) for r, (_, s) in zip(got, want, strict=True))


def test_dense(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, [3.0, 4.0])], "row_idx long, embedding array<double>")
    q = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 1.0])], "qid long, qvec array<double>")
    got = vectors.dense_topk(rows, q, 10).orderBy("qid", "rank").collect()
    assert [(r.qid, r.row_idx, round(r.score, 6)) for r in got] == [(0, 0, 1.0), (0, 3, 0.6), (0, 1, 0.0), (0, 2, -1.0), (1, 3, 0.8), (1, 0, 0.0), (1, 1, 0.0), (1, 2, -0.0)]
    unit = rows.select(vectors.l2_normalize(F.col("embedding")).alias("u")).collect()
    assert [r.u for r in unit] == [[1.0, 0.0], [0.0, 0.0], [-1.0, 0.0], [0.6, 0.8]]


@pytest.mark.parametrize("block", [4096, 7])
def test_dense_random(spark, monkeypatch, block):
    """Against brute force, with equal vectors, several lengths, batches and blocks, and vectors that are no vectors."""
    import numpy as np

    monkeypatch.setattr(vectors, "QUERY_ROWS", block)
    monkeypatch.setattr(vectors, "CELLS", 300)
    monkeypatch.setattr(vectors, "SHARD_ROWS", 90)
    r = np.random.default_rng(1)
    data = [(i, r.integers(-1, 2, 4 if i % 5 else 3).astype(float).tolist()) for i in range(400)]
    odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4)]
    rows = spark.createDataFrame(data + odd, "row_idx long, embedding array<double>").repartition(5)
    asked = [(i, v) for i, v in data[:20]] + [(50, None), (51, [1.0])]
    got: dict = {}
    for x in vectors.dense_topk(rows, spark.createDataFrame(asked, "qid long, qvec array<double>"), 9).orderBy("qid", "rank").collect():
        got.setdefault(x.qid, []).append((x.row_idx, round(x.score, 9) + 0.0))
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    for q, v in asked[:20]:
        scores = sorted((-round(float(unit(v) @ unit(w)), 9), i) for i, w in data if len(w) == len(v))[:9]
        assert got[q] == [(i, -s + 0.0) for s, i in scores]
    assert set(got) == set(range(20))


def _ranked(spark, rows):
    return spark.createDataFrame([(0, i, s, k) for k, (i, s) in enumerate(rows, 1)], "qid long, row_idx long, score double, rank int")


@pytest.mark.parametrize(("wb", "wd"), [(1.0, 1.0), (2.0, 0.5), (0.0, 1.0), (1.0, 0.0)])
def test_rrf(spark, wb, wd):
    lex, den = [(1, 9.0), (2, 8.0), (3, 7.0)], [(3, 0.9), (4, 0.8), (1, 0.7)]
    got = hybrid.rrf_fuse(_ranked(spark, lex), _ranked(spark, den), 60, wb, wd).orderBy("rrf_rank").collect()
    scores: dict = {}
    for w, rows in ((wb, lex), (wd, den)):
        for k, (i, _) in enumerate(rows, 1):
            scores[i] = scores.get(i, 0.0) + w / (60 + k)
    want = sorted(scores.items(), key=lambda x: -round(x[1], 12))  # stable: lexical candidates first
    assert [(r.row_idx, round(r.rrf_score, 12)) for r in got] == [(i, round(s, 12)) for i, s in want]
    four = next(r for r in got if r.row_idx == 4)
    assert four.bm25_rank is None and four.bm25_score == 0.0 and four.dense_rank == 2


def test_rrf_empty_branch_and_pool(spark):
    lex = _ranked(spark, [(1, 9.0), (2, 8.0)])
    fused = hybrid.rrf_fuse(lex, _ranked(spark, [(9, 1.0)]).filter("false"))
    assert [r.row_idx for r in fused.orderBy("rrf_rank").collect()] == [1, 2]
    assert hybrid.pool_cut(fused, 2, 1).count() == 2 and hybrid.pool_cut(fused, 1, 1).count() == 1


def test_hybrid_and_rerank(spark):
    chunks = spark.createDataFrame([(0, "a b", "s0"), (1, "a c", "s1"), (2, "d", "s2")], "row_idx long, text string, source string")
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "row_idx long, embedding array<double>")
    q = spark.createDataFrame([(0, "a", [0.0, 1.0]), (1, "  ", [1.0, 0.0])], "qid long, text string, qvec array<double>")
    hits = hybrid.hybrid_search(chunks, vecs, q, top_k=2).orderBy("rank").collect()
    assert {r.qid for r in hits} == {0} and [r.row_idx for r in hits][0] == 1 and len(hits) == 2
    assert all(r.reranked and r.rerank_score is None and r.score == r.rrf_score for r in hits)
    off = hybrid.hybrid_search(chunks, vecs, q, top_k=2, use_reranker=False).collect()
    assert not any(r.reranked for r in off)
    longest = lambda query, text: F.length(text)
    scored = hybrid.hybrid_search(chunks, vecs, q, top_k=3, scorer=longest).orderBy("rank").collect()
    assert [r.rerank_score for r in scored] == [3.0, 3.0, 1.0] and scored[2].row_idx == 2


def test_encode_and_index(spark, tmp_path):
    from lexigrid.sources import files

    encode = vectors.encoder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], batch_size=2)
    chunks = spark.createDataFrame([(i, f"c{i}", "a", "ch", "s", "u", "x" * i) for i in range(5)], "row_idx long, chunk_id string, article_id string, chapter string, source string, source_url string, text string")
    index, meta = vectors.build_index(chunks, encode, "stub")
    for _ in range(2):  # the second write replaces the first
        files.write_index(index, meta, str(tmp_path / "index"))
    back = files.open_index(spark, str(tmp_path / "index"))
    assert back.count() == 5 and {r.id for r in back.collect()} == {f"chunk_{i}" for i in range(5)}
    row = meta.first()
    assert (row["model"], row["dim"], row["n_chunks"], row["normalised"], row["metric"]) == ("stub", 2, 5, True, "cosine")
