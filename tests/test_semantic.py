import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexigrid.operators import semantic, vectors
from lexigrid.plans import tables

SF = "/root/testdata/sf0.001"


def matrix(docs, buckets):
    """The whole tf-idf matrix, entry by entry."""
    rows = [r.b for r in docs.select(semantic.buckets_of(F.col("text"), buckets).alias("b")).collect()]
    df = Counter(b for row in rows for b in set(row))
    idf = {b: math.log((1 + len(rows)) / (1 + n)) + 1 for b, n in df.items()}
    out = np.zeros((len(rows), buckets))
    for k, row in enumerate(rows):
        for b, n in Counter(row).items():
            out[k, b] = (1 + math.log(n)) * idf[b]
        out[k] /= np.linalg.norm(out[k]) or 1.0
    return out, rows


def test_singular_values_are_numpys(spark):
    docs = tables.table(spark, SF, "documents")
    model = semantic.fit(docs, dims=12, buckets=2048, over=30, rounds=8)
    a, _ = matrix(docs, 2048)
    want = np.linalg.svd(a, compute_uv=False)[:12]
    assert np.allclose(model.values, want, rtol=1e-3)
    assert np.allclose(model.basis.T @ model.basis, np.eye(12), atol=1e-9)
    # the basis spans what numpy's does, where a value stands apart
    _, _, vt = np.linalg.svd(a, full_matrices=False)
    assert abs(vt[0] @ model.basis[:, 0]) > 0.999


def test_encoder_is_the_projection(spark):
    docs = tables.table(spark, SF, "documents").filter("doc_id < 60").orderBy("doc_id").coalesce(1)
    model = semantic.fit(docs, dims=8, buckets=512, over=8)
    encode = model.encoder(spark)
    got = np.array([r.v for r in docs.select(encode(F.col("text")).alias("v")).collect()])
    a, _ = matrix(docs, 512)
    assert np.allclose(got, a @ model.basis, atol=1e-9)


def test_written_model_is_the_same(spark, tmp_path):
    model = semantic.fit(tables.table(spark, SF, "documents"), dims=5, buckets=256, over=5)
    model.write(spark, str(tmp_path))
    back = semantic.read(spark, str(tmp_path))
    assert np.array_equal(back.idf, model.idf) and np.array_equal(back.basis, model.basis) and np.array_equal(back.values, model.values)


def test_like_texts_are_near(spark, tmp_path):
    """Texts on one matter that share no word with the question come before texts on another."""
    sea = ["the ship sailed over the sea", "a boat and a ship on the sea", "the boat has a sail", "sea and sail and boat"]
    law = ["the court heard the judge", "a judge and a jury in court", "the jury heard a witness", "court and witness and jury"]
    docs = spark.createDataFrame(list(enumerate(sea + law)), "row_idx long, text string")
    encode = semantic.fit(docs, dims=2, buckets=4096, over=6).encoder(spark)
    index = docs.select("row_idx", encode(F.col("text")).alias("embedding"))
    asked = spark.createDataFrame([(0, "boat"), (1, "witness")], "qid long, text string").select("qid", encode(F.col("text")).alias("qvec"))
    got = {}
    for r in vectors.dense_topk(index, asked, 4).collect():
        got.setdefault(r.qid, set()).add(r.row_idx)
    assert got == {0: {0, 1, 2, 3}, 1: {4, 5, 6, 7}}


def test_odd_corpora(spark):
    some = spark.createDataFrame([(None,), ("",), ("a b",), ("a",)], "text string")
    for docs in (some, some.filter("text = ''"), some.filter("false")):
        model = semantic.fit(docs, dims=3, buckets=64, over=2)
        assert len(model.values) == 3 and np.isfinite(model.basis).all()
        got = some.select(model.encoder(spark)(F.col("text")).alias("v")).collect()
        assert len(got) == 4 and all(len(r.v) == 3 and np.isfinite(r.v).all() for r in got) and got[0].v == got[1].v == [0.0] * 3


def test_products_make_no_row_for_an_entry():
    """Rows are multiplied as dense strips: what a task holds and touches is not entries times dims."""
    draw, n = np.random.default_rng(1), 2000
    lists = pa.array([draw.choice(1 << 13, n, replace=False).astype(np.int32) for _ in range(200)], pa.list_(pa.int32()))
    idf, basis = np.ones(1 << 13), draw.standard_normal((1 << 13, 96))
    tracemalloc.start()
    got = semantic.project(lists, idf, basis)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * n * 96 * 8 / 4
    want = np.array([basis[x].sum(axis=0) / math.sqrt(n) for x in lists.to_pylist()])
    assert np.allclose(got, want, atol=1e-9)


def test_texts_are_encoded_once(spark):
    """dense_topk's filter on the vectors does not encode the texts another time."""
    docs = tables.table(spark, SF, "documents")
    encode = semantic.fit(docs, dims=4, buckets=256, over=4, rounds=2).encoder(spark)
    rows = docs.select(F.col("doc_id").alias("row_idx"), encode(F.col("text")).alias("embedding"))
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "qid long, qvec array<double>")
    plan = vectors.dense_topk(rows, asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_rounds_have_no_more_tasks_than_cores(spark, monkeypatch):
    """What a round moves is bounded by the cores, not by the files that a larger table has."""
    seen = []
    whole = semantic._sums
    monkeypatch.setattr(semantic, "_sums", lambda partial, shape: seen.append(partial.rdd.getNumPartitions()) or whole(partial, shape))
    semantic.fit(tables.table(spark, SF, "documents").repartition(23), dims=4, buckets=256, over=4, rounds=2)
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism
