import numpy as np
import pytest

from lexigrid.operators import ann, vectors
from lexigrid.plans import tables

SF = "/root/testdata/sf0.01"


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.qid, set()).add(r.row_idx)
    hits = [len(found.get(q, set()) & w) / len(w) for q, w in want.items()]
    return float(np.mean(hits))


def exact(frame, queries, k):
    out = {}
    for r in vectors.dense_topk(frame, queries, k).collect():
        out.setdefault(r.qid, set()).add(r.row_idx)
    return out


@pytest.fixture(scope="module")
def clustered(spark):
    """Clusters of unlike sizes, one of which holds a third of the rows as copies of one vector."""
    r = np.random.default_rng(3)
    centers = r.standard_normal((40, 24))
    rows = [(i, (centers[r.integers(40)] + 0.3 * r.standard_normal(24)).tolist()) for i in range(4000)]
    rows += [(4000 + i, centers[0].tolist()) for i in range(2000)]
    odd = [(9000, None), (9001, [0.0] * 24), (9002, [1.0] * 5), (9003, [float("nan")] * 24), (9004, [None] * 24), (9005, [])]
    return spark.createDataFrame(rows + odd, "row_idx long, embedding array<double>").repartition(5), rows


def test_recall_and_exact_scores(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 500)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    frame, rows = clustered
    index = ann.build(frame, str(tmp_path / "i"), cells=50)
    assert index.cells.count() == len(rows) and index.cells.select("row_idx").distinct().count() == len(rows)
    asked = [(i, v) for i, v in rows[:150]] + [(7000, None), (7001, [0.0] * 24), (7002, [1.0])]
    queries = spark.createDataFrame(asked, "qid long, qvec array<double>")
    got = ann.search(index, frame, queries, 10, probes=8).collect()
    by_id = dict(rows)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for r in got:
        assert abs(r.score - float(unit(by_id[r.qid]) @ unit(by_id[r.row_idx]))) < 1e-9
    assert recall(got, exact(frame, queries.filter("qid < 7000"), 10)) >= 0.9
    assert {r.qid for r in got} == set(range(150)) and all(sum(r.qid == q for r in got) == 10 for q in (0, 77))
    again = ann.search(ann.read(spark, str(tmp_path / "i")), frame, queries, 10, probes=8).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_all_cells_and_all_rows_are_exact(spark, clustered, tmp_path):
    frame, rows = clustered
    index = ann.build(frame.filter("row_idx < 300"), str(tmp_path / "i"), cells=7, codes=16)
    queries = spark.createDataFrame([(i, v) for i, v in rows[:20]], "qid long, qvec array<double>")
    got = ann.search(index, frame, queries, 5, probes=7, refine=100)
    want = vectors.dense_topk(frame.filter("row_idx < 300"), queries, 5)
    show = lambda df: sorted((r.qid, r["rank"], r.row_idx, round(r.score, 9)) for r in df.collect())
    assert show(got) == show(want)


def test_given_vectors(spark, tmp_path):
    frame, queries = tables.vectors(spark, SF), tables.questions(spark, SF)
    index = ann.build(frame, str(tmp_path / "i"))
    assert recall(ann.search(index, frame, queries, 20).collect(), exact(frame, queries, 20)) >= 0.9


def test_lloyd_is_numpy(spark):
    r = np.random.default_rng(1)
    m = r.standard_normal((300, 6))
    m /= np.linalg.norm(m, axis=1)[:, None]
    frame = spark.createDataFrame([(x.tolist(),) for x in m], "v array<double>").repartition(3)
    start = np.stack([m[:5, :3], m[:5, 3:]])
    got, want = ann.lloyd(frame, start, 3), start.copy()
    for _ in range(3):
        for p in range(2):
            part = m[:, 3 * p : 3 * p + 3]
            near = ((part[:, None] - want[p][None]) ** 2).sum(axis=2).argmin(axis=1)
            want[p] = [part[near == c].mean(axis=0) if (near == c).any() else want[p, c] for c in range(5)]
    assert np.allclose(got, want, atol=1e-9)


def test_few_vectors(spark, tmp_path):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "row_idx long, embedding array<double>")
    index = ann.build(frame, str(tmp_path / "i"))
    got = ann.search(index, frame, spark.createDataFrame([("q", [1.0, 0.1])], "qid string, qvec array<double>"), 5).orderBy("rank").collect()
    assert [r.row_idx for r in got] == [1, 3, 2]
    with pytest.raises(ValueError):
        ann.build(frame.filter("false"), str(tmp_path / "none"))
