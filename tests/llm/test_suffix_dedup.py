import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import queries
from lexigrid.llm import suffix_dedup as S


def plain(docs, length):
    """doc_id -> (n_bytes, n_removed, n_spans, kept): every string of every text, one after another."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            string = data[k : k + length]
            if string in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(string)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone, strict=True) if not g))
    return out


def check(spark, docs, length=20, grain=8, batches=4, block=1 << 18):
    got = S.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), length, grain, batches, block).collect()
    want = plain(docs, length)
    assert len(got) == len(docs)
    for r in got:
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest()), r.doc_id
        assert r.kept is None and removed == 0 or bytes(r.kept) == kept


def texts(seed, n=60):
    """Texts that share passages, with edits, periods, copies and letters of several bytes."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdéü日") for _ in range(draw.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(draw.randrange(4, 30))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(draw.randrange(0, 7)):
            x = draw.choice(passages)
            kind = draw.randrange(5)
            if kind == 0:
                x = " ".join(word() for _ in range(12))
            elif kind == 1:
                at = draw.randrange(len(x))
                x = x[:at] + "#" + x[at + 1 :]
            elif kind == 2:
                a = draw.randrange(len(x))
                x = x[a : a + draw.randrange(40)]
            elif kind == 3 and draw.random() < 0.3:
                x = draw.choice(["a", "ab", "abc "]) * draw.randrange(1, 60)
            parts.append(x)
        out.append(draw.choice([" ", ""]).join(parts))
    return out + [out[3], out[3], out[7], "", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_is_brute_force(spark, seed):
    check(spark, list(enumerate(texts(seed))))


def test_levels_and_blocks(spark):
    """More batches than two levels hold, texts longer than a block, ids in another order than rows."""
    docs = texts(3, 40)
    docs[5] = docs[6] = " ".join(docs[:12])
    ids = random.Random(4).sample(range(-50, 1000), len(docs))
    check(spark, list(zip(ids, docs, strict=True)), batches=7, block=64)


def test_one_batch_is_the_same(spark):
    check(spark, list(enumerate(texts(5, 25))), batches=1)


def test_group_of_copies_and_common_passage(spark):
    same, passage = "the same text in many documents " * 2, "a passage that a third of them share, "
    docs = [same] * 40 + [f"{k * k} {passage}{k * 7919}" for k in range(40)] + ["x" * 300, "x" * 19, "x" * 20]
    check(spark, list(enumerate(docs)))


def test_levels_merge_geometrically(spark):
    index, sizes = S.SuffixIndex(spark, 20, 8), []
    docs = [t for t in texts(6, 30) if t]
    hits = set()
    for k in range(6):
        rows = spark.createDataFrame([(k * 100 + i, 0, t) for i, t in enumerate(docs[k::6])], "doc long, row long, text string").withColumn("text", F.col("text").cast("binary"))
        hits |= {tuple(r) for r in index.add(index.suffixes(rows)).collect()}
        sizes.append([n for n, _, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]
    contexts = [(r.g, r.c) for _, name, _ in index.levels for r in spark.table(name).collect()]
    begins = [r.g for _, _, name in index.levels for r in spark.table(name).collect()]
    assert len(contexts) == len(set(contexts)) and len(begins) == len(set(begins)) and any(k for _, _, k in hits) and any(not k for _, _, k in hits)
    tables = [name for level in index.levels for name in level[1:]]
    index.drop()
    assert not any(spark.catalog.tableExists(t) for t in tables)


def test_scan_moves_no_level(spark):
    """A level is joined as it lies: its side of the merge has no exchange."""
    index = S.SuffixIndex(spark, 20, 8)
    rows = spark.range(200).select(F.col("id").alias("c"))
    name = index._write(rows, "c")
    new = spark.range(100, 300).select((F.col("id") * 1).alias("k")).repartition(index.buckets, "k")
    plan = new.join(spark.table(name).hint("merge"), F.col("k") == F.col("c"), "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    index._drop(name)


def test_every_string_is_in_one_context():
    draw = np.random.default_rng(1)
    docs = [bytes(draw.integers(97, 100, n, dtype=np.uint8)) for n in (0, 5, 19, 20, 21, 300, 64, 700)] + [b"a" * 90, b"ab" * 70]
    tool = S.Contexts(20, 8, 128)
    doc, first, n, g, c, _ = tool.of(np.frombuffer(b"".join(docs), dtype=np.uint8), np.cumsum([len(d) for d in docs]))
    held, least = {}, {}
    for k, a, m, x, y in zip(doc.tolist(), first.tolist(), n.tolist(), g.tolist(), c.tolist(), strict=True):
        assert held.setdefault(y, docs[k][a : a + m + 19]) == docs[k][a : a + m + 19]
        for at in range(a, a + m):
            assert (k, at) not in least
            least[k, at] = x
    assert sorted(least) == [(k, at) for k, d in enumerate(docs) for at in range(len(d) - 19)]
    by_string = {}
    for (k, at), x in least.items():
        assert by_string.setdefault(docs[k][at : at + 20], x) == x


def test_parts_lie_alike_in_equal_contexts():
    """Cuts are counted from the least part, so a context that is cut short has the same parts where it has them whole."""
    long = S._parts(np.array([3]), np.array([50]), np.array([30]), 8)
    short = S._parts(np.array([3 + 11]), np.array([30]), np.array([30]), 8)
    assert sum(long[2]) == 50 and sum(short[2]) == 30 and long[1][0] == 3 and short[1][0] == 14
    assert set(short[3]) <= set(long[3]) and all((lo - 30) % 8 == 0 for lo in long[3])


def test_odd_rows(odd, none):
    got = S.suffix_dedup(odd)
    assert got.count() == odd.count() and S.suffix_dedup(none).count() == 0
    for r in got.collect():
        if r.doc_id is None:
            assert r.n_removed == 0 and r.kept is None
    long = next(r for r in got.collect() if r.doc_id == 7)
    assert long.n_bytes == 40_000 and long.n_removed == 40_000 - 2 and long.n_spans == 1


def test_rows_of_one_id_keep_apart(spark):
    a, b = "first text of its kind, long enough", "second text, long enough as well, yes"
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, a + b), (None, a)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in S.suffix_dedup(docs, 20, 8).collect())
    assert got == [(0, 35, 0), (1, 35, 0), (1, 35, 0), (1, 37, 0), (2, 72, 72)]


def test_query_is_its_sql(spark, sf):
    got = queries.op12_suffix_dedup(spark, sf)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.OP12_SQL})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)
    assert sum(r.n_removed for r in got.collect()) > 10_000
