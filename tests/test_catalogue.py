import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lexigrid.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_is_its_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    relation = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.SQL[name]})")
    want = sorted((plain(r) for r in relation.fetchall()), key=repr)
    assert sorted((plain(tuple(r)) for r in got.select(columns).collect()), key=repr) == want and want


def test_searches_without_sql(spark, con):
    """Approximate and fitted searches: recall against the exact rows, and passages that documents hold are found."""
    exact = {(r[0], r[1]) for r in con.execute(f"SELECT qid, row_idx FROM ({catalogue.SQL['dense_batch_topk']})").fetchall()}
    found = {(r.qid, r.row_idx) for r in catalogue.ann_batch_topk(spark, SF).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    held = con.execute("SELECT item_id, doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text) AND length(b.text) > 40").fetchall()
    semantic = {(r.qid, r.row_idx) for r in catalogue.semantic_batch_topk(spark, SF).collect()}
    hybrid = {(r.qid, r.row_idx) for r in catalogue.semantic_hybrid_search(spark, SF).collect()}
    assert held and sum(x in semantic for x in held) >= 0.5 * len(held) and sum(x in hybrid for x in held) >= 0.5 * len(held)
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"ann_batch_topk", "semantic_batch_topk", "semantic_hybrid_search"}


def test_nothing_imports_llm():
    top = Path(__file__).parents[1]
    names = [".".join(p.relative_to(top).with_suffix("").parts) for p in (top / "lexigrid").rglob("*.py") if "llm" not in p.parts and not p.name.startswith("__")]
    code = f"import sys, importlib\nfor m in {names!r}: importlib.import_module(m)\nassert not [m for m in sys.modules if m.startswith('lexigrid.llm')]"
    assert len(names) > 12
    subprocess.run([sys.executable, "-c", code], check=True, cwd=top)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0 and {"qid", "rank", "row_idx"} <= set(rows.columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pages_that_share_a_url_are_one_page(spark, tmp_path):
    """A later version of a page with new links is read in the run of its first version, as the SQL says."""
    link = lambda name: f'<a href="/{name}">x</a>'
    rows = [(1, "http://h/a", link("old") + link("both")), (2, "http://h/a", link("both")), (4, "http://h/b", link("c")), (3, "http://h/d", link("c") + link("late"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = c.execute(f"SELECT url, run, ok, n_bytes FROM ({catalogue.SQL['fetch_ledger']})").fetchall()
    got = [tuple(r) for r in catalogue.fetch_ledger(spark, str(tmp_path)).select("url", "run", "ok", "n_bytes").collect()]
    assert sorted(got) == sorted(want) and {(u[-3:], run) for u, run, _, _ in got} >= {("old", 0), ("ate", 1)}


def test_small_numbers_keep_their_sign(spark, tmp_path):
    """What is rounded to zero from below is -0.0, as the SQL says."""
    rows = [(0, [-1e-7, 1e-7, 1.0]), (1, [0.0, -0.25, 0.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(c.execute(f"SELECT vec_id, unit FROM ({catalogue.SQL['l2_normalize']})").fetchall())
    got = sorted((r.vec_id, r.unit) for r in catalogue.l2_normalize(spark, str(tmp_path)).collect())
    assert repr(got) == repr(want) and repr(got[0][1][0]) == "-0.0"
