import logging
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import chunk_stream, queries, retrieval_report

SF = "/root/testdata/sf0.001"
SETTINGS = {"separator": "\n", "max_chars": 40, "files_per_batch": 2}


def land(spark, folder, name, rows):
    """One file of documents, as another job would put it there."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    frame.write.parquet(str(folder / f"new-{name}"))
    file = next((folder / f"new-{name}").glob("part-*"))
    (folder / "in").mkdir(exist_ok=True)
    file.rename(folder / "in" / f"{name}.parquet")


def stored(spark, folder):
    return sorted((r.doc_id, r.piece_pos, r.text, r.lang) for r in chunk_stream.current(spark, str(folder / "out")).collect())


def take(spark, folder):
    return chunk_stream.run(spark, str(folder / "in"), str(folder / "out"), str(folder / "state"), SETTINGS)


def files_of(folder):
    return {p: p.stat().st_mtime_ns for p in (folder / "out").rglob("part-*")}


def test_two_runs_over_growing_input(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    land(spark, tmp_path, "a", [(1, "one\ntwo", "en", "s"), (2, "x" * 30 + "\n" + "y" * 30, "fr", "s"), (2, "x" * 30 + "\n" + "y" * 30, "fr", "s"), (None, "lost", "en", "s")])
    assert take(spark, tmp_path) == 1
    first = [(1, 1, "PB-1.\none\n\ntwo", "en"), (2, 1, "PB-1.\n" + "x" * 30, "fr"), (2, 2, "PB-2.\n" + "y" * 30, "fr")]
    assert stored(spark, tmp_path) == first
    assert "read 4 rows, 1 of them without doc_id; wrote 2 documents and 3 chunks" in caplog.text
    before = files_of(tmp_path)
    assert take(spark, tmp_path) == 0 and files_of(tmp_path) == before  # nothing new: nothing is written
    land(spark, tmp_path, "b", [(3, "three", None, "s"), (1, "one again", "en", "s")])
    land(spark, tmp_path, "c", [(4, None, "en", "s"), (5, "", "en", "s")])
    assert take(spark, tmp_path) == 1
    assert stored(spark, tmp_path) == sorted([(1, 1, "PB-1.\none again", "en"), *first[1:], (3, 1, "PB-1.\nthree", None)], key=lambda r: r[:3])
    assert {p: t for p, t in files_of(tmp_path).items() if p in before} == before  # what was there is not rewritten


def test_document_that_loses_its_text_loses_its_chunks(spark, tmp_path):
    land(spark, tmp_path, "a", [(1, "one", "en", "s"), (2, "two", "en", "s")])
    take(spark, tmp_path)
    land(spark, tmp_path, "b", [(1, None, "en", "s")])
    take(spark, tmp_path)
    assert [r[0] for r in stored(spark, tmp_path)] == [2]


def test_versions_within_a_batch(spark, tmp_path):
    land(spark, tmp_path, "a", [(1, f"text {k}", "en", "s") for k in range(5)])
    take(spark, tmp_path)
    assert len(stored(spark, tmp_path)) == 1


def test_batch_that_failed_half_way_is_overwritten(spark, tmp_path, monkeypatch):
    land(spark, tmp_path, "a", [(1, "one", "en", "s"), (2, "two", "fr", "s")])
    whole = chunk_stream.chunks_of
    monkeypatch.setattr(chunk_stream, "chunks_of", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="division"):
        take(spark, tmp_path)
    monkeypatch.setattr(chunk_stream, "chunks_of", whole)
    assert take(spark, tmp_path) == 1
    assert [r[0] for r in stored(spark, tmp_path)] == [1, 2]
    frame = spark.read.parquet(str(tmp_path / "in"))
    chunk_stream.write_batch(frame, 0, str(tmp_path / "out"), chunk_stream.Structure(separator="\n", max_chars=40))
    assert [r[0] for r in stored(spark, tmp_path)] == [1, 2]


def test_report(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    docs = [(1, "the cat sat on the mat", "en"), (2, "a cat and a mat", "en"), (3, "le chat", "fr"), (4, None, "fr"), (5, "concatenate the cat", None), (6, "zz", "en"), (6, "the cat sat", "en"), (None, "cat sat", "en")]
    asked = [(0, "Cat sat!"), (1, "chat"), (2, "nothing here"), (3, " "), (4, None), (5, "cat"), (5, "the cat"), (None, "cat")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    out = str(tmp_path / "out")
    for _ in range(2):
        retrieval_report.run(spark, str(tmp_path / "docs"), str(tmp_path / "asked"), out, {"k": 2, "k1": 1.5, "b": 0.75, "epsilon": 0.25})
        items = {r.item_id: (r.n_hits, r.n_holders, r.n_found, r.first_rank) for r in retrieval_report.read_items(spark, out).collect()}
        assert {k: v[:2] for k, v in items.items()} == {0: (1, 1), 1: (1, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (2, 2)} and items[1] == (1, 1, 1, 1)
        hits = {(r.item_id, r.doc_id): (r.lang, r.holds) for r in retrieval_report.read_hits(spark, out).collect()}
        assert hits[0, 1] == ("en", True) and hits[1, 3] == ("fr", True) and not any(d is None for _, d in hits)
        assert spark.read.parquet(f"{out}/index/stats").count() == 1
    assert "read 6 documents" in caplog.text and "read 6 questions" in caplog.text


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    show = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    want = show(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall())
    assert show(map(tuple, got.select(columns).collect())) == want and len(want) > 100


@pytest.mark.parametrize("name", ["chunk_stream", "retrieval_report"])
def test_command_line(name):
    said = subprocess.run([sys.executable, "-m", f"jobs.{name}", "--help"], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[1])
    assert "--config" in said.stdout
