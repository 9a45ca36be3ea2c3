import pytest
from pyspark.sql import functions as F

from lexigrid.operators import hybrid, vectors
from lexigrid.plans import flows
from lexigrid.sources import files

CHUNK = "row_idx long, chunk_id string, article_id string, chapter string, source string, source_url string, text string"
ENCODE = vectors.encoder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])


def chunks(spark, n, word):
    return spark.createDataFrame([(i, f"c{i}", "a", "ch", "s", "u", f"{word} {'x ' * i}") for i in range(n)], CHUNK)


def test_failed_write_leaves_the_old_index(spark, tmp_path):
    path = str(tmp_path / "index")
    flows.ingest(chunks(spark, 3, "old"), ENCODE, "stub", path)
    broken = chunks(spark, 5, "new").withColumn("text", F.when(F.col("row_idx") == 4, F.raise_error(F.lit("no text"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no text"):
        flows.ingest(broken, ENCODE, "stub", path)
    asked = spark.createDataFrame([(0, "old")], "qid long, text string")
    assert files.open_index(spark, path).count() == 3 and {r.row_idx for r in flows.search(spark, path, asked, ENCODE).collect()} == {0, 1, 2}
    flows.ingest(chunks(spark, 5, "new"), ENCODE, "stub", path)
    assert files.open_index(spark, path).count() == 5 and files.latest_version(spark, path) == 1


def test_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "index")
    flows.ingest(chunks(spark, 3, "old"), ENCODE, "stub", path)
    opened = files.open_index(spark, path)
    flows.ingest(chunks(spark, 5, "new"), ENCODE, "stub", path)
    assert {r.document.split()[0] for r in opened.collect()} == {"old"} and {r.document.split()[0] for r in files.open_index(spark, path).collect()} == {"new"}
    flows.ingest(chunks(spark, 6, "newer"), ENCODE, "stub", path)
    assert sorted(p.name for p in (tmp_path / "index" / "vectors").iterdir()) == ["version=1", "version=2"]


def test_missing_index(spark, tmp_path):
    with pytest.raises(RuntimeError):
        files.open_index(spark, str(tmp_path / "none"))


def test_hydrate_moves_no_chunks(spark, tmp_path):
    """With chunks that are stored by row_idx, only the pool is exchanged; the rows are those of a plain join."""
    rows = spark.range(500).select(F.col("id").alias("row_idx"), F.concat(F.lit("text "), "id").alias("text"))
    pool = spark.range(0, 900, 3).select(F.col("id").alias("row_idx"), F.lit(0).alias("qid"))
    stored = files.write_clustered(rows, str(tmp_path / "chunks"), "row_idx", 8)
    again = files.open_clustered(spark, str(tmp_path / "chunks"), "row_idx bigint, text string", "row_idx", 8)
    want = sorted(map(tuple, hybrid.hydrate(pool, rows).collect()))
    for table in (stored, again):
        got = hybrid.hydrate(pool.hint("merge"), table)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange") == 1, plan
        assert sorted(map(tuple, got.collect())) == want and len(want) == 167


def test_files_are_read_a_few_at_a_time():
    """What a worker gives back at once is bounded, however many files are in the batch that it was sent."""
    import pandas as pd

    from lexigrid.plans import catalogue

    batch = pd.DataFrame({"doc_id": range(1000), "text": ["a\nb"] * 1000})
    parts = list(catalogue._as_docx(iter([batch])))
    assert max(map(len, parts)) <= 64 and sum(map(len, parts)) == 1000


def test_encoders_read_small_batches(spark):
    """A worker that encodes texts gets no more of them at once than small_batches allows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    sizes = vectors.encoder(lambda: lambda texts: [[float(len(texts))] for _ in texts], batch_size=10_000)
    seen = spark.range(2000).coalesce(1).select(sizes(F.col("id").cast("string")).alias("v")).agg(F.max(F.col("v")[0])).first()[0]
    assert seen <= files.BATCH_ROWS == int(spark.conf.get(key))
