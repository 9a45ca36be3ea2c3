"""The jobs as queries: each runs its job twice into a new folder of the shared one and reads the whole output."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import chunk_stream, retrieval_report
from lexigrid.plans import sql as S
from lexigrid.sources.files import scratch


def job1_chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "job1")
    source = f"{sf_dir}/documents.parque[t]"  # a pattern, as the table may be one file, which is no base path for a stream
    for _ in range(2):  # the second run finds nothing new
        chunk_stream.run(spark, source, out, f"{out}/checkpoint", chunk_stream.config())
    return chunk_stream.current(spark, out).select("doc_id", "chapter_pos", "piece_pos", "chunk_id", "article_id", "chapter", "source", "lang", "text")


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "job2")
    for _ in range(2):  # the second run replaces what the first one wrote
        retrieval_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out, retrieval_report.config())
    hits = retrieval_report.read_hits(spark, out).withColumn("score", F.round("score", 6))
    return retrieval_report.read_items(spark, out).join(hits, "item_id", "left")


QUERIES = {f.__name__: f for f in (job1_chunk_stream, job2_retrieval_report)}
SQL = {"job1_chunk_stream": S.stored_chunks(), "job2_retrieval_report": S.retrieval_report(retrieval_report.config()["k"])}
