"""The driver's tables as the relations that the operators take."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators import postings
from lexigrid.sources.files import scratch, spread


#: Tables whose rows take work enough to deal them over all cores where they are one file.
LARGE = ("documents", "pages", "embeddings", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in LARGE else found


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: row_idx is doc_id, the language stands for the chapter."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("row_idx"), "text", "source", F.concat(F.lit("PB-"), F.col("doc_id").cast("string")).alias("article_id"),
        F.col("lang").alias("chapter"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source_url"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of existing documents: row_idx = vec_id = doc_id."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_idx"), "embedding")
    return e.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx")), "row_idx", "left_semi")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as queries, each with the vector of the same number."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return b.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), "qid", "left")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as what the chunker takes."""
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return d.select(F.col("doc_id").alias("doc_ord"), F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string")).alias("source"), none.alias("source_url"), F.lit("").alias("title"), F.lit("html").alias("source_kind"), "text")


#: Where this session keeps the postings of a table, by the table's files.
_STORED: dict[tuple, str] = {}


def lexical_index(spark: SparkSession, sf_dir: str) -> postings.Postings:
    """The stored postings of documents: written once in a session, opened by every later query, and written anew if the table's files have changed."""
    found = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = found.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*"), F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, sf_dir, *state)
    if key not in _STORED:
        path = scratch(spark, "postings")
        postings.write_postings(table(spark, sf_dir, "documents"), path)
        _STORED[key] = path
    return postings.open_postings(spark, _STORED[key])
