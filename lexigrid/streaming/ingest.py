"""Chunks from a stream of documents: stateless, so any trigger and any restart gives the same chunks."""

from pyspark.sql import DataFrame, SparkSession

from lexigrid.operators.chunking import DEFAULT, Structure, chunk_documents

DOCUMENT = "doc_ord long, source string, source_url string, title string, source_kind string, text string"


def read_documents(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Documents in JSON lines that land in a folder."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def stream_chunks(documents: DataFrame, structure: Structure = DEFAULT) -> DataFrame:
    """Chunks without row_idx, which only a finished corpus has; (doc_ord, chapter_pos, piece_pos) is their key."""
    return chunk_documents(documents, structure)


def write_chunks(chunks: DataFrame, path: str, checkpoint: str):
    """Appends chunks to Parquet, exactly once."""
    return chunks.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)
