"""Keeps a store of chunks up to date as documents land: python -m jobs.chunk_stream SOURCE OUT [--checkpoint DIR] [--config FILE]

SOURCE, a folder or a pattern of paths, holds Parquet files of documents (doc_id, text, lang, source); each run takes the files that no earlier run took, by the
checkpoint of a file stream, and ends. A batch is chunked without a shuffle and written to its own partition:

    OUT/chunks/batch=<n>/lang=<l>   the chunks of each version of a document
    OUT/ledger/batch=<n>            doc_id, version (a hash of the document's columns), n_rows

A batch that is run again after a failure overwrites its own partitions only, with the same rows. A document that comes again, with another
text or none, replaces what it was: of the ledger's entries for a doc_id the latest batch counts and, of several versions
within one batch, the one with the largest hash. current() reads the store so. Rows without doc_id have no place in it; they are counted in the log and left out.
A document without text has no chunks but an entry. Repeated rows count once. A language that is null or empty goes to Hive's default partition.
"""

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators.chunking import Structure, chunk_documents

log = logging.getLogger("jobs.chunk_stream")

DOCUMENT = "doc_id long, text string, lang string, source string"
CONFIG = Path(__file__).with_suffix(".json")
KEY = ["doc_id", "version"]
CHUNKS = "doc_id long, version long, chapter_pos int, piece_pos int, chunk_id string, article_id string, chapter string, source string, text string, batch int, lang string"
LEDGER = "doc_id long, version long, n_rows long, batch int"


def config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def chunks_of(documents: DataFrame, structure: Structure) -> DataFrame:
    """doc_id, version, chapter_pos, piece_pos, chunk_id, article_id, chapter, source, text, lang of documents (with version)."""
    name = F.concat_ws("_", "source", F.col("doc_id").cast("string"))
    taken = documents.select(
        F.col("doc_id").alias("doc_ord"), name.alias("source"), F.lit(None).cast("string").alias("source_url"), F.lit("").alias("title"),
        F.lit("text").alias("source_kind"), F.coalesce("text", F.lit("")).alias("text"), "version", "lang",
    )
    cut = chunk_documents(taken, structure, keep=["version", "lang"])
    return cut.select(F.col("doc_ord").alias("doc_id"), "version", "chapter_pos", "piece_pos", "chunk_id", "article_id", "chapter", "source", "text", "lang")


def versions(documents: DataFrame) -> DataFrame:
    """Documents with the hash that tells their versions apart."""
    return documents.withColumn("version", F.xxhash64("text", "lang", "source"))


def written(spark: SparkSession, out: str, table: str, batch: int | None = None) -> DataFrame:
    """A table of the store, or one batch of it."""
    rows = spark.read.schema(LEDGER if table == "ledger" else CHUNKS).parquet(f"{out}/{table}")
    return rows if batch is None else rows.filter(F.col("batch") == batch)


def write_batch(documents: DataFrame, batch: int, out: str, structure: Structure) -> None:
    """One batch's ledger and chunks; the same batch again gives the same rows. Texts are read twice and moved only where a row is repeated."""
    spark = documents.sparkSession
    rows, here = versions(documents), F.lit(batch).alias("batch")
    overwrite = lambda df, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    overwrite(rows.groupBy(*KEY).agg(F.count("*").alias("n_rows")).select("*", here), "batch").parquet(f"{out}/ledger")
    ledger = written(spark, out, "ledger", batch)
    sound = rows.filter("doc_id is not null")
    twice = ledger.filter("n_rows > 1 and doc_id is not null").select(*KEY)
    if not twice.isEmpty():
        sound = sound.join(twice, KEY, "left_anti").unionByName(sound.join(twice, KEY, "left_semi").dropDuplicates(KEY))
    overwrite(chunks_of(sound, structure).select("*", here), "batch", "lang").parquet(f"{out}/chunks")
    none = F.col("doc_id").isNull()
    said = ledger.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(none, F.col("n_rows"))), F.lit(0)).alias("none"), F.count_if(~none).alias("kept")).first()
    n_chunks = written(spark, out, "chunks", batch).count()
    log.info("batch %d: read %d rows, %d of them without doc_id; wrote %d documents and %d chunks to %s", batch, said["n"], said["none"], said["kept"], n_chunks, out)


def run(spark: SparkSession, source: str, out: str, checkpoint: str, settings: dict) -> int:
    """Takes what is new in source; gives the number of batches that it took."""
    structure = Structure(separator=settings["separator"], max_chars=settings["max_chars"])
    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(source)
    taken = []

    def take(documents: DataFrame, batch: int) -> None:
        write_batch(documents, batch, out, structure)
        taken.append(batch)

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("took %d new batches %s from %s", len(taken), taken, source)
    return len(taken)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of the latest version of each document."""
    ledger = written(spark, out, "ledger").filter("doc_id is not null")
    latest = ledger.groupBy("doc_id").agg(F.max(F.struct("batch", "version")).alias("x")).select("doc_id", "x.version", "x.batch")
    return written(spark, out, "chunks").join(latest, [*KEY, "batch"], "left_semi")


def main() -> None:
    parser = argparse.ArgumentParser(prog="jobs.chunk_stream", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("source")
    parser.add_argument("out")
    parser.add_argument("--checkpoint", help="a folder of the stream's own; OUT/checkpoint by default")
    parser.add_argument("--config", default=CONFIG)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("chunk-stream").getOrCreate()
    try:
        run(spark, args.source, args.out, args.checkpoint or f"{args.out}/checkpoint", config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
