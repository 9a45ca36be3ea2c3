"""Indexes documents and reports how well lexical search answers a set of questions: python -m jobs.retrieval_report DOCUMENTS QUESTIONS OUT [--config FILE]

DOCUMENTS (doc_id, text, lang) and QUESTIONS (item_id, text) are Parquet tables. A question is a passage, and a document that holds its
words one after another answers it. The job writes

    OUT/index          the stored inverted index, of one segment
    OUT/hits/lang=<l>  item_id, rank, doc_id, score, holds: the best documents of each question
    OUT/items          item_id, n_hits, n_holders (documents that hold it), n_found (of these among the hits), first_rank

A run replaces what an earlier one left, so it may be run again at any time with the same result. Rows whose doc_id or item_id is null take no part;
of rows that share an id, the one with the greatest text counts. A question without a word has no hits and no holders, but a row of items.
"""

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators.lexical import BM25
from lexigrid.operators.postings import holders, search, write_postings

log = logging.getLogger("jobs.retrieval_report")
CONFIG = Path(__file__).with_suffix(".json")
HITS = "item_id long, rank int, doc_id long, score double, holds boolean, lang string"
ITEMS = "item_id long, n_hits long, n_holders long, n_found long, first_rank int"


def config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def by_id(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with an id; of several with one id the one with the greatest text. Only ids that repeat are moved."""
    rows = table.select(F.col(key).cast("long").alias(key), *columns).filter(F.col(key).isNotNull())
    several = rows.groupBy(key).count().filter("count > 1").select(key)
    if several.isEmpty():
        return rows
    best = rows.join(several, key, "left_semi").groupBy(key).agg(F.max(F.struct(*columns)).alias("x")).select(key, "x.*")
    return rows.join(several, key, "left_anti").unionByName(best)


def run(spark: SparkSession, documents: str, questions: str, out: str, settings: dict) -> None:
    docs = by_id(spark.read.parquet(documents), "doc_id", ["text", "lang"])
    asked = by_id(spark.read.parquet(questions), "item_id", ["text"]).withColumnRenamed("item_id", "qid")
    params = BM25(settings["k1"], settings["b"], settings["epsilon"])
    index = write_postings(docs, f"{out}/index")
    log.info("read %d documents with %d words from %s; wrote %s/index", index.n_docs, index.n_tokens, documents, out)
    holding = holders(index, docs, asked).select("qid", F.col("row_idx").alias("doc_id"))
    holding.write.mode("overwrite").parquet(f"{out}/holders")
    holding = spark.read.schema("qid long, doc_id long").parquet(f"{out}/holders")
    best = search(index, asked, settings["k"], params).withColumnRenamed("row_idx", "doc_id")
    hits = best.join(holding.withColumn("holds", F.lit(True)), ["qid", "doc_id"], "left").join(docs.select("doc_id", "lang"), "doc_id")
    hits = hits.select(F.col("qid").alias("item_id"), "rank", "doc_id", "score", F.coalesce("holds", F.lit(False)).alias("holds"), "lang")
    hits.repartition("lang").sortWithinPartitions("item_id", "rank").write.mode("overwrite").partitionBy("lang").parquet(f"{out}/hits")
    found = read_hits(spark, out)
    shown = found.groupBy("item_id").agg(F.count("*").alias("n_hits"), F.count_if("holds").alias("n_found"), F.min(F.when(F.col("holds"), F.col("rank"))).alias("first_rank"))
    held = holding.groupBy(F.col("qid").alias("item_id")).agg(F.count("*").alias("n_holders"))
    items = asked.select(F.col("qid").alias("item_id")).join(shown, "item_id", "left").join(held, "item_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    items.select("item_id", none("n_hits"), none("n_holders"), none("n_found"), "first_rank").write.mode("overwrite").parquet(f"{out}/items")
    said = read_items(spark, out).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("n_hits"), F.lit(0)).alias("hits"), F.count_if(F.col("n_holders") > 0).alias("held"),
        F.coalesce(F.avg(F.when(F.col("n_holders") > 0, F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))), F.lit(0.0)).alias("mrr"),
    ).first()
    log.info("read %d questions from %s; wrote %d hits; %d questions have an answer, mean reciprocal rank of the first one %.4f", said["n"], questions, said["hits"], said["held"], said["mrr"])


def read_hits(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(HITS).parquet(f"{out}/hits")


def read_items(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ITEMS).parquet(f"{out}/items")


def main() -> None:
    parser = argparse.ArgumentParser(prog="jobs.retrieval_report", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "questions", "out"):
        parser.add_argument(name)
    parser.add_argument("--config", default=CONFIG)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("retrieval-report").getOrCreate()
    try:
        run(spark, args.documents, args.questions, args.out, config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
