"""python -m lexigrid crawl|chunk|index|search ..."""

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession

from lexigrid.operators import models, vectors
from lexigrid.operators.lexical import bm25_topk
from lexigrid.plans import flows
from lexigrid.sources import files
from lexigrid.sources.http import DELAY, http_fetcher, http_file_fetcher


def loader(name: str, device: str):
    """load() for a model that module:function makes; the function is given the device."""
    module, _, function = name.partition(":")
    return lambda: getattr(importlib.import_module(module), function)(models.pick_device(device))


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lexigrid", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="crawl a site into texts and a manifest")
    c.add_argument("start")
    c.add_argument("out")
    c.add_argument("--max-pages", type=int, default=200)
    c.add_argument("--max-files", type=int, default=80)
    c.add_argument("--delay", type=float, default=DELAY)
    k = sub.add_parser("chunk", help="chunk the texts that a manifest names")
    k.add_argument("manifest")
    k.add_argument("texts")
    k.add_argument("out")
    i = sub.add_parser("index", help="chunk the texts that a manifest names, and index the chunks")
    i.add_argument("manifest")
    i.add_argument("texts")
    i.add_argument("out")
    s = sub.add_parser("search", help="hybrid search in an index, or lexical search in chunks")
    s.add_argument("where", help="what index or chunk wrote")
    s.add_argument("question")
    s.add_argument("--top-k", type=int, default=5)
    s.add_argument("--reranker", help="module:function that gives a model of questions and texts")
    for p in (i, s):
        p.add_argument("--encoder", required=p is i, help="module:function that gives a model from texts to vectors")
        p.add_argument("--device", default="auto")
        p.add_argument("--batch-size", type=int, default=8)
    return parser


def found(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """rank, score, source, article_id, text of the hits of one question."""
    asked = spark.createDataFrame([(0, args.question)], "qid long, text string")
    if args.encoder:
        encode = vectors.encoder(loader(args.encoder, args.device), args.batch_size)
        scorer = models.reranker(loader(args.reranker, args.device)) if args.reranker else None
        hits = flows.search(spark, f"{args.where}/index", asked, encode, top_k=args.top_k, scorer=scorer)
    else:
        chunks = files.read_chunks(spark, args.where)
        hits = chunks.join(bm25_topk(chunks, asked, args.top_k, id_col="row_idx"), "row_idx")
    return hits.select("rank", "score", "source", "article_id", "text").orderBy("rank")


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "crawl":
        counts = flows.crawl(spark, args.start, http_fetcher(args.delay), args.out, args.max_pages, args.max_files, http_file_fetcher(args.delay))
        print(counts.toJSON().first())
    elif args.command == "chunk":
        flows.write_chunks(flows.chunk_manifest(spark, args.manifest, args.texts), args.out)
        print(files.read_chunks(spark, args.out).selectExpr("count(*) AS n_chunks", "count(DISTINCT source) AS n_sources").toJSON().first())
    elif args.command == "index":
        encode = vectors.encoder(loader(args.encoder, args.device), args.batch_size)
        print(flows.build(spark, args.manifest, args.texts, encode, args.encoder, args.out).toJSON().first())
    else:
        for row in found(spark, args).collect():
            print(f"{row['rank']}. {row['score']:.4f} {row['source']} {row['article_id']}\n{row['text'][:300]}\n")


def main() -> None:
    args = arguments().parse_args()
    run(SparkSession.builder.appName(f"lexigrid-{args.command}").getOrCreate(), args)


if __name__ == "__main__":
    main()
