"""Hybrid search: lexical and dense ranks fused by reciprocal rank, cut to a pool, joined with chunks and re-ranked."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.operators import postings
from lexigrid.operators.lexical import TIE_DECIMALS
from lexigrid.operators.vectors import dense_topk

RRF_K = 60
#: Characters of a text that a re-ranker sees.
RERANK_CHARS = 1500
#: Rows of a pool that are broadcast, so that the chunks' texts are not shuffled.
POOL_ROWS = 100_000


def _fused_order() -> list:
    return [F.round("rrf_score", TIE_DECIMALS + 3).desc(), F.col("bm25_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last(), F.col("row_idx")]


def rrf_fuse(bm25: DataFrame, dense: DataFrame, rrf_k: int = RRF_K, bm25_weight: float = 1.0, dense_weight: float = 1.0) -> DataFrame:
    """qid, row_idx, rrf_score, ranks (null where a branch lacks the row) and scores (0.0 there), rrf_rank.

    A weight of 0 takes a branch's say, not its candidates."""
    left = bm25.select("qid", "row_idx", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    right = dense.select("qid", "row_idx", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    both = left.join(right, ["qid", "row_idx"], "full_outer").select(
        "qid",
        "row_idx",
        (part(bm25_weight, "bm25_rank") + part(dense_weight, "dense_rank")).alias("rrf_score"),
        "bm25_rank",
        "dense_rank",
        F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"),
        F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"),
    )
    return both.withColumn("rrf_rank", F.row_number().over(Window.partitionBy("qid").orderBy(*_fused_order())))


def pool_cut(fused: DataFrame, top_k: int, rerank_pool: int) -> DataFrame:
    """The first max(top_k, rerank_pool) of each query."""
    return fused.filter(F.col("rrf_rank") <= max(top_k, rerank_pool))


def hydrate(pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """The pool with its chunks' columns, joined on row_idx. A pool that is small enough is broadcast; a larger one is moved to the chunks, if these are
    stored by files.write_clustered, and not they to it."""
    return chunks.join(pool, "row_idx")


def rerank(hits: DataFrame, queries: DataFrame, top_k: int, scorer: Callable | None = None, on: bool = True) -> DataFrame:
    """The top_k hits of each query with rerank_score (null without a scorer), reranked, score, rank.

    scorer(query text column, text column) is a column function, such as pandas_udf; without one the fused order holds,
    and reranked says that re-ranking was asked for, as rerank_score says whether it took place."""
    asked = hits.join(queries.select("qid", F.col("text").alias("__query")), "qid")
    shown = F.substring("text", 1, RERANK_CHARS)
    value = scorer(F.col("__query"), shown).cast("double") if on and scorer else F.lit(None).cast("double")
    scored = asked.withColumn("rerank_score", value).drop("__query")
    order = [F.col("rerank_score").desc_nulls_last(), *_fused_order()]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("rank") <= top_k)
    return ranked.withColumns({"reranked": F.lit(on), "score": F.coalesce("rerank_score", "rrf_score")})


def hybrid_search(
    chunks: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    top_k: int = 5,
    k_per_retriever: int = 20,
    rerank_pool: int = 20,
    bm25_weight: float = 1.0,
    dense_weight: float = 1.0,
    rrf_k: int = RRF_K,
    scorer: Callable | None = None,
    use_reranker: bool = True,
    index: postings.Postings | None = None,
) -> DataFrame:
    """Hits of queries (qid, text, qvec) among chunks (row_idx, text, ...) with vectors (row_idx, embedding). Blank queries have none.

    index: the stored postings of the chunks; without it the chunks' texts are read and counted for this search."""
    asked = queries.filter(F.col("text").rlike(r"(?U)\S"))
    lexical = postings.scan(chunks, asked, k_per_retriever, id_col="row_idx") if index is None else postings.search(index, asked, k_per_retriever)
    dense = dense_topk(vectors, asked.filter("qvec is not null"), k_per_retriever)
    pool = pool_cut(rrf_fuse(lexical, dense, rrf_k, bm25_weight, dense_weight), top_k, rerank_pool)
    if asked.limit(POOL_ROWS + 1).count() * max(top_k, rerank_pool) <= POOL_ROWS:
        pool = F.broadcast(pool)
    return rerank(hydrate(pool, chunks), asked, top_k, scorer, use_reranker)
