"""Lexical retrieval: term statistics, BM25 scores and their top k, for many queries at once."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.text import let, tokenize
from lexigrid.sources.files import scratch

#: Decimals by which scores are compared, so that equal texts tie however their sums were ordered.
TIE_DECIMALS = 9
#: Rows of query terms that are broadcast at most; beyond, the joins shuffle.
BROADCAST_TERMS = 200_000


@dataclass(frozen=True)
class BM25:
    """Okapi BM25; a negative idf becomes epsilon times the mean idf of the vocabulary."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def with_tokens(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """row_idx, tokens, dl. Documents without tokens stay: they count for N and the mean length."""
    return docs.select(F.col(id_col).alias("row_idx"), tokenize(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))


def runs(tokens: Column) -> Column:
    """array of (term, tf), by the lengths of the runs in the sorted tokens: a document's terms are counted in its row, without a shuffle."""
    first = lambda t, i: (i == 0) | (F.get(t, i) != F.get(t, i - 1))
    starts = lambda t: F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: first(t, i))
    run = lambda t, s: F.transform(s, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t)) - i).alias("tf")))
    found = let(F.sort_array(tokens), lambda t: let(starts(t), lambda s: run(t, s)))
    return F.when(F.size(tokens) > 0, found).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def term_index(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """row_idx, dl, terms (term, tf) of every document: one pass over the texts, written once, as statistics and postings are read from it."""
    return _written(with_tokens(docs, id_col).select("row_idx", "dl", runs(F.col("tokens")).alias("terms")), "terms")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def idf_table(index: DataFrame, params: BM25 = BM25()) -> DataFrame:
    """term, df, idf, n_docs, avgdl. The statistics are one row each, so joining them is no cross join of tables."""
    stats = index.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    counts = _written(index.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "df")
    raw = counts.join(F.broadcast(stats), F.lit(True))
    raw = raw.withColumn("raw_idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw_idf").alias("mean_idf"))
    idf = F.when(F.col("raw_idf") < 0, params.epsilon * F.col("mean_idf")).otherwise(F.col("raw_idf"))
    return raw.join(F.broadcast(mean), F.lit(True)).select("term", "df", idf.alias("idf"), "n_docs", "avgdl")


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, qtf of queries (qid, text); a term counts as often as the query has it."""
    return queries.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, params: BM25 = BM25(), id_col: str = "doc_id", index: DataFrame | None = None) -> DataFrame:
    """qid, row_idx, score of all pairs that share a term; index: term_index() of docs, if there is one.

    Postings of the queries' terms are dealt out by document once. Terms of the queries with their weights are a small table, so
    a document meets them, and its scores are summed up, where it is: nothing of the size of documents x queries is shuffled."""
    index = term_index(docs, id_col) if index is None else index
    asked = query_terms(queries)
    terms = asked.select("term").distinct()
    small = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    sent = F.broadcast if small else lambda df: df
    weights = idf_table(index, params).join(sent(asked), "term").select("term", "qid", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl")
    postings = index.select("row_idx", "dl", F.inline("terms")).join(sent(terms), "term", "left_semi").repartition("row_idx")
    long = F.lit(1 - params.b) + params.b * F.col("dl") / F.col("avgdl")
    gain = F.col("weight") * F.col("tf") * (params.k1 + 1) / (F.col("tf") + params.k1 * long)
    return postings.join(sent(weights), "term").groupBy("qid", "row_idx").agg(F.sum(gain).alias("score"))


def top_k(scored: DataFrame, k: int | Column, rank: str = "rank", score: str = "score") -> DataFrame:
    """The k best of each qid with their ranks; ties go to the smaller row_idx. Spark keeps k rows a qid before the shuffle."""
    by = Window.partitionBy("qid").orderBy(F.round(score, TIE_DECIMALS).desc(), "row_idx")
    return scored.withColumn(rank, F.row_number().over(by)).filter(F.col(rank) <= k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 20, params: BM25 = BM25(), id_col: str = "doc_id", index: DataFrame | None = None) -> DataFrame:
    """qid, row_idx, score, rank: the k best, of which those without a positive score go afterwards."""
    return top_k(bm25_scores(docs, queries, params, id_col, index), k).filter("score > 0")
