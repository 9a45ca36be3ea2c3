"""Dense vectors: normalising, exact nearest neighbours, encoding by a callable, and the index as a table."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lexigrid.operators.lexical import TIE_DECIMALS, top_k
from lexigrid.sources.files import small_batches

#: Queries that are sent out at once, vectors to a shard where there are more queries, and scores that a task computes at once.
QUERY_ROWS, SHARD_ROWS, CELLS = 4096, 16_384, 4_000_000


def l2_normalize(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform(F.array(norm), lambda n: F.transform(vector, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))
    return F.get(unit, F.lit(0))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm == 0, 1.0, norm)[:, None]


def _best(q: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each q: by the score that is compared, then by the smaller row."""
    order = np.lexsort((row, -np.round(score, TIE_DECIMALS), q))
    starts = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1])) if len(order) else order
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]


class Best:
    """The k best rows of each of n queries among the scores that it has seen."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.q, self.row, self.score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        self.least = np.full(n, -np.inf)  # the k-th best so far

    def take(self, rows: np.ndarray, found: np.ndarray) -> None:
        """found: a score for each row and query, -inf where a row is none of the query's."""
        shown = np.round(found, TIE_DECIMALS)
        floor = self.least if len(found) <= self.k else np.maximum(self.least, -np.partition(-shown, self.k - 1, axis=0)[self.k - 1])
        i, j = np.nonzero((shown >= floor) & (found > -np.inf))
        if not len(i):
            return
        q, row, score = np.append(self.q, j), np.append(self.row, rows[i]), np.append(self.score, found[i, j])
        kept = _best(q, row, score, self.k)
        self.q, self.row, self.score = q, row, score = q[kept], row[kept], score[kept]
        full = np.bincount(q, minlength=self.n) >= self.k
        last = np.append(q[1:] != q[:-1], True)
        self.least[q[last & full[q]]] = np.round(score[last & full[q]], TIE_DECIMALS)


class _Best(Best):
    """The k nearest rows of each of some queries among the rows that it has seen."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        super().__init__(len(queries), k)
        self.asked = _unit(queries)

    def see(self, rows: np.ndarray, m: np.ndarray) -> None:
        together = max(1, CELLS // len(self.asked))
        for at in range(0, len(m), together):
            self.take(rows[at : at + together], m[at : at + together] @ self.asked.T)


def _of_length(vectors, column: str, d: int):
    """The rows of a batch or table whose vectors have d numbers, and these as a matrix."""
    own = vectors.filter(pc.equal(pc.list_value_length(vectors[column]), d))
    values = own[column].combine_chunks() if isinstance(own, pa.Table) else own[column]
    return own, values.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _nearest(ids: pa.Array, queries: np.ndarray, k: int):
    """row_idx, embedding -> qid, row_idx, score: the k nearest rows that the task has seen, of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(queries, k)
        for batch in batches:
            own, m = _of_length(batch, "embedding", queries.shape[1])
            best.see(own.column("row_idx").to_numpy(zero_copy_only=False), _unit(m))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.q)), pa.array(best.row), pa.array(best.score)], ["qid", "row_idx", "score"])

    return run


def _meet(k: int):
    """A shard of the vectors and a block of the queries -> qid, row_idx, score: the k nearest rows of the shard, of each query."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = [pa.table({"qid": asked["qid"].slice(0, 0), "row_idx": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        for d in pc.unique(pc.list_value_length(asked["qvec"])).to_pylist():
            some, queries = _of_length(asked, "qvec", d)
            own, m = _of_length(rows, "embedding", d)
            best = _Best(queries, k)
            best.see(own["row_idx"].to_numpy(), _unit(m))
            found.append(pa.table({"qid": some["qid"].combine_chunks().take(pa.array(best.q)), "row_idx": best.row, "score": best.score}))
        return pa.concat_tables(found)

    return run


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """qid, row_idx, score (cosine), rank of the k nearest rows of vectors (row_idx, embedding) for queries (qid, qvec): exact.

    The queries are a given set against all rows, and every task returns k rows a query. Up to QUERY_ROWS queries are sent to
    the tasks that read the vectors, which are not moved. More are cut into blocks, the vectors into shards, and each block meets each
    shard in a group of bounded size; nothing of them comes to the driver. ann.search finds neighbours without comparing all.
    Vectors that are null or hold a null or NaN are near to nothing; a query only meets vectors of its own length."""
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))
    rows = vectors.select(F.col("row_idx").cast("long").alias("row_idx"), F.col("embedding").cast("array<double>").alias("embedding")).filter(whole("embedding"))
    asked = queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec")).filter(whole("qvec") & (F.size("qvec") > 0))
    schema = StructType([queries.schema["qid"], StructField("row_idx", LongType()), StructField("score", DoubleType())])
    head = asked.limit(QUERY_ROWS + 1).toArrow()  # so many rows at most
    if head.num_rows > QUERY_ROWS:
        shards, blocks = max(1, -(-rows.count() // SHARD_ROWS)), -(-asked.count() // QUERY_ROWS)
        deal = lambda of, n: F.pmod(F.xxhash64(of), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.select(deal("row_idx", shards).alias("shard"), every(blocks).alias("block"), "row_idx", "embedding")
        right = asked.select(deal("qid", blocks).alias("block"), every(shards).alias("shard"), "qid", "qvec")
        return top_k(left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_meet(k), schema), k)
    found = vectors.sparkSession.createDataFrame([], schema)
    for d in pc.unique(pc.list_value_length(head["qvec"])).to_pylist():  # as a rule one length
        some, queries_of = _of_length(head, "qvec", d)
        found = found.unionByName(rows.mapInArrow(_nearest(some["qid"].combine_chunks(), queries_of, k), schema))
    return top_k(found, k)


def encoder(model: Callable[[], Callable[[list[str]], list[list[float]]]], batch_size: int = 8):
    """A column function that encodes texts. model() is called once a task, and gives a function from texts to vectors.

    Arrow batches of the session have small_batches' rows at most from then on."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        small_batches(spark)

    @F.pandas_udf(ArrayType(DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for texts in batches:
            out: list = []
            for k in range(0, len(texts), batch_size):
                out += [list(map(float, v)) for v in run([t or "" for t in texts.iloc[k : k + batch_size]])]
            yield pd.Series(out, dtype=object)

    return encode


def build_index(chunks: DataFrame, encode: Callable, model_name: str) -> tuple[DataFrame, DataFrame]:
    """(index rows, metadata row) of chunks (row_idx, chunk_id, article_id, chapter, source, source_url, text)."""
    meta = F.struct("chunk_id", "article_id", "chapter", "source", "source_url", F.col("row_idx").cast("int").alias("idx"))
    # a lambda may not hold a Python function, so vectors are made in a step of their own
    index = chunks.withColumn("__vector", encode(F.col("text"))).select(
        F.concat(F.lit("chunk_"), F.col("row_idx").cast("string")).alias("id"),
        "row_idx",
        l2_normalize(F.col("__vector")).alias("embedding"),
        F.col("text").alias("document"),
        meta.alias("metadata"),
    )
    return index, index_metadata(index, model_name)


def index_metadata(index: DataFrame, model_name: str) -> DataFrame:
    return index.agg(F.max(F.size("embedding")).alias("dim"), F.count("*").cast("int").alias("n_chunks")).select(
        F.lit(model_name).alias("model"), "dim", "n_chunks", F.lit(True).alias("normalised"), F.lit("cosine").alias("metric"), F.lit("parquet").alias("backend")
    )
