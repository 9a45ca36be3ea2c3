"""A text encoder that is fitted here: latent semantic vectors, by randomised SVD of the tf-idf matrix.

Words are hashed into a fixed number of buckets, so the matrix has as many columns at any input: what a pass over the documents gathers, and what
tasks are sent, is bounded by BUCKETS x (dims + OVER) numbers. Its leading right singular vectors come from subspace iteration: each
round multiplies a block of vectors by the matrix and its transpose in one pass, every task summing up its own rows, and the driver
orthonormalises the block. The last round's small Gram matrix gives singular values and the basis.

A text is its words' 1 + ln(count), times ln((1 + n) / (1 + df)) + 1, at length 1, times the basis. Words that only share a bucket count as one.

Edge cases: null and empty texts are zero rows of the matrix and get zero vectors; texts of words that no document has get the vector of their
buckets, zero if these are unknown; fewer documents than dims give singular values of 0 at the end; a corpus without words gives zero vectors.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lexigrid.functions.text import tokenize
from lexigrid.sources.files import remove, scratch

BUCKETS, DIMS, OVER, ROUNDS, SEED = 1 << 15, 64, 32, 4, 5
#: Rows whose entries become one dense matrix.
STRIP = 64


def buckets_of(text: Column, buckets: int) -> Column:
    """The bucket of each word of a text, in order."""
    return F.transform(tokenize(text), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def weighted(lists: pa.ListArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the matrix's entries, rows at length 1."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    key, count = np.unique(row * len(idf) + flat, return_counts=True)
    row, bucket = key // len(idf), key % len(idf)
    w = (1 + np.log(count)) * idf[bucket]
    norm = np.sqrt(np.bincount(row, w * w, len(sizes)))
    return row, bucket, w / np.where(norm == 0, 1.0, norm)[row]


def strips(lists: pa.ListArray, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets, dense rows over these buckets alone) of STRIP rows at a time, for products of matrices; buckets are few if rows are."""
    row, bucket, w = weighted(lists, idf)
    cuts = np.searchsorted(row, np.arange(0, len(lists) + STRIP, STRIP))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if lo < hi:
            own, at = np.unique(bucket[lo:hi], return_inverse=True)
            dense = np.zeros((STRIP, len(own)))
            dense[row[lo:hi] - k * STRIP, at] = w[lo:hi]
            yield k * STRIP, own, dense[: len(lists) - k * STRIP]


def project(lists: pa.ListArray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The rows of these lists times the basis."""
    out = np.zeros((len(lists), basis.shape[1]))
    for at, own, dense in strips(lists, idf):
        out[at : at + STRIP] = dense @ basis[own]
    return out


def _round(idf, block):
    """bucket lists -> bucket, v: the task's share of the transposed matrix times the matrix times the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block.value.shape)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for _, own, dense in strips(batch.column(0).slice(k, 256), idf.value):
                    total[own] += dense.T @ (dense @ block.value[own])
        yield from _rows_of(total)

    return run


def _rows_of(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(total.any(axis=1))
    for k in range(0, len(at), 4096):
        own = at[k : k + 4096]
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(total[own].ravel()), total.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), vectors], ["bucket", "v"])


def _sums(partial: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sums by bucket, as a matrix: at most BUCKETS rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            np.add.at(total, batch.column("bucket").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, shape[1]))
        yield from _rows_of(total)

    summed = partial.repartition("bucket").mapInArrow(run, "bucket int, v array<double>").toArrow()
    out = np.zeros(shape)
    if summed.num_rows:
        out[summed["bucket"].to_numpy()] = summed["v"].combine_chunks().flatten().to_numpy().reshape(-1, shape[1])
    return out


@dataclass(frozen=True)
class Semantic:
    """A fitted model: idf by bucket, basis (buckets x dims), singular values."""

    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray

    def encoder(self, spark: SparkSession) -> Callable[[Column], Column]:
        """A column function from texts to vectors, as vectors.build_index and flows.search take it."""
        shipped = spark.sparkContext.broadcast((self.idf, self.basis))

        @F.pandas_udf(ArrayType(DoubleType()))
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            idf, basis = shipped.value
            for lists in batches:
                yield pd.Series(list(project(pa.array(lists, pa.list_(pa.int32())), idf, basis)), dtype=object)

        once = encode.asNondeterministic()  # a filter on the vectors is not pushed below it, which would cut and encode the texts twice
        return lambda text: once(buckets_of(text, len(self.idf)))

    def write(self, spark: SparkSession, path: str) -> None:
        rows = pa.table({"bucket": pa.array(range(len(self.idf)), pa.int32()), "idf": self.idf, "v": list(self.basis)})
        spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/basis")
        values = pa.table({"k": pa.array(range(len(self.values)), pa.int32()), "value": self.values})
        spark.createDataFrame(values).coalesce(1).write.mode("overwrite").parquet(f"{path}/values")


def read(spark: SparkSession, path: str) -> Semantic:
    rows = spark.read.parquet(f"{path}/basis").orderBy("bucket").toArrow()
    basis = np.array(rows["v"].to_pylist())
    return Semantic(rows["idf"].to_numpy(), basis, spark.read.parquet(f"{path}/values").orderBy("k").toArrow()["value"].to_numpy())


def fit(docs: DataFrame, dims: int = DIMS, buckets: int = BUCKETS, over: int = OVER, rounds: int = ROUNDS, seed: int = SEED) -> Semantic:
    """The model of docs (text). Texts are tokenised once, into a scratch table that goes when the model is fitted."""
    spark = docs.sparkSession
    path = scratch(spark, "buckets")
    docs.select(buckets_of(F.col("text"), buckets).alias("b")).write.parquet(path)
    # each task of a round gives up to buckets x r numbers, so there are no more tasks than cores, however large the table is
    rows = spark.read.schema("b array<int>").parquet(path).coalesce(spark.sparkContext.defaultParallelism)
    counts = rows.select(F.explode(F.array_distinct("b")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(buckets)
    df[counts["bucket"].to_numpy()] = counts["df"].to_numpy()
    idf = np.where(df > 0, np.log((1 + rows.count()) / (1 + df)) + 1, 0.0)
    r = dims + over
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, r)))[0]
    sent = spark.sparkContext.broadcast(idf)
    for k in range(rounds):
        shipped = spark.sparkContext.broadcast(block)
        image = _sums(rows.mapInArrow(_round(sent, shipped), "bucket int, v array<double>"), block.shape)
        if k + 1 < rounds:
            block = np.linalg.qr(image)[0]
        shipped.destroy()
    remove(spark, path)
    gram = block.T @ image
    squares, mix = np.linalg.eigh((gram + gram.T) / 2)
    best = np.argsort(-squares)[:dims]
    basis = block @ mix[:, best]
    basis *= np.where(basis[np.abs(basis).argmax(axis=0), np.arange(len(best))] < 0, -1.0, 1.0)
    return Semantic(idf, basis, np.sqrt(np.maximum(squares[best], 0)))
