"""Approximate nearest neighbours by an inverted file with product-quantised residuals.

A coarse k-means deals the vectors, at length 1, out to cells. What a vector differs from its cell's centre by is cut into PARTS pieces, and a
code stands for each, the nearest of CODES centres of such pieces; so a vector takes PARTS bytes in the index. Both are fitted by Lloyd's rounds
in Spark, on at most SAMPLE rows in the order of a hash; every row is placed.

A query goes to its PROBES nearest cells. There its products with all code centres are tabled once, and the score of a row is a sum of
PARTS entries of the table. The best REFINE x k rows of a query are scored exactly, on the given vectors.

Cells of many rows are cut into shards, and the queries of a cell into blocks, so no group of a cell's rows and queries is larger than
SHARD_ROWS and QUERY_BLOCK, however many rows are alike. Vectors that are null, zero, of another length, or hold a null or NaN are not indexed, and such queries
find nothing.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators.lexical import top_k
from lexigrid.sources.files import remove, scratch

SAMPLE = 100_000
CODES, PARTS, ROUNDS = 64, 16, 8
PROBES, REFINE = 24, 10
SHARD_ROWS, QUERY_BLOCK = 8192, 512
#: Scores that a task computes at once.
AT_ONCE = 2_000_000


def _sound(v: Column, d: int | None = None) -> Column:
    ok = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return ok if d is None else ok & (F.size(v) == d)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors at length 1."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return m / np.linalg.norm(m, axis=1)[:, None]


def _nearest(m: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest of the centres (parts, k, width) for each part of each row; of equal ones the first."""
    parts, _, width = centers.shape
    out = np.empty((len(m), parts), dtype=np.int64)
    for p in range(parts):
        x, c = m[:, p * width : (p + 1) * width], centers[p]
        for k in range(0, len(x), 8192):
            out[k : k + 8192, p] = np.argmin((c * c).sum(axis=1) - 2 * x[k : k + 8192] @ c.T, axis=1)
    return out


def _sums(centers: np.ndarray, coarse: np.ndarray | None):
    """v -> part, code, n, total: a task's sums of the vectors, or of their residuals, that are nearest to each centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = centers.shape
        n, total = np.zeros((parts, k), dtype=np.int64), np.zeros(centers.shape)
        for batch in batches:
            m = _matrix(batch.column(0), parts * width)
            if coarse is not None:
                m = m - coarse[0][_nearest(m, coarse)[:, 0]]
            near = _nearest(m, centers)
            for p in range(parts):
                np.add.at(total[p], near[:, p], m[:, p * width : (p + 1) * width])
                n[p] += np.bincount(near[:, p], minlength=k)
        p, c = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(c, pa.int32()), pa.array(n[p, c]), pa.array(list(total[p, c]), pa.list_(pa.float64()))], ["part", "code", "n", "total"])

    return run


def lloyd(rows: DataFrame, centers: np.ndarray, rounds: int, coarse: np.ndarray | None = None) -> np.ndarray:
    """Centres (parts, k, width) after so many rounds of k-means over rows (v), each part by itself; a centre that nothing is near to stays."""
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(centers, coarse), "part int, code int, n long, total array<double>")
        add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        whole = sums.groupBy("part", "code").agg(F.sum("n").alias("n"), F.reduce(F.collect_list("total"), F.array_repeat(F.lit(0.0), centers.shape[2]), add).alias("total"))
        centers = centers.copy()
        for r in whole.collect():  # parts x k rows
            centers[r["part"], r["code"]] = np.array(r["total"]) / r["n"]
    return centers


@dataclass(frozen=True)
class Inverted:
    """cells: cell, row_idx, code (PARTS bytes); coarse (1, cells, d) and codes (PARTS, CODES, d / PARTS)."""

    cells: DataFrame
    coarse: np.ndarray
    codes: np.ndarray


def _encode(coarse: np.ndarray, codes: np.ndarray):
    """row_idx, v -> cell, row_idx, code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"), coarse.shape[2])
            cell = _nearest(m, coarse)[:, 0]
            code = _nearest(m - coarse[0][cell], codes).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("row_idx"), pa.array([c.tobytes() for c in code], pa.binary())], ["cell", "row_idx", "code"])

    return run


def _parts_of(d: int, parts: int) -> int:
    """The largest number of equal pieces that is at most parts."""
    return max(p for p in range(1, min(parts, d) + 1) if d % p == 0)


def build(vectors: DataFrame, path: str, cells: int | None = None, parts: int = PARTS, codes: int = CODES, rounds: int = ROUNDS, sample: int = SAMPLE) -> Inverted:
    """Writes the index of vectors (row_idx, embedding) to path. cells: the square root of the number of rows by default."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("row_idx").cast("long").alias("row_idx"), F.col("embedding").cast("array<double>").alias("v")).filter(_sound(F.col("v")))
    d = rows.select(F.size("v").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if d is None:
        raise ValueError("no vector can be indexed")
    d = d["d"]
    rows = rows.filter(F.size("v") == d)
    n = rows.count()
    cells = min(n, sample, cells or max(1, round(n**0.5)))
    kept = scratch(spark, "sample")
    ordered = rows.withColumn("h", F.xxhash64("row_idx", F.lit(17)))
    ordered.orderBy("h", "row_idx").limit(sample).select("v", "h").repartition(spark.sparkContext.defaultParallelism).write.parquet(kept)
    seen = spark.read.parquet(kept)
    first = _matrix(seen.orderBy("h").limit(max(cells, codes)).select("v").toArrow()["v"].combine_chunks(), d)
    coarse = lloyd(seen.select("v"), first[None, :cells], rounds)
    parts = _parts_of(d, parts)
    residual = first - coarse[0][_nearest(first, coarse)[:, 0]]
    start = np.stack([residual[:codes, p * d // parts : (p + 1) * d // parts] for p in range(parts)])
    book = lloyd(seen.select("v"), start, rounds, coarse)
    remove(spark, kept)
    placed = rows.mapInArrow(_encode(coarse, book), "cell int, row_idx long, code binary")
    placed.hint("rebalance", "cell").sortWithinPartitions("cell", "row_idx").write.mode("overwrite").parquet(f"{path}/cells")
    table = [(-1, k, v.tolist()) for k, v in enumerate(coarse[0])] + [(p, k, v.tolist()) for p in range(parts) for k, v in enumerate(book[p])]
    spark.createDataFrame(table, "part int, code int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Inverted:
    rows = spark.read.parquet(f"{path}/centers").orderBy("part", "code").collect()
    parts = sorted({r["part"] for r in rows})
    tables = {p: np.array([r["v"] for r in rows if r["part"] == p]) for p in parts}
    return Inverted(spark.read.schema("cell int, row_idx long, code binary").parquet(f"{path}/cells"), tables[-1][None], np.stack([tables[p] for p in parts if p >= 0]))


def _probe(coarse: np.ndarray, probes: int):
    """qid, v -> qid, v, cells: the cells whose centres are nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coarse[0]
        for batch in batches:
            m = _matrix(batch.column("v"), c.shape[1])
            near = np.argsort((c * c).sum(axis=1) - 2 * m @ c.T, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("v"), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], ["qid", "v", "cells"])

    return run


def _scan(coarse: np.ndarray, codes: np.ndarray, most: int):
    """One shard of a cell and one block of its queries -> qid, row_idx, about: the best rows of each query."""

    def run(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        parts, _, width = codes.shape
        found = []
        if rows.num_rows and asked.num_rows:
            code = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(-1, parts)
            ids, qids = rows["row_idx"].to_numpy(), asked["qid"].combine_chunks()
            m = _matrix(asked["v"].combine_chunks(), coarse.shape[2])
            base = m @ coarse[0][key[0].as_py()]
            together = max(1, AT_ONCE // len(ids))
            for k in range(0, len(m), together):
                q = m[k : k + together]
                about = np.repeat(base[k : k + together, None], len(ids), axis=1)
                for p in range(parts):
                    about += (q[:, p * width : (p + 1) * width] @ codes[p].T)[:, code[:, p]]
                best = np.argpartition(-about, most - 1, axis=1)[:, :most] if len(ids) > most else np.tile(np.arange(len(ids)), (len(q), 1))
                at = np.repeat(np.arange(len(q)), best.shape[1])
                found.append(pa.table({"qid": qids.take(pa.array(at + k)), "row_idx": ids[best.ravel()], "about": about[at, best.ravel()]}))
        return pa.concat_tables(found) if found else pa.table({"qid": asked["qid"].slice(0, 0), "row_idx": pa.array([], pa.int64()), "about": pa.array([], pa.float64())})

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """qid, row_idx, v, w -> qid, row_idx, score: the cosine."""
    for batch in batches:
        if batch.num_rows:
            d = len(batch.column("v")[0])
            score = np.einsum("ij,ij->i", _matrix(batch.column("v"), d), _matrix(batch.column("w"), d))
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("row_idx"), pa.array(score)], ["qid", "row_idx", "score"])


def search(index: Inverted, vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int = PROBES, refine: int = REFINE) -> DataFrame:
    """qid, row_idx, score (cosine, exact), rank of the rows found nearest to queries (qid, qvec) among vectors (row_idx, embedding)."""
    d, kind = index.coarse.shape[2], queries.schema["qid"].dataType.simpleString()
    asked = queries.select("qid", F.col("qvec").cast("array<double>").alias("v")).filter(_sound(F.col("v"), d))
    sent = asked.mapInArrow(_probe(index.coarse, probes), f"qid {kind}, v array<double>, cells array<int>").select("qid", "v", F.explode("cells").alias("cell"))
    sizes = index.cells.groupBy("cell").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards"))
    loads = sent.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    split = F.broadcast(sizes.join(loads, "cell"))  # a row per cell
    deal = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["cell", "shard", "block"]
    rows = index.cells.join(split, "cell").select("cell", deal("row_idx", "shards").alias("shard"), every("blocks").alias("block"), "row_idx", "code")
    asks = sent.join(split, "cell").select("cell", deal("qid", "blocks").alias("block"), every("shards").alias("shard"), "qid", "v")
    scan = _scan(index.coarse, index.codes, k * refine)
    near = rows.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(scan, f"qid {kind}, row_idx long, about double")
    pool = top_k(near, k * refine, "place", "about").select("qid", "row_idx")
    given = vectors.select(F.col("row_idx").cast("long").alias("row_idx"), F.col("embedding").cast("array<double>").alias("w"))
    both = pool.join(given, "row_idx").join(asked, "qid").select("qid", "row_idx", "v", "w")
    return top_k(both.mapInArrow(_exact, f"qid {kind}, row_idx long, score double"), k)
