"""A stored inverted index: posting blocks with bounds, written at ingest, opened by searches and extended by new documents.

A block holds the postings of one term in one range of SPAN row ids, so it has SPAN postings at most where ids are keys, however common the
term is, and blocks of different terms over the same documents have the same number. A block may be stored in several parts. Texts are dealt out
by blocks, and a task makes its blocks from them, so postings are not shuffled when an index is written. A search deals the blocks of its terms
out by their numbers and adds a block's scores up in one array of its documents and the queries, of which k rows a query leave the task:
no pair of a query and a document is a row. Beside the arrays stand the number of postings, the largest
term frequency and the shortest length in the block: these bound every score in it, whatever the mean length of the corpus grows to.

    path/postings/segment=<n>/shard=<hash of the term>   blocks, sorted by term
    path/terms/segment=<n>                               term, df, as a later extension needs them
    path/stats/segment=<n>                               one row: documents, tokens and the mean idf up to this segment

An extension writes its postings, then its terms, and its row of statistics last. Readers take the segments up to the last row of statistics, so one that
fails half-way is not seen, and the next one overwrites it.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from lexigrid.functions.text import tokenize
from lexigrid.operators.lexical import BM25, BROADCAST_TERMS, bm25_topk, idf_table, query_terms, term_index, top_k
from lexigrid.operators.vectors import Best
from lexigrid.sources.files import scratch, small_batches

#: Row ids to a block, and shards of the terms.
SPAN, SHARDS = 1024, 16
BLOCK = "shard int, term string, block long, df int, max_tf int, min_dl int, ids array<long>, tfs array<int>, dls array<int>, segment int"
TERMS = "term string, df long, segment int"
STATS = "n_docs long, n_tokens long, n_terms long, mean_idf double, segment int"
#: A first threshold is taken from a query's rarest terms, until they have so many postings for each of the k rows.
PROBE = 400
#: Where there are more terms of queries than are sent out: postings of these, counted by query, that are summed up in one pass.
DIRECT = 20_000_000
#: Words that a task makes blocks of at once, queries whose scores it adds up at once, and candidates whose ids are sent out.
WORDS, QUERIES, BROADCAST_IDS = 2_000_000, 4096, 1_000_000
#: Stands for the id of rows without one, which count as one row.
NO_ID = -(1 << 63)
#: What a bound exceeds a sum of rounded scores by.
SLACK = 1e-6


@dataclass(frozen=True)
class Postings:
    """An opened index; blocks has the columns of BLOCK, terms has term and df."""

    blocks: DataFrame
    terms: DataFrame
    n_docs: int
    n_tokens: int
    mean_idf: float
    segment: int

    @property
    def avgdl(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0


def _raw_idf(df: Column, n_docs: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def write_postings(docs: DataFrame, path: str, id_col: str = "doc_id") -> Postings:
    """The index of docs (id_col, text) as the only segment at path, which holds no other index."""
    return _write(docs, path, id_col, 0)


def extend_postings(docs: DataFrame, path: str, id_col: str = "doc_id") -> Postings:
    """Adds documents with new ids to the index at path: the old segments stay as they are."""
    return _write(docs, path, id_col, open_postings(docs.sparkSession, path).segment + 1)


def _write(docs: DataFrame, path: str, id_col: str, segment: int) -> Postings:
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("row_idx"), "text")
    whole = rows.repartition(F.floor(F.col("row_idx") / SPAN)).sortWithinPartitions("row_idx")
    blocks = whole.select("row_idx", tokenize(F.col("text")).alias("tokens")).mapInArrow(_blocks(SPAN, WORDS), "term string, block long, df int, max_tf int, min_dl int, ids array<long>, tfs array<int>, dls array<int>")
    shard = F.pmod(F.xxhash64("term"), F.lit(SHARDS)).cast("int").alias("shard")
    stored = blocks.select(shard, "*").sortWithinPartitions("shard", "term", "block")
    stored.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings/segment={segment}")
    own = spark.read.schema(BLOCK).parquet(f"{path}/postings/segment={segment}")
    own.groupBy("term").agg(F.sum("df").alias("df")).write.mode("overwrite").parquet(f"{path}/terms/segment={segment}")
    # texts are not cut into words again: the index knows how many they have
    tokens = F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda n, tf: n + tf))
    n_docs, n_tokens = docs.count(), own.agg(F.coalesce(tokens, F.lit(0))).first()[0]
    if segment:
        before = open_postings(spark, path)
        n_docs, n_tokens = n_docs + before.n_docs, n_tokens + before.n_tokens
    last = _terms(spark, path, segment).agg(F.count("*").alias("n_terms"), F.coalesce(F.avg(_raw_idf(F.col("df"), F.lit(n_docs))), F.lit(0.0)).alias("mean_idf"))
    last = last.select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(n_tokens).cast("long").alias("n_tokens"), "n_terms", "mean_idf")
    last.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/segment={segment}")
    return open_postings(spark, path)


def _blocks(span: int, most: int):
    """row_idx, tokens, in the order of row_idx -> the columns of BLOCK but shard and segment, of so many words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                held.append(batch.slice(k, 256))
                n += len(held[-1].column("tokens").flatten())
                if n >= most:
                    yield from _encoded(pa.Table.from_batches(held).combine_chunks(), span)
                    held, n = [], 0
        if n:
            yield from _encoded(pa.Table.from_batches(held).combine_chunks(), span)

    return run


def _encoded(rows: pa.Table, span: int) -> Iterator[pa.RecordBatch]:
    ids, lists = rows["row_idx"].to_numpy(), rows["tokens"].combine_chunks()
    words = lists.flatten().dictionary_encode()
    sizes = np.diff(lists.offsets.to_numpy())
    key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    code, doc = key // len(ids), key % len(ids)
    block = ids[doc] // span
    starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])))
    ends, dl = np.append(starts[1:], len(key)), sizes[doc]
    lists_of = lambda x, kind, lo, hi: pa.ListArray.from_arrays(pa.array(np.append(starts[lo:hi], ends[hi - 1]) - starts[lo], pa.int32()), pa.array(x[starts[lo] : ends[hi - 1]], kind))
    most, least = np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts)
    for lo in range(0, len(starts), 20_000):
        hi = min(lo + 20_000, len(starts))
        own = starts[lo:hi]
        numbers = [(ends[lo:hi] - own, pa.int32()), (most[lo:hi], pa.int32()), (least[lo:hi], pa.int32())]
        arrays = [lists_of(ids[doc], pa.int64(), lo, hi), lists_of(tf, pa.int32(), lo, hi), lists_of(dl, pa.int32(), lo, hi)]
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[own])), pa.array(block[own]), *[pa.array(x, t) for x, t in numbers], *arrays], ["term", "block", "df", "max_tf", "min_dl", "ids", "tfs", "dls"])


def _terms(spark: SparkSession, path: str, segment: int) -> DataFrame:
    return spark.read.schema(TERMS).parquet(f"{path}/terms").filter(F.col("segment") <= segment).groupBy("term").agg(F.sum("df").alias("df"))


def open_postings(spark: SparkSession, path: str) -> Postings:
    """The index at path; one that is missing is an error."""
    stats = spark.read.schema(STATS).parquet(f"{path}/stats").orderBy(F.col("segment").desc()).first()
    if stats is None:
        raise RuntimeError(f"no index at {path}")
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/postings").filter(F.col("segment") <= stats["segment"])
    return Postings(blocks, _terms(spark, path, stats["segment"]), stats["n_docs"], stats["n_tokens"], stats["mean_idf"], stats["segment"])


def term_stats(index: Postings, params: BM25 = BM25()) -> DataFrame:
    """term, df, idf of the whole vocabulary."""
    return index.terms.select("term", "df", _idf(F.col("df"), index, params).alias("idf"))


def _idf(df: Column, index: Postings, params: BM25) -> Column:
    raw = _raw_idf(df, F.lit(index.n_docs))
    return F.when(raw < 0, F.lit(params.epsilon * index.mean_idf)).otherwise(raw)


def _kept(df: DataFrame, rows: int) -> DataFrame:
    """A table that several steps read: on the driver if it has at most BROADCAST_TERMS rows, else written."""
    spark = df.sparkSession
    if rows <= BROADCAST_TERMS:
        return F.broadcast(spark.createDataFrame(df.toArrow()) if rows else spark.createDataFrame([], df.schema))
    path = scratch(spark, "terms")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _gain(tf: Column, dl: Column, index: Postings, params: BM25) -> Column:
    return tf * (params.k1 + 1) / (tf + params.k1 * (F.lit(1 - params.b) + params.b * dl / F.lit(index.avgdl or 1.0)))


def _asked(index: Postings, queries: DataFrame, params: BM25) -> tuple[DataFrame, DataFrame]:
    """(blocks of the queries' terms, weights): weights has qid, term, df, w, and ub, which no document's share exceeds."""
    asked = query_terms(queries)
    n = asked.limit(BROADCAST_TERMS + 1).count()
    asked = _kept(asked, n)
    terms = asked.select("term").distinct()
    terms = F.broadcast(terms) if n <= BROADCAST_TERMS else terms
    here = terms.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(SHARDS)).cast("int"))
    blocks = index.blocks.join(F.broadcast(here) if n <= BROADCAST_TERMS else here, ["shard", "term"], "left_semi")
    known = blocks.groupBy("term").agg(F.sum("df").alias("df"), F.max(_gain(F.col("max_tf"), F.col("min_dl"), index, params)).alias("most"))
    idf = _idf(F.col("df"), index, params)
    weights = known.join(asked, "term").select("qid", "term", "df", (F.col("qtf") * idf).alias("w"), (F.col("qtf") * idf * F.col("most")).alias("ub"))
    return blocks, _kept(weights, n)


def _postings(blocks: DataFrame) -> DataFrame:
    """term, block, row_idx, tf, dl of blocks, which stay where they are."""
    return blocks.select("term", "block", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("term", "block", F.col("p.ids").alias("row_idx"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))


def _scores(blocks: DataFrame, weights: DataFrame, index: Postings, params: BM25) -> DataFrame:
    """block, qid, row_idx, part: sums over these terms; blocks that lie in the partitions of their numbers are not moved."""
    found = _postings(blocks).join(weights, "term")
    return found.groupBy("block", "qid", "row_idx").agg(F.sum(F.col("w") * _gain(F.col("tf"), F.col("dl"), index, params)).alias("part"))


def _dealt(blocks: DataFrame) -> DataFrame:
    """Blocks by their number: all postings of a document in one partition, moved as arrays."""
    return blocks.select("term", "block", "ids", "tfs", "dls").repartition("block")


def _added(shipped, k: int, span: int, avgdl: float, params: BM25):
    """block, term, ids, tfs, dls, in the order of block and term -> qid, row_idx, score: the k best of each query among the task's documents.
    shipped has (qids, terms of these queries with the queries' places and weights) for each QUERIES of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [(qids, terms, Best(len(qids), k)) for qids, terms in shipped.value]

        def see(number: int, held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            flat = lambda c: rows[c].combine_chunks().flatten().to_numpy()
            place, tf, dl = flat("ids") - number * span, flat("tfs"), flat("dls")
            gain = tf * (params.k1 + 1) / (tf + params.k1 * ((1 - params.b) + params.b * dl / avgdl))
            ends = np.cumsum(rows["ids"].combine_chunks().value_lengths().to_numpy())
            names = rows["term"].to_pylist()
            for qids, terms, best in groups:
                score, met = np.zeros((span, len(qids))), np.zeros((span, len(qids)), dtype=bool)
                lo = 0
                for name, hi in zip(names, ends.tolist(), strict=True):
                    if name in terms:
                        q, w = terms[name]
                        at, more = place[lo:hi], gain[lo:hi]
                        if (at[1:] == at[:-1]).any():  # rows that share an id are one
                            more, at = np.add.reduceat(more, np.flatnonzero(np.append(True, at[1:] != at[:-1]))), np.unique(at)
                        cell = (at[:, None], q)
                        score[cell] += more[:, None] * w
                        met[cell] = True
                    lo = hi
                own = np.flatnonzero(met.any(axis=1))
                best.take(own + number * span, np.where(met[own], score[own], -np.inf))

        number, held = 0, []
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and numbers[lo] != number:
                    see(number, held)
                    held = []
                number = int(numbers[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            see(number, held)
        for qids, _, best in groups:
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(best.q)), pa.array(best.row), pa.array(best.score)], ["qid", "row_idx", "score"])

    return run


def shipped_weights(weights: pa.Table) -> list[tuple[pa.Array, dict]]:
    """What _added and the scan are sent: weights (qid, term, w) by QUERIES of the queries."""
    coded = weights["qid"].combine_chunks().dictionary_encode()
    at, w, names = coded.indices.to_numpy(), weights["w"].to_numpy(), weights["term"].to_pylist()
    groups: list[tuple[pa.Array, dict]] = [(coded.dictionary.slice(k, QUERIES), {}) for k in range(0, len(coded.dictionary), QUERIES)]
    for name, q, x in zip(names, at.tolist(), w.tolist(), strict=True):
        own = groups[q // QUERIES][1].setdefault(name, ([], []))
        own[0].append(q % QUERIES)
        own[1].append(x)
    return [(qids, {t: (np.array(q), np.array(x)) for t, (q, x) in terms.items()}) for qids, terms in groups]


def _coded(names: list[str]):
    """row_idx, dl, terms (term, tf) -> row_idx, dl, codes, tfs of the named terms; documents without any go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        for batch in batches:
            lists = batch.column("terms")
            flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy()
            code = pc.fill_null(pc.index_in(flat.field("term"), value_set=known), -1).to_numpy()
            held = code >= 0
            n = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[held], minlength=len(sizes))
            ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            arrays = [pa.ListArray.from_arrays(ends, pa.array(x[held], pa.int32())) for x in (code, flat.field("tf").to_numpy())]
            found = pa.RecordBatch.from_arrays([batch.column("row_idx"), batch.column("dl"), *arrays], ["row_idx", "dl", "codes", "tfs"])
            yield found.filter(pa.array(n > 0))

    return run


def _scanned(names: list[str], shipped, k: int, avgdl: float, params: BM25, together: int):
    """row_idx, dl, codes, tfs in the order of row_idx -> qid, row_idx, score: the k best of each query among the task's documents, of which so many
    are scored at once in one array of documents and queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [(qids, [terms.get(name) for name in names], Best(len(qids), k)) for qids, terms in shipped.value]

        def see(rows: pa.Table) -> None:
            flat = lambda c: rows[c].combine_chunks().flatten().to_numpy()
            ids, doc = np.unique(rows["row_idx"].to_numpy(), return_inverse=True)  # rows that share an id are one
            sizes = rows["codes"].combine_chunks().value_lengths().to_numpy()
            code, tf, doc, dl = flat("codes"), flat("tfs"), np.repeat(doc, sizes), np.repeat(rows["dl"].to_numpy(), sizes)
            gain = tf * (params.k1 + 1) / (tf + params.k1 * ((1 - params.b) + params.b * dl / avgdl))
            order = np.lexsort((doc, code))
            code, doc, gain = code[order], doc[order], gain[order]
            first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
            code, doc, gain = code[first], doc[first], np.add.reduceat(gain, first)
            cuts = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code))
            for qids, terms, best in groups:
                score, met = np.zeros((len(ids), len(qids))), np.zeros((len(ids), len(qids)), dtype=bool)
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if terms[code[lo]] is not None:
                        q, w = terms[code[lo]]
                        cell = (doc[lo:hi, None], q)
                        score[cell] += gain[lo:hi, None] * w
                        met[cell] = True
                best.take(ids, np.where(met, score, -np.inf))

        held, n = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= together:
                rows = pa.Table.from_batches(held).combine_chunks()
                last = rows["row_idx"].to_numpy()
                cut = int(np.searchsorted(last, last[-1]))  # the last id may go on in the next batch
                if cut:
                    see(rows.slice(0, cut).combine_chunks())
                held = rows.slice(cut).combine_chunks().to_batches()
                n = rows.num_rows - cut
        if n:
            see(pa.Table.from_batches(held).combine_chunks())
        for qids, _, best in groups:
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(best.q)), pa.array(best.row), pa.array(best.score)], ["qid", "row_idx", "score"])

    return run


def scan(docs: DataFrame, queries: DataFrame, k: int = 20, params: BM25 = BM25(), id_col: str = "doc_id") -> DataFrame:
    """search() without a stored index: qid, row_idx, score, rank, from texts that are read and counted for these queries.

    Terms are counted in a document's row. Those of the queries are moved as arrays, by document, and a task adds scores up in an array and keeps k
    rows a query, so no pair of a query and a document is a row. Queries with more than BROADCAST_TERMS terms are joined (lexical.bm25_topk)."""
    spark, asked = docs.sparkSession, query_terms(queries)
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("row_idx"), "text")
    index = term_index(rows, "row_idx")
    if asked.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS:
        return _with_ids(bm25_topk(rows, queries, k, params, "row_idx", index))
    weights = idf_table(index, params).join(F.broadcast(asked), "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl").toArrow()
    avgdl = (weights["avgdl"][0].as_py() if weights.num_rows else 1.0) or 1.0
    names = pc.unique(weights["term"]).to_pylist()
    shipped = spark.sparkContext.broadcast(shipped_weights(weights))
    schema = StructType([queries.schema["qid"], StructField("row_idx", LongType()), StructField("score", DoubleType())])
    coded = index.select("row_idx", "dl", "terms").mapInArrow(_coded(names), "row_idx long, dl int, codes array<int>, tfs array<int>")
    dealt = coded.repartition("row_idx").sortWithinPartitions("row_idx")
    found = dealt.mapInArrow(_scanned(names, shipped, k, avgdl, params, SPAN), schema)
    return _with_ids(top_k(found, k)).filter("score > 0")


def essential_terms(index: Postings, queries: DataFrame, k: int, params: BM25 = BM25(), asked: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, weights): weights has qid, term, w, essential, and floor and rest of the query. A document without an essential term can't be
    among the k best: the bounds of the other terms, in sum the rest, don't reach the floor, which k documents reach by the query's
    rarest terms alone."""
    blocks, weights = asked or _asked(index, queries, params)
    by = Window.partitionBy("qid").orderBy("df", "term")
    rare = weights.withColumn("before", F.coalesce(F.sum("df").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < PROBE * k)
    probed = blocks.join(F.broadcast(rare.select("term").distinct()), "term", "left_semi")
    best = top_k(_scores(_dealt(probed), rare.select("qid", "term", "w"), index, params).withColumnRenamed("part", "score"), k)
    floor = best.filter(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    if index.mean_idf < 0:  # terms may count against a document: no bound holds
        floor = floor.filter("false")
    up = Window.partitionBy("qid").orderBy("ub", "term")
    marked = weights.join(floor, "qid", "left").withColumn("total", F.sum("ub").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("essential", F.col("floor").isNull() | (F.col("total") >= F.col("floor") - SLACK))
    rest = F.coalesce(F.max(F.when(~F.col("essential"), F.col("total"))).over(Window.partitionBy("qid")), F.lit(0.0))
    marked = marked.select("qid", "term", "df", "w", "essential", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), rest.alias("rest"))
    return blocks, _kept(marked, weights.limit(BROADCAST_TERMS + 1).count())


def search(index: Postings, queries: DataFrame, k: int = 20, params: BM25 = BM25()) -> DataFrame:
    """qid, row_idx, score, rank: the k best documents of queries (qid, text) by BM25, exactly; those without a positive score go.

    Where the queries have at most BROADCAST_TERMS terms, these are sent to the tasks that have the blocks; a task adds a block's scores up in
    an array and keeps k rows a query. More terms are joined. If they have more than DIRECT postings in all, pairs of a query and a document
    arise from essential terms only then: of these the ones whose bound reaches the floor are completed by the other terms' postings, looked
    up by document; so a term that is nearly everywhere makes no pairs by itself."""
    spark, asked = queries.sparkSession, _asked(index, queries, params)
    if asked[1].limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        shipped = spark.sparkContext.broadcast(shipped_weights(asked[1].select("qid", "term", "w").toArrow()))
        schema = StructType([queries.schema["qid"], StructField("row_idx", LongType()), StructField("score", DoubleType())])
        found = _dealt(asked[0]).sortWithinPartitions("block", "term").mapInArrow(_added(shipped, k, SPAN, index.avgdl or 1.0, params), schema)
        return _with_ids(top_k(found, k)).filter("score > 0")
    if (asked[1].agg(F.sum("df")).first()[0] or 0) <= DIRECT:
        whole = _scores(_dealt(asked[0]), asked[1].select("qid", "term", "w"), index, params).select("qid", "row_idx", F.col("part").alias("score"))
        return _with_ids(top_k(whole, k)).filter("score > 0")
    blocks, weights = essential_terms(index, queries, k, params, asked)
    dealt = _dealt(blocks)
    first = weights.filter("essential").select("qid", "term", "w")
    per_query = F.broadcast(weights.groupBy("qid").agg(F.first("floor").alias("floor"), F.first("rest").alias("rest")))
    candidates = _scores(dealt, first, index, params).join(per_query, "qid").filter(F.col("part") + F.col("rest") >= F.col("floor") - SLACK).select("block", "qid", "row_idx", "part")
    other = weights.filter("not essential").select("qid", "term", "w")
    common = dealt.join(F.broadcast(other.select("term").distinct()), "term", "left_semi")
    wanted = candidates.select("block", "qid", "row_idx").join(other, "qid")  # a row for each common term of a candidate's query
    gained = wanted.join(_postings(common), ["block", "row_idx", "term"])
    gained = gained.select("block", "qid", "row_idx", (F.col("w") * _gain(F.col("tf"), F.col("dl"), index, params)).alias("part"))
    total = candidates.unionByName(gained).groupBy("block", "qid", "row_idx").agg(F.sum("part").alias("score"))
    return _with_ids(top_k(total.select("qid", "row_idx", "score"), k)).filter("score > 0")


def _with_ids(found: DataFrame) -> DataFrame:
    return found.withColumn("row_idx", F.when(F.col("row_idx") != NO_ID, F.col("row_idx")))


def holders(index: Postings, docs: DataFrame, queries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """qid, row_idx of all documents that hold a query's tokens one after another: those with its rarest token are read and compared.
    Queries without a token have none, as have those with one that no document has."""
    spark = queries.sparkSession
    blocks, weights = _asked(index, queries, BM25())
    rarest = weights.groupBy("qid").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    n = weights.select("qid").distinct().limit(BROADCAST_TERMS + 1).count()
    sent = F.broadcast if n <= BROADCAST_TERMS else lambda df: df
    phrase = lambda c: F.concat(F.lit(" "), F.array_join(tokenize(F.col(c)), " "), F.lit(" "))
    rarest = _kept(rarest, n)
    # postings of other terms are left out as arrays, so none of them is a row
    found = _postings(blocks.join(sent(rarest.select("term").distinct()), "term", "left_semi")).join(sent(rarest), "term").select("qid", "row_idx")
    path = scratch(spark, "holders")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    ids = found.select("row_idx").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).cast("long").alias("row_idx"), "text").join(F.broadcast(ids) if few else ids, "row_idx", "left_semi")
    texts = texts.select("row_idx", phrase("text").alias("tokens"))
    asked = found.join(sent(queries.select("qid", phrase("text").alias("phrase"))), "qid")
    return texts.join(asked, "row_idx").filter(F.contains("tokens", "phrase")).select("qid", "row_idx")
