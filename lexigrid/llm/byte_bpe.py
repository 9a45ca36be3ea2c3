"""Byte-level BPE encoding and decoding by the ranks of a tiktoken file.

A text is split by the pre-tokenizer pattern; ranked merges are folded over the byte arrays of its distinct
pieces, and decoding concatenates the binary pieces of the ids. Two styles give the same ids:

* "native": Spark higher-order functions fold the merges over the distinct pieces of the corpus, with the
  ranks as a literal (an array of small maps, so that a lookup does not scan 50 thousand entries); each
  place of each text then finds its piece's ids by a join;
* "arrow": the same fold over the distinct pieces that a task meets, in Python, with a bounded cache;
  nothing is shuffled.

Edge cases: a null or empty text has no ids and decodes to no bytes; doc_id is passed on as it is, null or
repeated; no string is a special token; very long pieces are merged by a heap in n log n; an empty table gives an
empty one; other columns are not looked at.
"""

import base64
import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from lexigrid.llm.common import Recent, small_batches, stash

#: Buckets of the literal rank map.
SLOTS = 1 << 15
NONE = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


# --- arrow style


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: the adjacent pair of least rank is merged, the leftmost first, until none has a rank."""
    if piece in ranks:
        return (ranks[piece],)
    n = len(piece)
    if n > 48:
        return _merge_long([piece[i : i + 1] for i in range(n)], ranks)
    of = ranks.get
    cut = list(range(n + 1))  # where the parts begin, and the end
    rank = [of(piece[i : i + 2], NONE) for i in range(n - 1)]
    while rank and (least := min(rank)) != NONE:
        i = rank.index(least)
        del cut[i + 1], rank[i]
        if i:
            rank[i - 1] = of(piece[cut[i - 1] : cut[i + 1]], NONE)
        if i < len(rank):
            rank[i] = of(piece[cut[i] : cut[i + 2]], NONE)
    return tuple([ranks[piece[a:b]] for a, b in zip(cut, cut[1:])])


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> tuple[int, ...]:
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] is not a or j >= n or parts[j] is not b:
            continue  # one of the two has been merged since
        parts[i], parts[j] = a + b, b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (r := ranks.get(parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (r, left, parts[left], parts[right]))
    return tuple(ranks[p] for p in parts if p)


def _code(pattern: str, shipped, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        ranks = shipped.value
        split, cache = regex.compile(pattern).findall, Recent(lambda piece: merge(piece.encode("utf-8", "surrogatepass"), ranks))
        binary = {i: b for b, i in ranks.items()}
        for batch in batches:
            ids, ends, decoded = array("i"), [0], []
            for text in batch.column("text").to_pylist():
                own = array("i", chain.from_iterable(map(cache.__getitem__, split(text)))) if text else array("i")
                decoded.append(b"".join(map(binary.__getitem__, own)))
                ids += own
                ends.append(len(ids))
            ends = np.array(ends, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", *keep)), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(ids, dtype=np.int32))), pa.array(decoded, pa.binary())],
                ["doc_id", *keep, "n_tokens", "ids", "decoded"],
            )

    return run


# --- native style


def _latin(piece: Column) -> Column:
    """UTF-8 bytes of a string, as a string of one character a byte."""
    return F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as a constant that Catalyst folds: slot of a piece's CRC-32 -> map of piece -> rank."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        slots[crc32(text.encode()) % SLOTS][text] = rank
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def binary_literal(ranks: dict[bytes, int]) -> Column:
    """The pieces in the order of their ranks, as a constant."""
    most = max(ranks.values()) + 1
    pieces = [""] * most
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def fold_merges(piece: Column, table: Column) -> Column:
    """Ids of a piece by higher-order functions; table: rank_literal()."""

    def rank(x: Column) -> Column:
        return F.try_element_at(F.get(table, F.crc32(F.encode(x, "UTF-8")) % SLOTS), x)

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(parts) - 2),
            lambda i: F.struct(F.coalesce(rank(F.concat(F.get(parts, i), F.get(parts, i + 1))), F.lit(NONE)).alias("r"), i.alias("i")),
        )
        best = lambda b: F.when(b["r"] == NONE, parts).otherwise(
            F.concat(
                F.slice(parts, F.lit(1), b["i"]),
                F.array(F.concat(F.get(parts, b["i"]), F.get(parts, b["i"] + 1))),
                F.slice(parts, b["i"] + 3, F.size(parts)),
            )
        )
        return F.when(F.size(parts) < 2, parts).otherwise(F.get(F.transform(F.array(F.array_min(pairs)), best), F.lit(0)))

    text = _latin(piece)
    bytes_ = F.split(text, "")
    merged = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), bytes_, step)
    return F.when(rank(text).isNotNull(), F.array(rank(text))).otherwise(F.transform(merged, rank))


def _native(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str]) -> DataFrame:
    # row: a key of its own for each row, so that repeated doc_ids stay apart
    split = docs.select("doc_id", *keep, F.monotonically_increasing_id().alias("__row"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?U)" + pattern), 0).alias("__pieces"))
    split = stash(split, "op8-split")
    distinct = split.select(F.explode("__pieces").alias("piece")).distinct()
    coded = stash(distinct.select("piece", fold_merges(F.col("piece"), rank_literal(ranks)).alias("ids")), "op8-coded")
    places = split.select("__row", F.posexplode("__pieces").alias("pos", "piece"))
    found = places.join(coded, "piece").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("x"))
    ids = split.join(found, "__row", "left").select("doc_id", *keep, F.coalesce(F.flatten("x.ids"), F.array().cast("array<int>")).alias("ids"))
    table = binary_literal(ranks)
    decoded = F.encode(F.array_join(F.transform("ids", lambda i: F.get(table, i)), ""), "ISO-8859-1")
    return ids.select("doc_id", *keep, F.size("ids").cast("long").alias("n_tokens"), "ids", decoded.alias("decoded"))


def byte_bpe(docs: DataFrame, path: str, pattern: str, style: str = "native", keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of docs named in keep, n_tokens, ids and decoded (the bytes that the ids stand for) of every document."""
    spark: SparkSession = docs.sparkSession
    ranks = load_ranks(path)
    keep = keep or []
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *dict.fromkeys([*keep, "text"]))
    if style == "native":
        return _native(own, ranks, pattern, keep)
    small_batches(spark)
    schema = StructType([*own.select("doc_id", *keep).schema, StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())])
    return own.mapInArrow(_code(pattern, spark.sparkContext.broadcast(ranks), keep), schema)
