"""Line dedup by pairwise alignment.

A block is a run of consecutive lines that hold BLOCK_WORDS words or more in all; blank lines are looked through. What an
earlier document has of a document's blocks goes from the later one. Documents that overlap are found through hashes: of each
line that is a block by itself, and, for shorter lines, of each shortest block around them. All longer blocks are made
of these. A hash that several documents have links each later one to its first holder: one partner a block, so links grow with
the lines and not with the square of a group. No frequency shuts a block out: a threshold of rarity would leave blocks of
common lines, and a cap on partners would lose some.

Each pair is aligned by patience diff: blocks that stand once in what the pair shares are the anchors, the longest run of them that
increases in both documents is kept, and it grows over equal neighbours. What is left over in a pair, blocks that were moved
or that repeat, are common blocks too and go as well; how many lines that are is counted. So the lines that go are
the same whichever earlier holder a block is aligned with: those in a block that any earlier document has.

Edge cases: doc_id is a document's key and its order; null or empty texts have no lines to give or lose; rows whose
doc_id is null, and rows that share a doc_id, do not lose lines to each other, and a row of a shared doc_id loses what its own text
shares with earlier documents; blank lines go with the line before them (those at the start with the first one); an empty
table gives an empty one; other columns pass through, and where one has the name of an added column, that one is added
with underscores in front.
"""

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexigrid.llm.common import as_bytes, free_name, small_batches, stash

#: Words that a block has at least.
BLOCK_WORDS = 5


def blocks_of(words: list[int], least: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the blocks that are keys, given the words of each line: no line but one could be left out at either end."""
    n = len(words)
    for s in range(n):
        total = 0
        for e in range(s, n):
            total += words[e]
            if total >= least and (s == e or total - words[e] < least or total - words[s] < least):
                yield s, e + 1
            if total - words[s] >= least:
                break


def _blocks(least: int):
    """doc_id, row, text -> doc_id, row, at, span, h, g: a row per key block; at counts the lines that aren't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["doc_id", "row", "at", "span", "h", "g"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            out = []
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                lines = [(line, n) for line in as_bytes(text).split(b"\n") if (n := len(line.split()))]
                for s, e in blocks_of([n for _, n in lines], least):
                    h = xxhash.xxh3_128_intdigest(lines[s][0] if e == s + 1 else b"\n".join([line for line, _ in lines[s:e]]))
                    out.append((doc, row, s, e - s, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)))
            for k in range(0, len(out), 50_000):
                cols = list(zip(*out[k : k + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def patience(shared: list[tuple[int, int, int]]) -> set[int]:
    """Lines of the later document of one pair that are aligned in order; shared: place, place in the earlier one, lines of each common block."""
    here, there = Counter(p for p, _, _ in shared), Counter(o for _, o, _ in shared)
    anchors = sorted({(p, o) for p, o, _ in shared if here[p] == 1 and there[o] == 1})
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(anchors)
    for k, (_, other) in enumerate(anchors):
        n = bisect_left(tails, other)
        back[k] = at[n - 1] if n else -1
        tails[n : n + 1], at[n : n + 1] = [other], [k]
    to = {(p + x, o + x) for p, o, n in shared for x in range(n)}
    aligned: set[int] = set()
    k = at[-1] if at else -1
    while k >= 0:
        p, o = anchors[k]
        while (p, o) in to and p not in aligned:
            aligned.add(p)
            p, o = p + 1, o + 1
        p, o = anchors[k][0] - 1, anchors[k][1] - 1
        while (p, o) in to and p not in aligned:
            aligned.add(p)
            p, o = p - 1, o - 1
        k = back[k]
    return aligned


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row, shared -> doc_id, row, gone (places of lines), moved, partners."""
    for batch in batches:
        gone, moved, partners = [], [], []
        for shared in batch.column("shared").to_pylist():
            pairs: dict[int, list] = {}
            for x in shared:
                pairs.setdefault(x["first"], []).append((x["at"], x["other"], x["span"]))
            ordered = set().union(*map(patience, pairs.values()))
            lines = {x["at"] + k for x in shared for k in range(x["span"])}
            gone.append(sorted(lines))
            moved.append(len(lines - ordered))
            partners.append(len(pairs))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(gone, pa.list_(pa.int32())), pa.array(moved, pa.int32()), pa.array(partners, pa.int32())],
            ["doc_id", "row", "gone", "moved", "partners"],
        )


def common_blocks(docs: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, row (a hash of the text), gone (places, among the lines that aren't blank, of those in blocks that an earlier
    document has), moved (how many of them no partner has in order), partners; only rows that lose lines."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").filter("doc_id is not null and text is not null")
    blocks = stash(own.mapInArrow(_blocks(least), "doc_id long, row long, at int, span int, h long, g long"), "op2-blocks")
    key = ["h", "g"]
    firsts = (
        blocks.groupBy(*key)
        .agg(F.min(F.struct("doc_id", "at")).alias("x"), F.max("doc_id").alias("hi"))
        .filter("x.doc_id < hi")
        .select(*key, F.col("x.doc_id").alias("first"), F.col("x.at").alias("other"))
    )
    shared = blocks.join(stash(firsts, "op2-firsts"), key).filter("doc_id > first").select("doc_id", "row", F.struct("first", "at", "other", "span").alias("x"))
    found = shared.groupBy("doc_id", "row").agg(F.collect_list("x").alias("shared"))
    return found.mapInArrow(_align, "doc_id long, row long, gone array<int>, moved int, partners int")


@F.pandas_udf(StringType())
def without_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines at the places in gone."""

    def cut(t, g):
        if t is None or g is None:
            return t
        out, kept, place = set(g.tolist()), [], -1
        for line in t.split("\n"):
            place += bool(line.encode("utf-8", "surrogatepass").split())
            if max(place, 0) not in out:
                kept.append(line)
        return "\n".join(kept)

    return pd.Series([cut(t, g) for t, g in zip(text, gone, strict=True)], dtype=object)


#: Taken once a row: a filter on the text that is left is not pushed below it, which would run it twice.
cut_once = without_lines.asNondeterministic()


def line_dedup(docs: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """docs with texts that lost their common blocks, and dedup_lines (with blank ones), dedup_removed, dedup_moved (both without), dedup_partners (long)."""
    doc, row, gone, moved, partners = names = [free_name(docs, f"__op2_{c}") for c in ("doc_id", "row", "gone", "moved", "partners")]
    blocks = common_blocks(docs, least).toDF(*names)
    joined = docs.join(blocks, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(row)), "left")
    size = F.when(F.col("text").isNull() | (F.col("text") == ""), F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    added = {"dedup_lines": size.cast("long"), "dedup_removed": number(F.size(gone)), "dedup_moved": number(F.col(moved)), "dedup_partners": number(F.col(partners))}
    own = [F.col(f"`{c}`") if c.lower() != "text" else cut_once("text", gone).alias(c) for c in docs.columns]
    return joined.select(*own, *[v.alias(free_name(docs, k)) for k, v in added.items()])
