"""Substring dedup by level-wise doubling of repeated windows.

The lengths are the asked one, its half, the half of that, and so on while START words or more are left. At each length, a
window of the asked length is a candidate as long as its least part of that length, by a hash, occurs in two documents:
equal windows have equal least parts, so no repeat is lost, and a small share of the parts is shuffled. Windows that are
repeated at one length alone are extended to twice that length, until no candidates survive or the asked length is reached,
where 128-bit hashes of the windows themselves are compared. A word goes if a window over it also starts in a document with a smaller
doc_id. With the default START, windows of 50 words take one doubling, those of 100 words two.

Edge cases: a null or empty text has no words and loses none; rows with the same doc_id never remove each other's words,
and each loses what its own text shares with earlier documents; a row whose doc_id is null is returned unchanged; repeated rows get
the same result; an empty table gives an empty one.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import BATCH_ROWS, U, WordHash, as_bytes, flat_hashes, inside, mix, sliding, small_batches, stash, window_hashes

WINDOW = 50
#: Words that the shortest level has at least.
START = 25
ROW = ["doc_id", "row"]
EMPTY = hashlib.sha256(b"").hexdigest()


def lengths(window: int, start: int) -> list[int]:
    """The lengths of the levels, the asked one last."""
    out = [window]
    while out[0] // 2 >= start:
        out.insert(0, out[0] // 2)
    return out


def _least(h: np.ndarray, window: int, length: int) -> np.ndarray:
    """For each window of the full length, the least hash of its parts of a shorter length."""
    return sliding(mix(window_hashes(h, length)), window - length + 1, np.minimum)


def _scan(window: int, length: int):
    """doc_id, row, text -> doc_id, row, key (of the word sequence), n_words, sha, least (distinct least hashes of the first level)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            lists = [as_bytes(t).split() for t in batch.column("text").to_pylist()]
            h, ends = flat_hashes(lists, cache)
            least = _least(h, window, length)
            ok = inside(ends, len(h), window)
            rows, start = [], 0
            for end in ends.tolist():
                x = least[start:end][ok[start:end]]
                rows.append(np.unique(x).view(np.int64))
                start = end
            joined = [b" ".join(ws) for ws in lists]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array([hashlib.blake2b(j, digest_size=16).digest() for j in joined], pa.binary()),
                    pa.array([len(ws) for ws in lists], pa.int64()),
                    pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string()),
                    pa.array(rows, pa.list_(pa.int64())),
                ],
                ["doc_id", "row", "key", "n_words", "sha", "least"],
            )

    return run


def _survivors(h: np.ndarray, window: int, levels: list[int], repeated: list[list[int]]) -> np.ndarray:
    """Starts of the windows whose least part was repeated at each of these levels."""
    alive = np.ones(max(0, len(h) - window + 1), dtype=bool)
    for length, found in zip(levels, repeated, strict=True):
        alive &= np.isin(_least(h, window, length), np.array(found, dtype=np.int64).view(np.uint64))
    return np.flatnonzero(alive)


def _level(window: int, levels: list[int], length: int):
    """doc_id, row, text, repeated -> doc_id, row, h: distinct least parts of this length of the windows that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            for doc, row, text, repeated in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text", "repeated")), strict=True):
                h, _ = flat_hashes([as_bytes(text).split()], cache)
                least = np.unique(_least(h, window, length)[_survivors(h, window, levels, repeated)]).view(np.int64)
                if len(least):
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(least), pa.int64()) for x in (doc, row)] + [pa.array(least)], ["doc_id", "row", "h"])

    return run


def _extend(window: int, levels: list[int]):
    """doc_id, row, text, repeated -> doc_id, row, h1, h2, pos of each window that is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            for doc, row, text, repeated in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text", "repeated")), strict=True):
                h, _ = flat_hashes([as_bytes(text).split()], cache)
                pos = _survivors(h, window, levels, repeated)
                if len(pos):
                    full = [window_hashes(x, window)[pos] for x in (h, mix(h * U(0x9E3779B97F4A7C15) + U(window)))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x] * len(pos), pa.int64()) for x in (doc, row)] + [pa.array(x.view(np.int64)) for x in full] + [pa.array(pos.astype(np.int32))],
                        ["doc_id", "row", "h1", "h2", "pos"],
                    )

    return run


def _cut(window: int):
    """doc_id, text, places (starts of windows to remove) -> doc_id, n_words, n_removed, kept_sha256, kept_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                words = as_bytes(text).split()
                step = np.zeros(len(words) + 1, dtype=np.int64)
                starts = np.unique(np.array(places, dtype=np.int64))
                starts = starts[starts + window <= len(words)]
                step[starts] += 1
                np.subtract.at(step, starts + window, 1)
                gone = np.cumsum(step[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def _repeated(parts: DataFrame, tag: str) -> DataFrame:
    """doc_id, row, found: those of the hashes (doc_id, row, h) that two documents have."""
    twice = parts.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h")
    return parts.join(stash(twice, tag), "h").groupBy(*ROW).agg(F.collect_list("h").alias("found"))


def removed_windows(docs: DataFrame, window: int = WINDOW, start: int = START) -> tuple[DataFrame, DataFrame]:
    """(scan, places): each row's key, word count and digest; and, for rows of the first document of each word sequence,
    the starts of the windows that an earlier document has too."""
    small_batches(docs.sparkSession, BATCH_ROWS)
    levels = lengths(window, start)
    own = with_rows(docs)
    scan = stash(own.mapInArrow(_scan(window, levels[0]), "doc_id long, row long, key binary, n_words long, sha string, least array<long>"), "op7-scan")
    # of equal word sequences only the first can be the earliest holder of a window, or is in doubt
    first = stash(scan.filter("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first")), "op7-first")
    asked = scan.filter("size(least) > 0").join(first, [scan["key"] == first["key"], scan["doc_id"] == first["first"]], "left_semi")
    alive = _repeated(asked.select(*ROW, F.explode("least").alias("h")), "op7-level-0").select(*ROW, F.array("found").alias("repeated"))
    sound = own.filter("doc_id is not null and text is not null")
    for k, length in enumerate(levels[1:-1], 1):
        alive = stash(alive, "op7-alive")
        if alive.isEmpty():
            break
        parts = stash(sound.join(alive, ROW).mapInArrow(_level(window, levels[:k], length), "doc_id long, row long, h long"), "op7-parts")
        alive = alive.join(_repeated(parts, f"op7-level-{k}"), ROW).select(*ROW, F.concat("repeated", F.array("found")).alias("repeated"))
    full = stash(sound.join(alive, ROW).mapInArrow(_extend(window, levels[:-1] or levels), "doc_id long, row long, h1 long, h2 long, pos int"), "op7-full")
    found = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h1", "h2", "lo")
    places = full.join(stash(found, "op7-found"), ["h1", "h2"]).filter("doc_id > lo").groupBy(*ROW).agg(F.collect_list("pos").alias("places"))
    return scan.join(first, "key", "left"), places


def with_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text, so that rows of one doc_id stay apart), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def substring_dedup(docs: DataFrame, window: int = WINDOW, start: int = START) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256, and kept_text where words went (else null: unchanged)."""
    scan, places = removed_windows(docs, window, start)
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window), F.lit(False))
    places = stash(places, "op7-places")
    touched = places.select(*ROW, F.lit(True).alias("touched"))
    state = scan.select(*ROW, "n_words", "sha", copy.alias("copy")).join(touched, ROW, "left")
    whole = state.filter("copy or touched is null").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).alias("kept_text"),
    )
    firsts = with_rows(docs).join(places, ROW).mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return whole.unionByName(firsts)
