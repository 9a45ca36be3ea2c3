"""Near-duplicate documents by ProbMinHash: five-word shingles, similarity of 0.8 or more.

Each shingle is a Poisson process whose rate is its count in the document; its arrivals fall on random
registers, a register keeps the shingle that arrives first, and a process ends once its next arrival is
later than every register's. Two documents agree on a register with the probability Jaccard similarity of their
weighted shingles. Bands of registers give candidates, which are verified on the whole texts. A document that repeats
shingles has the bands of a second signature, with every count 1, as well: pairs are alike by the Jaccard similarity of
their shingle sets too, however often either repeats a passage, and must be found by it.

Groups of copies are never expanded into pairs. Equal word sequences are one class from the start. In each
bucket, all members are first compared with its most connected one; what is linked so is one component. Where a
bucket still has several components, pairs across them are left: in small buckets they are compared. Members of
large ones meet by an exact prefix filter instead: with shingles in one order, rarest first, two documents that are
alike share one of their first few, how few depending on both lengths; first shingles that only one component
has are put aside. Where two share one, bitmaps of their shingles' parities must not differ in more bits than alike texts may differ in
shingles, so texts that share a common passage and little else make no pair; and a pair is made under the first of the shingles that
it meets at, and not under each of them. So documents that share one passage with thousands of others are not compared with
them, no link is lost, and no partner is capped.

Edge cases: a null text is in no class but its own, as is a row without doc_id; empty texts are copies of each other;
a text under five words is only like texts of the same words; ties go to the smaller doc_id; rows that share a doc_id
are one document, so their texts share a class; an empty table gives an empty one; other columns are not looked at.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import U, WordHash, as_bytes, flat_hashes, inside, join_hash, mix, small_batches, stash, window_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at the threshold is missed by all bands with probability (1 - 0.8**4)**20 = 3e-5.
BANDS, ROWS = 20, 4
#: Shingles that are drawn for at once.
TOGETHER = 16_000
#: Shingles are ordered by how many documents have one of their cell; the table of cells, which is sent out, has this size at any input.
CELLS = 1 << 20
#: Buckets of up to so many members may be compared pair by pair across their components.
SMALL = 12
#: Candidates' ids are broadcast up to so many (some 30 MB), to keep other texts out of the shuffle; beyond, the join shuffles all texts once.
BROADCAST_IDS = 1_000_000
#: Longs of a document's bitmap, and first shingles that a row has beside its own, so that a pair is made once.
BITMAP, EARLIER = 8, 16
_GOLD = U(0x9E3779B97F4A7C15)


def prob_minhash(items: np.ndarray, weights: np.ndarray, of: np.ndarray, n: int, m: int) -> np.ndarray:
    """For each of n documents and m registers, the item that arrives first there; of: the document of each item.

    All documents draw their arrivals in the same steps (2, 2, 4, 8, ...), so a signature doesn't depend on its neighbours."""
    first, kept = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)
    w, t0, k0, k = weights.astype(np.float64), np.zeros(len(items)), 0, 2
    while len(items):
        draw = mix(items[:, None] + (np.arange(k0 + 1, k0 + k + 1, dtype=np.uint64) * _GOLD)[None, :])
        gaps = -np.log(((draw >> U(11)).astype(np.float64) + 0.5) / (1 << 53)) / w[:, None]
        t = t0[:, None] + np.cumsum(gaps, axis=1)
        register = ((mix(draw + _GOLD) >> U(32)) * U(m) >> U(32)).astype(np.int64) + (of * m)[:, None]
        better = t < first[register]
        at, when = register[better], t[better]
        np.minimum.at(first, at, when)
        won = when == first[at]
        kept[at[won]] = np.broadcast_to(items[:, None], t.shape)[better][won]
        more = t[:, -1] < first.reshape(n, m).max(axis=1)[of]
        items, w, of, t0, k0, k = items[more], w[more], of[more], t[more, -1], k0 + k, max(2, min(k0 + k, 64))
    return kept.reshape(n, m)


def _band_keys(kept: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of `bands` keys for each row of registers."""
    parts = kept[:, : bands * rows].reshape(len(kept), bands, rows)
    out = parts[:, :, 0]
    for r in range(1, rows):
        out = join_hash(out, parts[:, :, r])
    return mix(out + np.arange(bands, dtype=np.uint64))


def _sign(shingle: int, bands: int, rows: int):
    """doc_id, text -> doc_id, key of the word sequence, bands (empty under one shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            lists = [as_bytes(t).split() for t in batch.column("text").to_pylist()]
            h, ends = flat_hashes(lists, cache)
            windows, ok = window_hashes(h, shingle), inside(ends, len(h), shingle)
            keys = [hashlib.blake2b(b" ".join(words), digest_size=16).digest() for words in lists]
            found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(lists)
            start, todo, size = 0, [], 0

            def sign(todo: list) -> None:
                kept = prob_minhash(np.concatenate([x for _, x, _ in todo]), np.concatenate([c for _, _, c in todo]), np.repeat(np.arange(len(todo)), [len(x) for _, x, _ in todo]), len(todo), bands * rows)
                for (k, _, _), key in zip(todo, _band_keys(kept, bands, rows), strict=True):
                    found[k] = np.union1d(found[k], key.view(np.int64))

            for k, end in enumerate(ends.tolist()):
                own = windows[start:end][ok[start:end]]
                start = end
                if len(own):
                    items, counts = np.unique(own, return_counts=True)
                    todo.append((k, items, counts))
                    size += len(own)
                    if len(items) < len(own):
                        todo.append((k, items, np.ones_like(counts)))
                        size += len(items)
                if size > TOGETHER:
                    sign(todo)
                    todo, size = [], 0
            if todo:
                sign(todo)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "key", "bands"]
            )

    return run


def _weighted(text: str, shingle: int, cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    h, _ = flat_hashes([as_bytes(text).split()], cache)
    items, counts = np.unique(window_hashes(h, shingle), return_counts=True)
    return items, counts.astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard of weighted sets, and Jaccard of the sets."""
    (x, wa), (y, wb) = a, b
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0, 0.0
    p, q = wa[i], wb[j]
    ratio = p / q
    order = np.argsort(ratio, kind="stable")
    ratio, p, q = ratio[order], p[order], q[order]
    only_a, only_b = wa.sum() - p.sum(), wb.sum() - q.sum()
    # sum over j of max(a_j / a_i, b_j / b_i): the first is larger where a_j / b_j is at least a_i / b_i
    tail_a = np.append(np.cumsum(p[::-1])[::-1], 0.0)
    head_b = np.append(0.0, np.cumsum(q))
    k = np.searchsorted(ratio, ratio, side="left")
    total = (tail_a[k] + only_a) / p + (head_b[k] + only_b) / q
    return float((1 / total).sum()), len(i) / (len(x) + len(y) - len(i))


def _verify(shingle: int, least: float):
    """a, b, text_a, text_b -> the pairs that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        recent: dict[str, tuple] = {}

        def shingles(text: str) -> tuple:
            if text not in recent:
                if len(recent) >= 64:
                    recent.pop(next(iter(recent)))
                recent[text] = _weighted(text, shingle, cache)
            return recent[text]

        for batch in batches:
            rows = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                alike = max(similarity(shingles(ta), shingles(tb)))
                if alike >= least:
                    rows.append((a, b, alike))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "alike"])

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v, comp (the least v of its component) for every end of an edge: least labels of neighbours, then labels of labels."""
    both = stash(edges.select(F.col(a).alias("v"), F.col(b).alias("u")).unionByName(edges.select(F.col(b).alias("v"), F.col(a).alias("u"))), "cc-edges")
    labels = stash(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("comp")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "comp"), "u").groupBy("v").agg(F.min("comp").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        lower = stash(lower, "cc-lower")
        jump = lower.select(F.col("v").alias("comp"), F.col("comp").alias("root"))
        after = stash(lower.join(jump, "comp").select("v", "old", F.col("root").alias("comp")), "cc-jump")
        if after.filter("old != comp").isEmpty():
            return after.select("v", "comp")
        labels = after.select("v", "comp")


class NearDuplicates:
    """The tables of one run: representatives of equal word sequences, and their components."""

    def __init__(self, docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> None:
        small_batches(docs.sparkSession)
        self.shingle, self.least = shingle, least
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        sound = self.docs.filter("doc_id is not null and text is not null")
        self.signed = stash(sound.mapInArrow(_sign(shingle, bands, rows), "doc_id long, key binary, bands array<long>"), "op3-signed")
        self.firsts = stash(self.signed.groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("key", F.col("x.doc_id").alias("rep"), F.col("x.bands").alias("bands")), "op3-firsts")

    def candidates(self) -> DataFrame:
        """bucket, rep, n (members of the bucket) for buckets of two or more."""
        banded = self.firsts.select("rep", F.explode("bands").alias("bucket"))
        shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        return stash(banded.join(stash(shared, "op3-buckets"), "bucket"), "op3-members")

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        full = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return full.mapInArrow(_verify(self.shingle, self.least), "a long, b long, alike double")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(edges a, b, alike between representatives; v, comp of those that have an edge)."""
        members = self.candidates()
        ids = stash(members.select(F.col("rep").alias("doc_id")).distinct(), "op3-ids")
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        own = self.docs.filter("doc_id is not null and text is not null").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        texts = stash(own.withColumn("row", F.xxhash64("text")).dropDuplicates(["doc_id", "row"]).drop("row"), "op3-texts")
        weight = members.groupBy("rep").agg(F.sum("n").alias("weight"))
        ranked = members.join(weight, "rep").withColumn("order", F.struct(-F.col("weight"), F.col("rep")))
        stars = stash(_stars(ranked).distinct(), "op3-stars")
        edges = stash(self.verified(stars, texts).unionByName(self.same_document()), "op3-edges")
        comps = components(edges)
        left = _unresolved(members, comps)
        small = left.filter(F.col("n") <= SMALL)
        pairs = small.select("bucket", F.col("rep").alias("a"), F.col("comp").alias("ca")).join(small.select("bucket", F.col("rep").alias("b"), F.col("comp").alias("cb")), "bucket").filter("a < b and ca != cb").select("a", "b")
        large = stash(left.filter(F.col("n") > SMALL).select("rep", "comp").distinct(), "op3-large")
        if not large.isEmpty():
            pairs = pairs.unionByName(self.prefix_pairs(large, texts))
        more = stash(pairs.distinct().join(stars, ["a", "b"], "left_anti"), "op3-more")
        if more.isEmpty():
            return edges, comps
        edges = stash(edges.unionByName(self.verified(more, texts)), "op3-edges")
        return edges, components(edges)

    def member(self) -> DataFrame:
        """doc_id, rep of every row that has both."""
        return self.signed.select("doc_id", "key").join(self.firsts.select("key", "rep"), "key").select("doc_id", "rep")

    def same_document(self) -> DataFrame:
        """Edges between the representatives of the texts of one doc_id."""
        member = self.member()
        several = stash(member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("doc_id", "a"), "op3-several")
        return member.join(several, "doc_id").filter("rep != a").select("a", F.col("rep").alias("b"), F.lit(1.0).alias("alike")).distinct()

    def prefix_pairs(self, members: DataFrame, texts: DataFrame) -> DataFrame:
        """a < b of members (rep, comp) of different components that may be alike: a superset of all that are.

        Under each key, one side of a pair is outside of the key's largest component, so a component of any size meets only
        those outside of it."""
        own = stash(texts.join(members, F.col("doc_id") == F.col("rep")).select("rep", "comp", "text"), "op3-hot")
        cells = own.mapInArrow(_cells(self.shingle), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        often = np.zeros(CELLS, dtype=np.int64)
        often[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        shipped = own.sparkSession.sparkContext.broadcast(often)
        rows = stash(own.mapInArrow(_prefix_rows(self.shingle, self.least, shipped), "rep long, comp long, token long, part int, role int, place int, size int, weighted boolean, total long, " + "".join(f"b{k} long, " for k in range(BITMAP)) + "earlier array<long>"), "op3-prefix")
        key = ["token", "part"]
        # two documents of which none repeats a shingle are left to the parts of sets
        sizes = rows.groupBy(*key, "comp").agg(F.count("*").alias("n"), F.max("weighted").alias("any_weighted"))
        mixed = sizes.groupBy(*key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("any_weighted").alias("any_weighted"), F.max(F.struct("n", "comp")).alias("most"))
        mixed = mixed.filter("lo < hi and (part >= 0 or any_weighted)").select(*key, F.col("most.comp").alias("largest"))
        rows = stash(rows.join(stash(mixed, "op3-keys"), key).withColumn("inside", F.col("comp") == F.col("largest")), "op3-mixed")
        side = lambda role, c: rows.filter(F.col("role") != role).select(*key, F.col("rep").alias(c), *[F.col(n).alias(n[0] + c) for n in ("comp", "place", "size", "weighted", "inside", "total", "earlier")], *[F.col(f"b{k}").alias(f"b{k}{c}") for k in range(BITMAP)])
        # if this is the first shingle that a pair shares, it shares no more than what follows in either
        share = self.least / (1 + self.least)
        sets = f"part >= 0 and (sx < sy or sx = sy and x < y) and least(sx - px, sy - py) >= ceil({share!r} * (sx + sy) - 1e-9)"
        # a bit that differs is a shingle at least that one of them lacks
        differ = " + ".join(f"bit_count(b{k}x ^ b{k}y)" for k in range(BITMAP))
        sets = f"{sets} and {differ} <= sx + sy - 2 * ceil({share!r} * (sx + sy) - 1e-9)"
        # by counts: where a share u of one's count is its alone, and v of the other's, the similarity is (1 - u) * (1 - v) / (1 - u * v) at most;
        # of the shingles that one of them lacks, as many are more x's than y's as x has more
        u, v = f"(greatest(0, {differ} + sx - sy) / (2 * tx))", f"(greatest(0, {differ} + sy - sx) / (2 * ty))"
        counts = f"part < 0 and (wx or wy) and x < y and (1 - {u}) * (1 - {v}) >= {self.least!r} * (1 - {u} * {v}) - 1e-9"
        x, y = side(1, "x"), side(0, "y")
        met = x.filter("not ix").join(y, key).unionByName(x.filter("ix").join(y.filter("not iy"), key))
        found = met.filter(f"cx != cy and x != y and ({sets} or {counts}) and not arrays_overlap(ex, ey)")
        return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def classes(self) -> DataFrame:
        """doc_id, class_id for every row: the least doc_id of its class."""
        _, comps = self.links()
        sound = self.member().join(comps, F.col("rep") == F.col("v"), "left").select("doc_id", F.coalesce("comp", "rep").alias("class_id"))
        rest = self.docs.filter("doc_id is null or text is null").select("doc_id", F.col("doc_id").alias("class_id"))
        return sound.unionByName(rest)


def _stars(members: DataFrame) -> DataFrame:
    """a < b: each member of a bucket with the bucket's member that is least in `order`."""
    centers = members.groupBy("bucket").agg(F.min(F.struct("order", "rep")).alias("x")).select("bucket", F.col("x.rep").alias("center"))
    pairs = members.join(centers, "bucket").filter(F.col("rep") != F.col("center"))
    return pairs.select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b"))


def _unresolved(members: DataFrame, comps: DataFrame) -> DataFrame:
    """bucket, n, rep, comp of buckets of more than two members that still have several components."""
    known = members.filter("n > 2").join(comps, F.col("rep") == F.col("v"), "left").select("bucket", "n", "rep", F.coalesce("comp", "rep").alias("comp"))
    known = stash(known, "op3-known")
    mixed = known.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    return stash(known.join(stash(mixed, "op3-open"), "bucket"), "op3-unresolved")


def _cells(shingle: int):
    """rep, comp, text -> cell, n: in how many documents of the task shingles of that cell are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total = WordHash(), np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                items, _ = _weighted(text, shingle, cache)
                np.add.at(total, (items % U(CELLS)).astype(np.int64), 1)
        cell = np.flatnonzero(total)
        for k in range(0, len(cell), 100_000):
            own = cell[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["cell", "n"])

    return run


def size_class(n: int) -> int:
    return int(math.log(n) / math.log(1.05) + 1e-9)


def prefixes(counts: list[int], least: float) -> list[tuple[int, int, int]]:
    """(how many first shingles, part, role) under which a document with these shingle counts, in the common order, is found.

    As sets, whatever the counts, a pair of sizes s <= n that is alike shares at least a = t / (1 + t) * (s + n)
    shingles, so the first shared one is among the first n - a + 1 of each. role 0: as the shorter one, under its size
    class; role 1: as the longer one, under each class that the shorter may have. Part -1, role 2 is for pairs with a
    document of repeated shingles that are alike by counts: what comes before the first shared shingle weighs at most 1 - t
    of either document."""
    n, total = len(counts), sum(counts)
    spent, first = 0, 0
    while first < n and spent <= (1 - least) * total * (1 + 1e-12):
        spent += counts[first]
        first += 1
    need = lambda s: math.ceil(least / (1 + least) * (s + n) - 1e-9)
    out = [(first, -1, 2), (n - need(n) + 1, size_class(n), 0)]
    shortest = max(1, math.ceil(least * n - 1e-9))
    for part in range(size_class(shortest), size_class(n) + 1):
        s = max(shortest, int(1.05**part))
        out.append((n - need(min(s, n)) + 1, part, 1))
    return out


def parities(items: np.ndarray) -> np.ndarray:
    """A bitmap of a set of shingles: whether an odd number of them falls on each bit."""
    odd = np.bincount((items >> U(32)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix_rows(shingle: int, least: float, shipped):
    """rep, comp, text -> rep, comp, token, part, role, place, size, weighted of the document's first shingles, those in the
    rarest cells first; shingles of one document alone are left out. earlier: the first EARLIER of those before, under the same part and role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, cache = shipped.value, WordHash()
        names = ["rep", "comp", "token", "part", "role", "place", "size", "weighted", "total", *[f"b{k}" for k in range(BITMAP)], "earlier"]
        types = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.int32, np.bool_, *[np.int64] * (1 + BITMAP)]
        for batch in batches:
            parts = []
            for rep, comp, text in zip(*(batch.column(c).to_pylist() for c in ("rep", "comp", "text")), strict=True):
                items, counts = _weighted(text, shingle, cache)
                df = often[(items % U(CELLS)).astype(np.int64)]
                order = np.lexsort((items, df))
                tokens, shared, counts = items[order].view(np.int64), df[order] > 1, counts[order].astype(np.int64).tolist()
                n, total = len(tokens), sum(counts)
                same = [n, total > n, total, *parities(items).tolist()]
                for first, part, role in prefixes(counts, least):
                    place = np.flatnonzero(shared[:first])
                    if len(place):
                        parts.append([np.full(len(place), x) for x in (rep, comp)] + [tokens[place]] + [np.full(len(place), x) for x in (part, role)] + [place] + [np.full(len(place), x) for x in same] + [tokens[place]])
                if parts and (sum(len(x[0]) for x in parts[-8:]) > 10_000 or len(parts) >= 500):
                    yield _joined(parts, names, types)
                    parts = []
            if parts:
                yield _joined(parts, names, types)

    return run


def _joined(parts: list[list[np.ndarray]], names: list[str], types: list) -> pa.RecordBatch:
    """The last column of parts has all shingles of a part; a row gets those before its own."""
    *cols, own = zip(*parts, strict=True)
    before = [np.minimum(np.arange(len(x)), EARLIER) for x in own]
    ends = np.cumsum(np.append(0, np.concatenate(before)))
    earlier = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x[:n] for x, some in zip(own, before, strict=True) for n in some.tolist()])))
    return pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, types, strict=True)], earlier], names)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id for every document."""
    return NearDuplicates(docs, shingle, least).classes()
