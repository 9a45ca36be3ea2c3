"""Substring dedup by bytes: a logarithmic family of sparse suffix arrays.

Every string of LENGTH bytes holds a string of GRAIN bytes whose hash is the least in it. The suffixes that start at these places, about three
of a hundred, are all that a batch of documents puts into its suffix array: equal strings of LENGTH bytes have equal least parts, so each
repeat shows as two suffixes that agree in GRAIN bytes or more. Suffixes stand in the order of a hash of their first GRAIN bytes, which, as
order by bytes does, puts those that agree side by side. The strings of LENGTH bytes that have one least part in common are neighbours in the
text: the bytes that they cover are its context, and every string is in one context.

Batches are added in the order of doc_id. A new batch's suffixes are sorted and scanned along with each level that is there, which are tables
bucketed and sorted by their keys, so that a scan moves the new batch and not the level. Then the batch is a level of its own, and as long
as the last two levels are equally large they are merged, so n batches make at most log2(n) + 1 levels and a suffix is rewritten as often.

* A context that an earlier document has too is known: all of its bytes go.
* Where suffixes agree and contexts differ, the first holders of the contexts are opened: their texts are read again and the contexts are cut
  into parts of STEP strings, counted from the least part, which are judged likewise: known if an earlier document has all of a part's bytes, and
  opened if only the bytes that all its strings have occur elsewhere. In opened parts every string of LENGTH bytes is compared by
  a 128-bit hash, so the long matches are exact however a passage is embedded.
* Repeats within a document are found where the document is read.

Documents with equal texts are collapsed first. A level has one row a beginning and one a context, so no key has many rows, however often a
passage occurs. Parts and strings of opened contexts grow with the number of different contexts, not with their pairs.

Edge cases: null and empty texts have no bytes; texts shorter than LENGTH lose none; a row whose doc_id is null is returned unchanged and takes
no part; rows that share a doc_id never take each other's bytes, and each loses what its own text repeats or shares with earlier documents; repeated
rows get the same result; an empty table gives an empty one; only doc_id and text are read, so other columns may have any name. Very long texts are read in
blocks of BLOCK strings: a context ends with its block, which opens it where it would have been known, and changes no result.
"""

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import common
from lexigrid.llm.common import U, inside, mix, shared_dir, sliding, small_batches, stash

LENGTH = 100
GRAIN = 40
BATCHES = 4
#: Strings to a part of an opened context.
STEP = 8
#: Strings that are hashed at a time.
BLOCK = 1 << 18
#: Ids that are broadcast at most; beyond, texts are shuffled once more.
BROADCAST_IDS = 1_000_000
ROW = ["doc", "row"]
EMPTY = hashlib.sha256(b"").hexdigest()
_PLACE = U((1 << 20) - 1)


class Rolling:
    """Polynomial hashes, modulo 2^64, of all strings of a length in a block of bytes; each byte stands for a random number."""

    def __init__(self, seed: int, most: int) -> None:
        draw = np.random.default_rng(seed)
        self.letters = draw.integers(0, 1 << 64, 256, dtype=np.uint64)
        base = int(draw.integers(0, 1 << 61)) * 8 + 5
        self.up = np.full(most + 1, base, dtype=np.uint64)
        self.down = np.full(most + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        for x in (self.up, self.down):
            x[0] = 1
            np.multiply.accumulate(x, out=x)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letters[data] * self.up[: len(data)], out=out[1:])
        return out

    def all(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = max(0, len(sums) - length)
        return mix((sums[length:] - sums[:n]) * self.down[:n])

    def some(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts])


class Contexts:
    """What a task needs to find contexts and to hash strings."""

    def __init__(self, length: int, grain: int, block: int) -> None:
        if not 0 < grain < length or block + length > 1 << 20:
            raise ValueError("0 < grain < length, and a block has less than 2^20 bytes")
        self.length, self.grain, self.block = length, grain, block
        self.one, self.two = Rolling(11, block + 2 * length), Rolling(12, block + 2 * length)

    def _pieces(self, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(first document, end document, first byte, end byte) of what is hashed together: whole documents, or a block of a long one."""
        k, n = 0, len(ends)
        while k < n:
            start = int(ends[k - 1]) if k else 0
            if ends[k] - start > self.block:
                for at in range(start, int(ends[k]) - self.length + 1, self.block):
                    yield k, k + 1, at, min(at + self.block + self.length - 1, int(ends[k]))
                k += 1
                continue
            stop = int(np.searchsorted(ends, start + self.block, side="right"))
            yield k, stop, start, int(ends[stop - 1])
            k = stop

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(doc, first, n, g, c, at): number of the document, place of the first string and number of strings, hashes of the least part and of the
        context, place of the least part."""
        found = []
        for first_doc, end_doc, start, stop in self._pieces(ends):
            own = np.minimum(ends[first_doc:end_doc], stop) - start
            if stop - start < self.length:
                continue
            sums = self.one.sums(data[start:stop])
            least = self.one.all(sums, self.grain)
            # the place in the low bits: of equal ones the leftmost is the least
            at = (sliding((least & ~_PLACE) | np.arange(len(least), dtype=np.uint64), self.length - self.grain + 1, np.minimum) & _PLACE).astype(np.int64)
            strings = np.flatnonzero(inside(own, stop - start, self.length))
            if not len(strings):
                continue
            at = at[strings]
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            n = np.diff(np.append(new, len(at)))
            first = strings[new]
            g = least[at[new]]
            c = mix(self.one.some(sums, first, first + n + self.length - 1) + n.astype(np.uint64) * U(0x9E3779B97F4A7C15))
            doc = first_doc + np.searchsorted(own, first, side="right")
            shift = start - np.where(doc > 0, ends[doc - 1], 0)
            found.append((doc, first + shift, n, g, c, at[new] + shift))
        if not found:
            return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of these spans, each shorter than twice the length; blocks without any are passed over."""
        out, order = np.zeros(len(starts), dtype=np.uint64), np.argsort(starts, kind="stable")
        sorted_starts, lo = starts[order], 0
        while lo < len(order):
            at = int(sorted_starts[lo])
            hi = int(np.searchsorted(sorted_starts, at + self.block))
            own = order[lo:hi]
            stop = int(ends[own].max())
            out[own] = self.one.some(self.one.sums(data[at:stop]), starts[own] - at, ends[own] - at)
            lo = hi
        return out

    def hashes(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of the strings of one document at these increasing places."""
        out = np.zeros((2, len(starts)), dtype=np.uint64)
        for at in range(0, len(data), self.block):
            lo, hi = np.searchsorted(starts, [at, at + self.block])
            if lo < hi:
                own = starts[lo:hi] - at
                for k, rolling in enumerate((self.one, self.two)):
                    out[k, lo:hi] = rolling.some(rolling.sums(data[at : at + self.block + self.length - 1]), own, own + self.length)
        return out[0], out[1]


def _strings(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of all strings of these contexts, in increasing order."""
    places = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
    return np.sort(places)


def _firsts(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which of these strings, in order of their places, are the first of their kind."""
    order = np.lexsort((np.arange(len(h)), g, h))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])) if len(h) else np.zeros(0, dtype=bool)
    out = np.zeros(len(h), dtype=bool)
    out[order[new]] = True
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fewest spans that cover these ones; spans that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def _flat(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    return np.stack(merged(starts, ends), axis=1).ravel().tolist()


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in one array, and where each value ends; null is empty."""
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.zeros(0, dtype=np.uint8) if raw is None else np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


HELD = "array<struct<c:bigint,doc:bigint>>"
SUFFIXES = "doc long, row long, g long, c long, spans array<int>"


def _suffixes(length: int, grain: int, block: int):
    """doc, row, text (binary) -> a row per context of a document (g, c), and one with spans where it repeats itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Contexts(length, grain, block)
        for batch in batches:
            data, ends = _bytes_of(batch.column("text"))
            doc, first, n, g, c, _ = tool.of(data, ends)
            ids, rows = (batch.column(x).to_numpy(zero_copy_only=False) for x in ROW)
            by_grain = np.lexsort((g, doc))
            same = (doc[by_grain][1:] == doc[by_grain][:-1]) & (g[by_grain][1:] == g[by_grain][:-1])
            again = np.zeros(len(doc), dtype=bool)
            again[by_grain[1:][same]] = again[by_grain[:-1][same]] = True
            owners, spans = [], []
            for k in np.unique(doc[again]).tolist():
                own = data[ends[k - 1] if k else 0 : ends[k]]
                starts = _strings(first[again & (doc == k)], n[again & (doc == k)])
                later = starts[~_firsts(*tool.hashes(own, starts))]
                if len(later):
                    owners.append(k)
                    spans.append(_flat(later, later + length))
            order = np.lexsort((c, doc))
            keep = order[np.append(True, (doc[order][1:] != doc[order][:-1]) | (c[order][1:] != c[order][:-1]))] if len(order) else order
            at = np.append(doc[keep], np.array(owners, dtype=np.int64))
            gone = len(owners)
            hashes = [pa.concat_arrays([pa.array(x[keep].view(np.int64)), pa.nulls(gone, pa.int64())]) for x in (g, c)]
            lists = pa.concat_arrays([pa.nulls(len(keep), pa.list_(pa.int32())), pa.array(spans, pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(rows[at], pa.int64()), *hashes, lists], ["doc", "row", "g", "c", "spans"])

    return run


BLOCKS = "doc long, row long, at int, core long, outer long, bytes binary, spans array<int>"


def _parts(first: np.ndarray, n: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """(context, first string, number of strings, first place of the part): contexts cut where the distance to the least part is a multiple of step."""
    low, high = (first - at) // step, (first + n - 1 - at) // step
    count = high - low + 1
    k = np.repeat(np.arange(len(first)), count)
    lo = at[k] + (low[k] + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)) * step
    a = np.maximum(lo, first[k])
    return k, a, np.minimum(lo + step, (first + n)[k]) - a, lo


def _opened(length: int, grain: int, block: int, step: int):
    """doc, row, text, known, opened (hashes of contexts) -> spans of the known contexts, and a row per part of an opened one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Contexts(length, grain, block)
        for batch in batches:
            data, ends = _bytes_of(batch.column("text"))
            doc, first, n, g, c, at = tool.of(data, ends)
            base, ids = np.append(0, ends)[doc], [batch.column(x).to_numpy() for x in ROW]
            mark = lambda d, h: mix(d.astype(np.uint64) + U(1)) ^ h
            own, listed = mark(doc, c), {}
            for kind in ("known", "opened"):
                lists = batch.column(kind)
                which = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                listed[kind] = np.isin(own, mark(which, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            old = np.flatnonzero(listed["known"])
            spans, owners = [], np.unique(doc[old])
            for lo, hi in zip(np.searchsorted(doc[old], owners).tolist(), np.searchsorted(doc[old], owners, side="right").tolist(), strict=True):
                k = old[lo:hi]
                spans.append(_flat(first[k], first[k] + n[k] + length - 1))
            new = np.flatnonzero(listed["opened"] & ~listed["known"])
            new = new[np.sort(np.unique(own[new], return_index=True)[1])]  # of a context that a document repeats the first one
            of, start, count, low = _parts((first + base)[new], n[new], (at + base)[new], step)
            last = start + count + length - 1
            hashed = tool.spans(data, np.append(low + step - 1, start), np.append(low + length, last))
            core = hashed[: len(start)] ^ mix(g[new][of] + (low - (at + base)[new][of]).astype(np.uint64))
            outer = hashed[len(start) :] ^ mix((start - low).astype(np.uint64) * U(64) + count.astype(np.uint64))
            held = [data[x:y].tobytes() for x, y in zip(start.tolist(), last.tolist(), strict=True)]
            none = lambda t, m=len(spans): pa.nulls(m, t)
            where = np.append(doc[new][of], owners)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(x[where]) for x in ids),
                    pa.concat_arrays([pa.array((start - base[new][of]).astype(np.int32)), none(pa.int32())]),
                    *(pa.concat_arrays([pa.array(h.view(np.int64)), none(pa.int64())]) for h in (core, outer)),
                    pa.concat_arrays([pa.array(held, pa.binary()), none(pa.binary())]),
                    pa.concat_arrays([pa.nulls(len(start), pa.list_(pa.int32())), pa.array(spans, pa.list_(pa.int32()))]),
                ],
                ["doc", "row", "at", "core", "outer", "bytes", "spans"],
            )

    return run


STRINGS = "doc long, row long, h1 long, h2 long, pos int"


def _strings_of(length: int, grain: int, block: int):
    """doc, row, at, bytes of parts -> a row per string in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Contexts(length, grain, block)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                data, ends = _bytes_of(part.column("bytes"))
                starts = np.flatnonzero(inside(ends, len(data), length))
                which = np.searchsorted(ends, starts, side="right")
                h1, h2 = tool.hashes(data, starts)
                pos = starts - np.append(0, ends)[which] + part.column("at").to_numpy()[which]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(part.column(x).to_numpy()[which]) for x in ROW), *(pa.array(h.view(np.int64)) for h in (h1, h2)), pa.array(pos.astype(np.int32))], ["doc", "row", "h1", "h2", "pos"]
                )

    return run


def _cut(length: int):
    """doc, row, text, spans, places (starts of strings) -> n_bytes, n_removed, n_spans, kept_sha256, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, places in zip(*(batch.column(x).to_pylist() for x in ("text", "spans", "places")), strict=True):
                pairs, at = np.array(spans or [], dtype=np.int64).reshape(-1, 2), np.array(places or [], dtype=np.int64)
                starts, ends = merged(np.append(pairs[:, 0], at), np.append(pairs[:, 1], at + length))
                kept, before = [], 0
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    kept.append(text[before:a])
                    before = b
                left = b"".join([*kept, text[before:]])
                out.append((len(text), len(text) - len(left), len(starts), hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    return run


class SuffixIndex:
    """The levels: each a table of beginnings (g; c and doc, its only context and the first holder of that, or nulls if it has several) and one of the
    contexts of those that have several (g, c), bucketed and sorted by these hashes, in a new folder of the shared one. An index
    lives as long as its session; drop() removes it."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, grain: int = GRAIN, block: int = BLOCK) -> None:
        self.spark, self.length, self.grain, self.block = spark, length, grain, block
        self.path = f"{shared_dir(spark).rstrip('/')}/op12-index-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str, str]] = []
        small_batches(spark)

    def _write(self, rows: DataFrame, *key: str) -> str:
        name = f"op12_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, *key).sortWithinPartitions(*key)
        dealt.write.bucketBy(self.buckets, *key).sortBy(*key).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            common.remove(self.spark, f"{self.path}/{name}")

    def suffixes(self, docs: DataFrame) -> DataFrame:
        """The suffixes of documents (doc, row, text as binary), written."""
        return stash(docs.mapInArrow(_suffixes(self.length, self.grain, self.block), SUFFIXES), "op12-suffixes")

    def add(self, suffixes: DataFrame, last: bool = False) -> DataFrame:
        """Scans the suffixes of a batch, whose documents come after all that are there, along with the levels and adds them, unless it is
        the last batch. Gives doc, c, known: contexts that an earlier document has, and opened ones, old documents' too; some more than once.

        A beginning that stands alone, as most do, takes part in one aggregate and becomes a row of the level. Only suffixes whose beginning is
        repeated go on to have their contexts compared."""
        own = suffixes.filter("g is not null").select("doc", "g", "c")
        starts = own.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("c"), F.min("doc").alias("doc"))
        seen, held = F.lit(False), F.array().cast(HELD)
        for k, (_, _, level) in enumerate(self.levels):
            row = self.spark.table(level).select(F.col("g").alias(f"g{k}"), F.col("c").alias(f"c{k}"), F.col("doc").alias(f"doc{k}"))
            starts = starts.join(row.hint("merge"), starts["g"] == F.col(f"g{k}"), "left")
            seen = seen | F.col(f"g{k}").isNotNull()
            held = F.when(F.col(f"c{k}").isNotNull(), F.array(F.struct(F.col(f"c{k}").alias("c"), F.col(f"doc{k}").alias("doc")))).otherwise(held)
        starts = stash(starts.select("g", "n", "c", "doc", seen.alias("seen"), held.alias("held")), "op12-starts")
        alone = starts.filter("n = 1 and not seen").select("g", "c", "doc")
        some = stash(own.join(starts.filter("n > 1 or seen").select("g", "seen", "held"), "g"), "op12-some")
        contexts = some.groupBy("g", "c").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("seen").alias("seen"), F.max(F.get("held", F.lit(0))["c"]).alias("only_c"), F.max(F.get("held", F.lit(0))["doc"]).alias("only_doc"))
        old = F.coalesce(F.col("c") == F.col("only_c"), F.lit(False))
        for k, (_, level, _) in enumerate(self.levels):
            row = self.spark.table(level).select(F.col("g").alias(f"g{k}"), F.col("c").alias(f"c{k}"))
            contexts = contexts.join(row.hint("merge"), (contexts["g"] == F.col(f"g{k}")) & (contexts["c"] == F.col(f"c{k}")), "left")
            old = old | F.col(f"g{k}").isNotNull()
        contexts = stash(contexts.select("g", "c", "first", "last", "seen", "only_c", "only_doc", old.alias("old")), "op12-contexts")
        again = contexts.filter("old or last > first").select("g", "c", F.when(~F.col("old"), F.col("first")).alias("first"))
        known = some.select("doc", "g", "c").join(again, ["g", "c"]).filter("first is null or doc > first").select("doc", "c", F.lit(True).alias("known"))
        new = contexts.filter("not old")
        kinds = stash(new.groupBy("g").agg(F.count("*").alias("kinds"), F.min("c").alias("c"), F.min("first").alias("doc"), F.max("seen").alias("seen"), F.max("only_c").alias("only_c"), F.max("only_doc").alias("only_doc")), "op12-kinds")
        differ = kinds.filter("kinds > 1 or seen")
        opened = stash(new.join(differ.select("g"), "g").select("g", "c", "first"), "op12-opened")
        reopened = differ.filter("only_c is not null").select(F.col("only_doc").alias("doc"), F.col("only_c").alias("c"), F.lit(False).alias("known"))
        hits = stash(known.unionByName(opened.select(F.col("first").alias("doc"), "c", F.lit(False).alias("known"))).unionByName(reopened), "op12-hits")
        if not last:
            fresh = kinds.filter("not seen")
            several = fresh.select("g", F.when(F.col("kinds") == 1, F.col("c")).alias("c"), F.when(F.col("kinds") == 1, F.col("doc")).alias("doc"))
            self._grow(opened.select("g", "c"), alone.unionByName(several))
        common.drop_some(self.spark, [starts, some, contexts, kinds, opened])
        return hits

    def _grow(self, contexts: DataFrame, starts: DataFrame) -> None:
        self.levels.append((1, self._write(contexts, "g", "c"), self._write(starts, "g")))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, *a), (_, *b) = self.levels[-2:]
            both = [self._write(self.spark.table(x).unionByName(self.spark.table(y)), *key) for x, y, key in zip(a, b, (("g", "c"), ("g",)), strict=True)]
            self.levels[-2:] = [(2 * size, *both)]
            self._drop(*a, *b)

    def drop(self) -> None:
        for _, a, b in self.levels:
            self._drop(a, b)
        self.levels = []
        common.remove(self.spark, self.path)


def _few(ids: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys, marked for broadcast if they are at most BROADCAST_IDS."""
    ids = stash(ids.select(*keys).distinct(), "op12-ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def long_matches(docs: DataFrame, hits: DataFrame, index: SuffixIndex) -> DataFrame:
    """doc, row, spans, pos: spans that earlier documents have, and places of strings that they have."""
    tool = (index.length, index.grain, index.block)
    asked = hits.groupBy("doc").agg(F.collect_set(F.when(F.col("known"), F.col("c"))).alias("known"), F.collect_set(F.when(~F.col("known"), F.col("c"))).alias("opened"))
    texts = docs.join(_few(hits, ["doc"]), "doc", "left_semi").join(asked, "doc")
    step = max(1, min(STEP, index.grain))
    found = stash(texts.select(*ROW, "text", "known", "opened").mapInArrow(_opened(*tool, step), BLOCKS), "op12-opened")
    # parts are judged as contexts were: what an earlier document has is known, what only begins alike is opened
    parts, key = found.filter("at is not null"), ["core", "outer"]
    firsts = stash(parts.groupBy(*key).agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "op12-parts")
    alike = firsts.groupBy("core").agg(F.min("outer").alias("lo"), F.max("outer").alias("hi")).filter("lo < hi").select("core")
    known = parts.select(*ROW, *key, "at", F.octet_length("bytes").alias("size")).join(firsts.filter("last > first"), key).filter("doc > first")
    known = known.select(*ROW, F.array("at", F.col("at") + F.col("size")).alias("spans"), F.lit(None).cast("int").alias("pos"))
    opened = stash(firsts.join(alike, "core").select(*key, "first"), "op12-opened-parts")
    strings = parts.join(opened, key).filter("doc = first").select(*ROW, "at", "bytes").mapInArrow(_strings_of(*tool), STRINGS)
    strings = stash(strings, "op12-strings")
    twice = strings.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("h1", "h2", "lo")
    later = strings.join(stash(twice, "op12-twice"), ["h1", "h2"]).filter("doc > lo").select(*ROW, F.lit(None).cast("array<int>").alias("spans"), "pos")
    return later.unionByName(known).unionByName(found.filter("spans is not null").select(*ROW, "spans", F.lit(None).cast("int").alias("pos")))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN, batches: int = BATCHES, block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) where bytes went (else null: unchanged)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    state = stash(rows.select(*ROW, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "op12-state")
    sound = state.filter((F.col("doc").isNotNull()) & (F.col("n_bytes") >= length))
    first = stash(sound.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("hi")).filter("first < hi").select("sha", "first"), "op12-first")
    copies = _few(sound.join(first, "sha").filter("doc > first"), ROW)
    own = rows.filter(F.col("doc").isNotNull() & (F.octet_length("text") >= length)).join(copies, ROW, "left_anti")
    bounds = sound.approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(x) for x in bounds}), None]
    index = SuffixIndex(spark, length, grain, block)
    hits, selves = [], []
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        part = own if low is None else own.filter(F.col("doc") > low)
        part = part if high is None else part.filter(F.col("doc") <= high)
        suffixes = index.suffixes(part)
        hits.append(index.add(suffixes, last=k == len(edges) - 2))
        selves.append(stash(suffixes.filter("spans is not null").select(*ROW, "spans"), "op12-selves"))
        common.drop_some(spark, [suffixes])
    index.drop()
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    found = long_matches(own, union(hits), index).unionByName(union(selves).withColumn("pos", F.lit(None).cast("int")))
    gone = stash(found.groupBy(*ROW).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.collect_list("pos").alias("places")), "op12-gone")
    cut = own.join(_few(gone, ROW), ROW, "left_semi").join(gone, ROW).select("doc", "text", "spans", "places")
    cut = cut.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    touched = gone.select(*ROW, F.lit(True).alias("touched"))
    kept = state.join(touched, ROW, "left").join(first, "sha", "left").filter("touched is null")
    copy = F.coalesce((F.col("doc") > F.col("first")) & (F.col("n_bytes") >= length), F.lit(False))
    whole = kept.select(
        F.col("doc").alias("doc_id"), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"), copy.cast("long").alias("n_spans"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.col("sha")).alias("kept_sha256"), F.when(copy, F.lit("").cast("binary")).alias("kept"),
    )
    return whole.unionByName(cut)
