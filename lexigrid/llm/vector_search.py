"""Approximate nearest neighbours by stable projections in a kd-tree, with a chi-square stopping test.

Vectors are projected by Gaussian (2-stable) directions to a few dimensions, where the squared distance of two
points is their true squared distance times a chi-square variable. A kd-tree over the projected points yields them
in the order of projected distance, a leaf at a time; each is verified by its inner product with the query in
double precision. The search of a query stops when a point that is nearer than its k-th best so far would have
shown up by now with probability `sure`. Largest inner product becomes least distance by one more
coordinate that brings all vectors to one length.

The top of the tree is one for the whole table: its splits come from a sample of at most SAMPLE projected rows, and all rows are
placed by it in cells, whose boxes are those of all their rows. A cell holds the lower part of the tree, built where its rows are.
A query first goes to the cells nearest to it, and then, with the k-th best found there, to those cells alone
that the stopping test doesn't rule out. So the index is dealt out once, by cells, and not to every query; where more than
BLOCK_ROWS queries go to a cell, each block of so many gets a copy of it. Cells of more than SHARD_ROWS rows
are searched in parts of that size, so that no task holds more.

Equal vectors are one point of the index, which keeps their k + 1 least ids, and equal queries
are asked once, so that a vector which a third of all rows hold costs no more than another.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as
queries nor as candidates, nor do rows without vec_id; a query only meets vectors of its own length; ties go to the smaller vec_id;
a row is never its own neighbour, and repeated rows of one vec_id count once; with fewer candidates than k all are returned; an empty table
gives an empty one; other columns are not looked at.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.llm.common import stash

#: Rows that a cell has on average, that are searched together at most, and queries that one copy of a cell answers at most.
CELL_ROWS, SHARD_ROWS, BLOCK_ROWS = 8_192, 32_768, 16_384
#: Projected rows that the top of the tree is fitted on, at most; each cell has PER_CELL of them or more.
SAMPLE, PER_CELL = 200_000, 16
#: Cells that a query goes to first.
HOME = 2
#: Dimensions of the projection, probability of the stopping test, points of a leaf, and seed of the directions.
DIMS, SURE, LEAF, SEED = 8, 0.4, 512, 11
#: Candidates beyond the asked ones that a search keeps, for ties and the last bits of a matrix product.
SPARE = 8


def chi_square_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """P(chi-square of an even number of dims <= x): a Poisson tail."""
    half, term, total = x / 2, np.exp(-x / 2), np.zeros_like(x)
    for j in range(dims // 2):
        total += term
        term = term * half / (j + 1)
    return 1 - total


def chi_square_quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if chi_square_cdf(np.array(mid), dims) >= p else (mid, hi)
    return hi


@dataclass
class Space:
    """What all vectors of one length share: their largest squared norm, the top of the tree, and later the cells' boxes.

    A node of the tree is (axis, value, left, right); a leaf is its number as a cell, below zero: -1 - cell."""

    d: int
    most: float
    dims: int = DIMS
    nodes: list | None = None
    boxes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # cells, lo, hi

    def project(self, vectors: np.ndarray, lifted: bool) -> np.ndarray:
        """Points of the index are lifted to one length; queries have 0 as their last coordinate."""
        directions = np.random.default_rng(SEED).standard_normal((self.d + 1, self.dims))
        low = vectors @ directions[:-1]
        if lifted:
            low += np.sqrt(np.maximum(self.most - (vectors * vectors).sum(axis=1), 0))[:, None] * directions[-1]
        return low

    def split(self, sample: np.ndarray, cells: int) -> None:
        """Halves the sample at the median of its widest side until there are so many cells, or PER_CELL rows in each."""
        self.nodes, count = [], 0
        todo = [(np.arange(len(sample)), cells, None)]
        while todo:
            own, want, slot = todo.pop()
            side = sample[own]
            spread = side.max(axis=0) - side.min(axis=0) if len(own) else np.zeros(1)
            axis = int(np.argmax(spread))
            if want < 2 or len(own) < 2 * PER_CELL or not spread[axis]:
                at, count = -1 - count, count + 1
            else:
                value = float(np.median(side[:, axis]))
                left = side[:, axis] < value
                at = len(self.nodes)
                self.nodes.append([axis, value, 0, 0])
                todo += [(own[left], want // 2, (at, 2)), (own[~left], want - want // 2, (at, 3))]
            if slot:
                self.nodes[slot[0]][slot[1]] = at

    def cell_of(self, low: np.ndarray) -> np.ndarray:
        out = np.zeros(len(low), dtype=np.int32)
        todo = [(0 if self.nodes else -1, np.arange(len(low)))]
        while todo:
            at, own = todo.pop()
            if at < 0:
                out[own] = -1 - at
            elif len(own):
                axis, value, left, right = self.nodes[at]
                below = low[own, axis] < value
                todo += [(left, own[below]), (right, own[~below])]
        return out

    def far(self, at: np.ndarray) -> np.ndarray:
        """Squared projected distances of queries from the boxes."""
        return box_distances(at, self.boxes[1], self.boxes[2])


def box_distances(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at), len(lo)))
    for k in range(at.shape[1]):
        x = at[:, k, None]
        gap = np.maximum(np.maximum(lo[None, :, k] - x, x - hi[None, :, k]), 0)
        out += gap * gap
    return out


def _leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Leaves of a kd-tree: halves at the median of the widest side until they are small."""
    todo, out = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        side = points[own]
        axis = int(np.argmax(side.max(axis=0) - side.min(axis=0)))
        half = len(own) // 2
        order = np.argpartition(side[:, axis], half)
        todo += [own[order[:half]], own[order[half:]]]
    return out


class Cell:
    """The lower part of the tree, over the rows of one cell."""

    def __init__(self, vectors: np.ndarray, space: Space, leaf: int = LEAF) -> None:
        low = space.project(vectors, True)
        leaves = _leaves(low, leaf)
        self.space, self.vectors = space, vectors
        self.order = np.concatenate(leaves)
        self.ends = np.cumsum([0] + [len(x) for x in leaves])
        self.sorted = vectors[self.order]
        self.lo = np.array([low[x].min(axis=0) for x in leaves])
        self.hi = np.array([low[x].max(axis=0) for x in leaves])

    def search(self, queries: np.ndarray, k: int, sure: float = SURE, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places of the nearest vectors of each query, -1 where there are none; how many were verified). bound: squared distance
        of the k-th best that is known already. All queries advance together, each in its own order of leaves."""
        n, keep = len(queries), k + SPARE
        far = box_distances(self.space.project(queries, False), self.lo, self.hi)
        turn = np.argsort(far, axis=1, kind="stable")
        base = self.space.most + (queries * queries).sum(axis=1)
        quantile = chi_square_quantile(sure, self.space.dims)
        kth = np.full(n, np.inf) if bound is None else bound.copy()
        best, place, verified = np.full((n, keep), -np.inf), np.full((n, keep), -1), np.zeros(n, dtype=np.int64)
        active = np.arange(n)
        for step in range(far.shape[1]):
            leaf = turn[active, step]
            # the test: a point nearer than the k-th best lies beyond this distance with probability 1 - sure at most
            going = ~(far[active, leaf] >= quantile * np.maximum(kth[active], 0)) | ~np.isfinite(kth[active])
            active, leaf = active[going], leaf[going]
            if not len(active):
                break
            by = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by])) + 1
            for own in np.split(active[by], cuts):
                a, b = self.ends[(x := turn[own[0], step])], self.ends[x + 1]
                scores = np.concatenate([best[own], queries[own] @ self.sorted[a:b].T], axis=1)
                places = np.concatenate([place[own], np.broadcast_to(np.arange(a, b), (len(own), b - a))], axis=1)
                top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                best[own], place[own] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(places, top, axis=1)
                verified[own] += b - a
            reached = np.partition(best[active], keep - k, axis=1)[:, keep - k]
            kth[active] = np.minimum(kth[active], base[active] - 2 * reached)
        return np.where(place >= 0, self.order[place], -1), verified


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column("d").to_numpy()
    for d in np.unique(lengths).tolist():
        yield d, batch.filter(pa.array(lengths == d))


def _place(spaces: dict[int, Space]):
    """d, v, ids -> d, cell, v, ids, low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, own in _by_length(batch):
                space = spaces[d]
                low = space.project(_matrix(own.column("v"), d), True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, low.size + 1, low.shape[1], dtype=np.int32)), pa.array(low.ravel()))
                yield pa.RecordBatch.from_arrays([own.column("d"), pa.array(space.cell_of(low)), own.column("v"), own.column("ids"), lists], ["d", "cell", "v", "ids", "low"])

    return run


def _visits(spaces: dict[int, Space], first: bool, sure: float):
    """q, d, v, kth -> q, d, v, kth, cell: the cells nearest to a query, or all others that the stopping test leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, own in _by_length(batch):
                if d not in spaces:
                    continue
                space = spaces[d]
                together = max(1, 2_000_000 // len(space.boxes[0]))
                for k in range(0, own.num_rows, together):
                    part = own.slice(k, together)
                    far = space.far(space.project(_matrix(part.column("v"), d), False))
                    nearest = np.argpartition(far, min(HOME, far.shape[1]) - 1, axis=1)[:, :HOME]
                    chosen = np.zeros(far.shape, dtype=bool)
                    np.put_along_axis(chosen, nearest, True, axis=1)
                    if not first:
                        kth = part.column("kth").to_numpy(zero_copy_only=False)[:, None]
                        chosen = ~chosen & (~np.isfinite(kth) | (far < chi_square_quantile(sure, space.dims) * np.maximum(kth, 0)))
                    row, cell = np.nonzero(chosen)
                    for j in range(0, len(row), 10_000):
                        taken = part.take(pa.array(row[j : j + 10_000]))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(space.boxes[0][cell[j : j + 10_000]])], ["q", "d", "v", "kth", "cell"])

    return run


def _search(k: int, sure: float, spaces: dict[int, Space]):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if index.num_rows and queries.num_rows:
            d = index["d"][0].as_py()
            cell = Cell(_matrix(index["v"], d), spaces[d])
            asked, names, ids = _matrix(queries["v"], d), queries["q"].to_pylist(), index["ids"].to_pylist()
            for start in range(0, len(asked), 2_048):
                part = asked[start : start + 2_048]
                places, _ = cell.search(part, k, sure, queries["kth"].to_numpy()[start : start + 2_048])
                for q, query, own in zip(names[start : start + 2_048], part, places, strict=True):
                    own = own[own >= 0]
                    scores = np.cumsum(cell.vectors[own] * query, axis=1)[:, -1].tolist()  # term by term, in their order
                    near = sorted((-s, i) for s, p in zip(scores, own.tolist(), strict=True) for i in ids[p])[:k]
                    found += [(q, i, -s) for s, i in near]
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["q", "vec_id", "score"])

    return run


def _sound(vector: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, ok) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """All sound vectors, in cells; `k` neighbours can be asked for at most."""

    def __init__(self, own: DataFrame, k: int, dims: int = DIMS, cell_rows: int = CELL_ROWS) -> None:
        """own: vec_id, v, d."""
        spark = own.sparkSession
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        # a row for each length that vectors have
        stats = own.groupBy("d").agg(F.count("*").alias("n"), F.max(norm).alias("most")).collect()
        self.spaces = {r.d: Space(r.d, r.most, dims) for r in stats}
        self._fit(own, {r.d: r.n for r in stats}, cell_rows)
        few = Window.partitionBy("v").orderBy("vec_id")
        least = own.dropDuplicates(["v", "vec_id"]).withColumn("n", F.row_number().over(few)).filter(F.col("n") <= k + 1)
        points = least.groupBy("d", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        placed = stash(points.mapInArrow(_place(self.spaces), "d int, cell int, v array<double>, ids array<long>, low array<double>"), "op10-cells")
        side = [f(F.get("low", F.lit(i))).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)]
        boxes = placed.groupBy("d", "cell").agg(F.count("*").alias("n"), *side).collect()  # a row for each cell
        for d, space in self.spaces.items():
            rows = sorted((r for r in boxes if r.d == d), key=lambda r: r.cell)
            space.boxes = (np.array([r.cell for r in rows], dtype=np.int32), *(np.array([[r[f"{name}{i}"] for i in range(dims)] for r in rows]).reshape(-1, dims) for name in ("lo", "hi")))
        parts = [(r.d, r.cell, math.ceil(r.n / SHARD_ROWS)) for r in boxes]
        self.n_cells, self.n_rows = len(parts), sum(r.n for r in boxes)
        self.parts = spark.createDataFrame(parts, "d int, cell int, shards int")
        self.rows = placed.drop("low")

    def _fit(self, own: DataFrame, counts: dict[int, int], cell_rows: int) -> None:
        spaces = self.spaces
        cells = {d: min(math.ceil(n / cell_rows), SAMPLE // PER_CELL) for d, n in counts.items()}
        for space in spaces.values():
            space.split(np.zeros((0, space.dims)), 1)
        if max(cells.values(), default=1) < 2:
            return
        total = sum(n for d, n in counts.items() if cells[d] > 1)
        chosen = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(math.ceil(min(1.0, 0.9 * SAMPLE / total) * (1 << 30)))
        large = own.filter(F.col("d").isin([d for d, n in cells.items() if n > 1]) & chosen).select("d", "v", F.array("vec_id").alias("ids"))
        sample = large.mapInArrow(_place(spaces), "d int, cell int, v array<double>, ids array<long>, low array<double>").select("d", "low").limit(SAMPLE).toArrow()
        for d, n in cells.items():
            if n > 1:
                spaces[d].split(_matrix(sample.filter(pc.equal(sample["d"], d))["low"], spaces[d].dims), n)

    def search(self, visits: DataFrame, k: int, sure: float) -> DataFrame:
        """q, vec_id, score of visits (q, d, v, kth, cell). A cell that no query goes to is not read into the exchange."""
        bare = {d: Space(s.d, s.most, s.dims) for d, s in self.spaces.items()}
        asked = visits.groupBy("d", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        plan = F.broadcast(stash(asked.join(self.parts, ["d", "cell"]), "op10-plan"))  # a row for each cell
        deal = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        index = self.rows.join(plan, ["d", "cell"]).withColumn("shard", deal("v", "shards", 1)).withColumn("block", every("blocks")).drop("shards", "blocks")
        queries = visits.join(plan, ["d", "cell"]).withColumn("block", deal("q", "blocks", 2)).withColumn("shard", every("shards")).drop("shards", "blocks")
        key = ["d", "cell", "shard", "block"]
        return index.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(_search(k, sure, bare), "q long, vec_id long, score double")

    def nearest(self, queries: DataFrame, k: int, sure: float = SURE) -> DataFrame:
        """q, vec_id, score: the k best of queries (q, d, v), and some more."""
        schema = "q long, d int, v array<double>, kth double, cell int"
        self.visited = home = stash(queries.withColumn("kth", F.lit(float("inf"))).mapInArrow(_visits(self.spaces, True, sure), schema), "op10-home")
        hits = self.search(home, k, sure)
        if all(len(s.boxes[0]) <= HOME for s in self.spaces.values()):
            return hits
        hits = stash(hits, "op10-hits")
        # the k-th best so far, as a squared distance of the lifted vectors
        by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        kth = hits.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k).groupBy("q").agg(F.count("*").alias("found"), F.min("score").alias("least"))
        most = F.create_map(*[x for d, s in self.spaces.items() for x in (F.lit(d), F.lit(s.most))])
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        bound = F.when(F.col("found") == k, F.try_element_at(most, F.col("d")) + norm - 2 * F.col("least")).otherwise(F.lit(float("inf")))
        rest = queries.join(kth, "q", "left").select("q", "d", "v", F.coalesce(bound, F.lit(float("inf"))).alias("kth"))
        others = stash(rest.mapInArrow(_visits(self.spaces, False, sure), schema), "op10-others")
        self.visited = home.unionByName(others)
        return hits.unionByName(self.search(others, k, sure))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, dims: int = DIMS, sure: float = SURE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query (on vec_id) holds for, its k nearest other rows by inner product."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    own = own.filter(F.col("vec_id").isNotNull() & _sound(F.col("v"))).withColumn("d", F.size("v"))
    index = Index(own, k, dims, cell_rows)
    asked = own.filter(is_query)
    unique = stash(asked.groupBy("d", "v").agg(F.min("vec_id").alias("q")), "op10-queries")
    hits = index.nearest(unique.select("q", "d", "v"), k + 1, sure)
    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = hits.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1)
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("hits"))
    rows = asked.select("vec_id", "v").distinct().join(unique.select("v", "q"), "v").join(lists, "q")
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("vec_id")), 1, k)
    return (
        rows.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
    )
