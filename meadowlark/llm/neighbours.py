"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected onto DIMENSIONS Gaussian directions. Squared projected distance over
squared true distance then follows a chi-square law with as many degrees of freedom, so a
neighbour at distance d is rarely projected beyond ``d * sqrt(quantile)``. Each block of
vectors gets a kd-tree over its projections; a query visits leaves in order of projected
distance, computes true distances in double precision, and stops at the first leaf that is
too far for its current k-th distance at the given CONFIDENCE. Every vector is indexed.

Vectors are dealt into cells of projected space, by a coarse kd-tree over a bounded sample; a
cell of more than BLOCK vectors has parts by the hash of the id. A query first searches the cell
it lies in. Its k-th distance then closes, by the same test, all cells whose box is too far, and
it searches the others. So every vector is shuffled once in each of the two rounds, a query once
for a cell it enters; a group is of bounded size, and only k rows per query leave it.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite number
takes no part, nor does a row without id; vectors of different length are not compared; a
query is not its own neighbour, nor are rows with its id; ties go to the smaller id. With
fewer candidates than k all are returned; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meadowlark.llm.batches import written
from meadowlark.scale import top_per

DIMENSIONS = 8  # even
CONFIDENCE = 0.99
LEAF = 64
BLOCK = 16_384  # vectors of a group
SAMPLE = 65_536  # vectors from which cells are cut
CELLS = 4096  # at most
SEED = 20_240_601


def chi_square_quantile(p: float, degrees: int) -> float:
    """x with P(chi-square < x) = p, for an even number of degrees."""
    def below(x):
        term, total = 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Leaves:
    """A kd-tree's leaves: ``order`` holds them one after the other, with a box around each."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order, cuts, stack = np.arange(len(points)), [], [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                cuts.append((a, b))
                continue
            mine = points[self.order[a:b]]
            axis, mid = int(np.argmax(np.ptp(mine, axis=0))), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(mine[:, axis], mid)]
            stack += [(a, a + mid), (a + mid, b)]
        self.begin, self.end = np.array(sorted(cuts), np.int64).reshape(-1, 2).T
        held = points[self.order]
        self.low = np.minimum.reduceat(held, self.begin) if len(points) else held
        self.high = np.maximum.reduceat(held, self.begin) if len(points) else held


def search_block(ids, vectors, query_ids, queries, k: int, confidence: float = CONFIDENCE, leaf: int = LEAF):
    """The k nearest of ``vectors`` found for each query: distances and ids, padded with inf and -1."""
    far = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, np.int64)
    if not len(ids) or not len(queries):
        return far
    directions = projections(vectors.shape[1])
    tree = Leaves(vectors @ directions, leaf)
    ids, vectors = ids[tree.order], vectors[tree.order]
    limit = chi_square_quantile(confidence, DIMENSIONS)
    width = int((tree.end - tree.begin).max())
    for a in range(0, len(queries), 256):
        q, own = queries[a: a + 256], query_ids[a: a + 256]
        near = q @ directions
        gap = np.zeros((len(q), len(tree.begin)))
        for j in range(DIMENSIONS):
            x = near[:, j, None]
            gap += np.maximum(np.maximum(tree.low[:, j] - x, x - tree.high[:, j]), 0) ** 2
        visit = np.argsort(gap, 1, kind="stable")
        gap = np.take_along_axis(gap, visit, 1)
        best, who = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
        active = np.arange(len(q))
        for t in range(visit.shape[1]):
            kth = best[active, -1]
            with np.errstate(invalid="ignore"):
                active = active[~((gap[active, t] > kth * limit) & np.isfinite(kth))]  # the stopping test
            if not len(active):
                break
            at = tree.begin[visit[active, t]][:, None] + np.arange(width)
            real = at < tree.end[visit[active, t]][:, None]
            at = np.minimum(at, len(ids) - 1)
            d = ((vectors[at] - q[active, None, :]) ** 2).sum(-1)
            d[~real | (ids[at] == own[active, None])] = np.inf
            d, found = np.concatenate([best[active], d], 1), np.concatenate([who[active], ids[at]], 1)
            by_id = np.argsort(found, 1, kind="stable")
            d, found = np.take_along_axis(d, by_id, 1), np.take_along_axis(found, by_id, 1)
            first = np.argsort(d, 1, kind="stable")[:, :k]
            best[active], who[active] = np.take_along_axis(d, first, 1), np.take_along_axis(found, first, 1)
        far[0][a: a + 256], far[1][a: a + 256] = np.sqrt(best), who
    return far


def projections(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, DIMENSIONS))


class Cells:
    """A coarse kd-tree: nested cuts of projected space, and the box of each cell."""

    def __init__(self, points: np.ndarray, count: int):
        self.low, self.high = [np.full(DIMENSIONS, -np.inf)], [np.full(DIMENSIONS, np.inf)]
        self.cuts: list[tuple[int, int, float, int]] = []  # of cell, along an axis at a value, the upper part as cell
        own = np.zeros(len(points), np.int64)
        while len(self.low) < count and len(points):
            sizes = np.bincount(own, minlength=len(self.low))
            cell = int(sizes.argmax())
            mine = np.flatnonzero(own == cell)
            spread = np.ptp(points[mine], axis=0)
            axis = int(spread.argmax())
            if len(mine) < 2 or not spread[axis]:
                break
            at = float(np.median(points[mine, axis]))
            upper = points[mine, axis] > at
            if not upper.any():
                at = float(points[mine, axis][points[mine, axis] < at].max())
                upper = points[mine, axis] > at
            self.cuts.append((cell, axis, at, len(self.low)))
            own[mine[upper]] = len(self.low)
            self.low.append(self.low[cell].copy())
            self.high.append(self.high[cell].copy())
            self.low[-1][axis] = self.high[cell][axis] = at
        self.low, self.high = np.array(self.low), np.array(self.high)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), np.int64)
        members = {0: np.arange(len(points))}
        for cell, axis, at, upper in self.cuts:
            mine = members[cell]
            above = points[mine, axis] > at
            members[upper], members[cell] = mine[above], mine[~above]
            out[mine[above]] = upper
        return out

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance of a point to every cell."""
        return (np.maximum(np.maximum(self.low - point, point - self.high), 0) ** 2).sum(1)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, n) of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"), F.size(v).alias("n")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
            confidence: float = CONFIDENCE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` found for each row of ``queries``."""
    spark = vectors.sparkSession
    all_v, all_q = usable(vectors, key, vector), written(usable(queries, key, vector), "queries")
    total = all_v.count()
    picked = all_v.select("v", "n", "id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(SAMPLE).toArrow()
    # two cells a core at least; vectors of a length that the sample lacks are few and share a cell
    count = min(CELLS, max(math.ceil(2 * total / block), 2 * spark.sparkContext.defaultParallelism))
    lengths = picked["n"].to_numpy()
    trees = {}
    for width in np.unique(lengths).tolist():
        some = picked.filter(pa.array(lengths == width))
        trees[width] = Cells(_matrix(some["v"]) @ projections(width), max(1, math.ceil(count * len(some) / len(picked))))
    held = spark.sparkContext.broadcast(trees)
    limit = chi_square_quantile(confidence, DIMENSIONS)

    def by_length(v: pa.Array, n: pa.Array):
        sizes = n.to_numpy(zero_copy_only=False)
        for width in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == width)
            yield rows, _matrix(v.take(pa.array(rows))) @ projections(width), held.value.get(width)

    @F.arrow_udf("int")
    def home(v: pa.Array, n: pa.Array) -> pa.Array:
        out = np.zeros(len(v), np.int32)
        for rows, points, tree in by_length(v, n):
            out[rows] = tree.of(points) if tree else 0
        return pa.array(out)

    @F.arrow_udf("array<int>")
    def others(v: pa.Array, n: pa.Array, own: pa.Array, kth: pa.Array) -> pa.Array:
        """The cells that the test leaves open; all if there are fewer than k neighbours yet."""
        out, cells, far = [[]] * len(v), own.to_numpy(zero_copy_only=False), kth.to_numpy(zero_copy_only=False)
        for rows, points, tree in by_length(v, n):
            for i, point in zip(rows.tolist(), points):
                if tree:
                    gap = tree.gaps(point)
                    open_ = np.ones(len(gap), bool) if np.isnan(far[i]) else gap <= far[i] ** 2 * limit
                    open_[cells[i]] = False
                    out[i] = np.flatnonzero(open_).astype(np.int32)
        return pa.array(out, pa.list_(pa.int32()))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, query_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        score, who = search_block(ids, _matrix(left.column("v")), query_ids, _matrix(right.column("v")), k, confidence)
        row, place = np.nonzero(np.isfinite(score))
        return pa.table({"query_id": query_ids[row], "vec_id": who[row, place], "score": score[row, place]})

    placed = written(all_v.withColumn("cell", home("v", "n")), "neighbour-cells")
    parts = placed.groupBy("n", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    parts = written(parts, "neighbour-parts")  # one row a cell
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    left = placed.join(parts, ["n", "cell"]).select("id", "v", "n", "cell", part)

    def searched(visits):
        right = visits.join(parts, ["n", "cell"]).select("id", "v", "n", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        right = right.toDF("id", "v", "n", "cell", "part")
        return (left.groupBy("n", "cell", "part").cogroup(right.groupBy("n", "cell", "part"))
                .applyInArrow(search, "query_id long, vec_id long, score double"))

    asked = all_q.withColumn("cell", home("v", "n"))
    first = written(searched(asked), "neighbours-at-home")
    nearest_k = top_per(first, ["query_id"], [F.col("score"), F.col("vec_id")], k)
    kth = nearest_k.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    again = asked.join(kth, "id", "left").select("id", "v", "n", F.explode(others("v", "n", "cell", "kth")).alias("cell"))
    # a query id that occurs in several rows searches for each; equal finds are one
    found = first.unionByName(searched(again)).distinct()
    by_distance = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
