"""Approximate nearest neighbours by stable projections and kd-trees.

Unit vectors are projected to a few dimensions by a Gaussian (2-stable) matrix, in which a squared projected
distance is the squared distance times a chi-square variable. The projected space is cut into cells by a kd-tree
whose planes come from a bounded sample; every row goes to its cell, and a cell's rows (dealt into parts where they
are many) are indexed by a kd-tree of small leaves.

A query first asks its own cell, which bounds how far its neighbours can be. From then on its projected neighbours
are taken cell by cell and leaf by leaf, nearest first, their cosines are verified on the original vectors, and the
search stops when the chi-square distribution says that a nearer vector would have been met by now with the wanted
probability. Cells beyond that radius are never asked.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm._common import erased, written

#: Rows of a part, queries of a block, rows of a leaf; projected dimensions; probability of the stopping test.
PART, QUERIES, LEAF, DIMENSIONS, SURE = 16_384, 1024, 32, 8, 0.95
#: Rows that the planes of cells are fitted on, about; cells of one length of vectors, at most.
SAMPLE, CELLS = 65_536, 65_536
#: Leaves whose rows are verified at once: that many at first, then twice as many each time, up to the second number.
STEP, MOST = 16, 256


def chi_square_cdf(x: float, m: int) -> float:
    """For an even number m of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1.0 - math.exp(-x / 2) * total if x < 1400 else 1.0


def chi_square_quantile(sure: float, m: int) -> float:
    """The x whose chi_square_cdf is ``sure``; where a squared projected distance is x times the k-th squared distance, the test holds."""
    low, high = 0.0, 1400.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, m) < sure else (low, middle)
    return high


def projection(dim: int, m: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


def projected(vectors: np.ndarray, m: int = DIMENSIONS) -> np.ndarray:
    """Projections of the vectors' directions."""
    wide = vectors.astype(np.float64)
    return (wide / np.sqrt((wide * wide).sum(axis=1))[:, None]) @ projection(vectors.shape[1], m)


class Planes:
    """Cells of the projected space: a balanced tree of axes and cuts in heap order, fitted on points."""

    def __init__(self, points: np.ndarray, cells: int):
        self.depth = max(0, math.ceil(math.log2(max(1, cells))))
        self.axis, self.cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        sets = {1: points}
        for node in range(1, 1 << self.depth):
            rows = sets.pop(node)
            if len(rows):
                self.axis[node] = np.argmax(np.ptp(rows, axis=0))
                self.cut[node] = np.median(rows[:, self.axis[node]])
            right = rows[:, self.axis[node]] > self.cut[node]
            sets[2 * node], sets[2 * node + 1] = rows[~right], rows[right]
        m = points.shape[1]
        low, high = np.full((2 << self.depth, m), -np.inf), np.full((2 << self.depth, m), np.inf)
        for node in range(1, 1 << self.depth):
            for child, side in ((2 * node, high), (2 * node + 1, low)):
                low[child], high[child] = low[node], high[node]
                side[child, self.axis[node]] = self.cut[node]
        self.low, self.high = low[1 << self.depth :], high[1 << self.depth :]

    def cell(self, points: np.ndarray) -> np.ndarray:
        at = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + (points[np.arange(len(points)), self.axis[at]] > self.cut[at])
        return at - (1 << self.depth)

    def within(self, point: np.ndarray, radius: float) -> np.ndarray:
        """Cells that come as near as the squared radius."""
        return np.flatnonzero(_bounds(self.low, self.high, point) <= radius)


def _bounds(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances from a point to boxes."""
    apart = np.maximum(0, np.maximum(low - point, point - high))
    return (apart * apart).sum(axis=1)


class Tree:
    """A kd-tree's leaves: rows of vectors with boxes of their projections. ``opened`` and ``verified`` count leaves and rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, m: int = DIMENSIONS, leaf: int = LEAF):
        # of equal vectors, more than k + 1 ids can't be among anyone's k nearest: ties go to smaller ids
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        repeated = np.zeros(len(ids), dtype=bool)
        repeated[1:] = ~new[1:] & (ids[1:] == ids[:-1])
        ids, vectors, new = ids[~repeated], vectors[~repeated], new[~repeated]
        first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        keep = np.arange(len(ids)) - first <= k
        ids, vectors = ids[keep], vectors[keep]
        points = projected(vectors, m)
        parts, leaves = [np.arange(len(ids))], []
        while parts:
            rows = parts.pop()
            if len(rows) <= leaf:
                leaves.append(rows)
                continue
            axis = np.argmax(np.ptp(points[rows], axis=0))
            rows = rows[np.argpartition(points[rows, axis], len(rows) // 2)]
            parts += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
        at = np.concatenate(leaves)
        self.ids, self.vectors, self.points, self.m = ids[at], vectors[at], points[at], m
        self.cuts = np.cumsum([0, *map(len, leaves)])
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])
        wide = self.vectors.astype(np.float64)
        self.norms = np.sqrt((wide * wide).sum(axis=1))
        self.opened = self.verified = 0

    def nearest(self, query_id: int, vector: np.ndarray, k: int, sure: float = SURE, far: float = math.inf) -> list[tuple[float, int]]:
        """(cosine, id) of the k nearest found, nearest first, ties to smaller ids; far: a squared distance that all k are known to be within."""
        wide = vector.astype(np.float64)
        norm = math.sqrt((wide * wide).sum())
        point = (wide / norm) @ projection(len(wide), self.m)
        bounds, enough = _bounds(self.low, self.high, point), chi_square_quantile(sure, self.m)
        order = np.argsort(bounds, kind="stable")
        narrow = vector.astype(self.vectors.dtype)
        best: dict[int, float] = {}
        ranked: list[tuple[float, int]] = []
        lo, step = 0, STEP
        while lo < len(order):
            radius = far * enough + 1e-9
            leaves = [x for x in order[lo : lo + step] if bounds[x] <= radius]
            if not leaves:
                break
            lo, step = lo + step, min(2 * step, MOST)
            rows = np.concatenate([np.arange(self.cuts[x], self.cuts[x + 1]) for x in leaves])
            gap = self.points[rows] - point
            rows = rows[((gap * gap).sum(axis=1) <= radius) & (self.ids[rows] != query_id)]
            self.opened += len(leaves)
            self.verified += len(rows)
            if len(ranked) == k:
                # a quick product rules most out; those that it leaves get the exact score, the same for equal vectors
                with np.errstate(all="ignore"):
                    about = self.vectors[rows] @ narrow / (self.norms[rows] * norm)
                rows = rows[(about >= ranked[-1][0] - 1e-4) | ~np.isfinite(about)]
            scores = (self.vectors[rows] * wide).sum(axis=1) / (self.norms[rows] * norm)
            ids = self.ids[rows]
            if len(ranked) == k:
                good = scores >= ranked[-1][0]
                scores, ids = scores[good], ids[good]
            # an id may have several vectors: its best counts
            for n, s in zip(ids.tolist(), scores.tolist(), strict=True):
                best[n] = max(s, best.get(n, -2.0))
            ranked = sorted(((s, n) for n, s in best.items()), key=lambda x: (-x[0], x[1]))[:k]
            best = {n: s for s, n in ranked}
            if len(ranked) == k:
                far = min(far, max(0.0, 2 - 2 * ranked[-1][0]))
        return ranked


def usable(vector: str) -> Column:
    """Neither null nor zero, and every component finite."""
    return F.expr(f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND abs(x) < double('infinity')) AND exists({vector}, x -> x <> 0)")


def evened(rows: DataFrame) -> DataFrame:
    """rows whose vectors of doubles are scaled by a power of two, their largest component near 1, so that no square
    overflows or vanishes; cosines stay as they are, to the last bit. Squares of floats need none of it."""
    if rows.schema["embedding"].dataType.simpleString() != "array<double>":
        return rows
    power = "cast(-floor(log2(array_max(transform(embedding, x -> abs(x))))) AS int)"
    # in two steps, as the whole power may be no double
    scaled = f"transform(array({power}), e -> transform(embedding, x -> x * pow(2d, e div 2) * pow(2d, e - e div 2)))[0]"
    return rows.withColumn("embedding", F.expr(scaled))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, vectors) of each length of vectors in a batch."""
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, _matrix(batch["embedding"].take(pa.array(at)))


def _fitted(rows: DataFrame, n: int, cells: int) -> dict[int, Planes]:
    """Planes for each length of vectors, from a sample of about SAMPLE rows."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, vectors in _by_length(batch):
                points = projected(vectors)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), dim, np.int32)), pa.array(list(points), pa.list_(pa.float64()))], ["dim", "point"])

    share = min(1.0, SAMPLE / max(1, n))
    sample = (rows if share == 1.0 else rows.sample(share, seed=17)).select("dim", "embedding").mapInArrow(project, "dim int, point array<double>").toArrow()
    dims, points = sample["dim"].to_numpy(), sample["point"].combine_chunks()
    return {int(d): Planes(_matrix(points.take(pa.array(np.flatnonzero(dims == d)))), cells) for d in np.unique(dims)}


def _placed(rows: DataFrame, planes) -> DataFrame:
    """rows (vec_id, dim, embedding) with their cells; vectors of a length that the sample had none of are one cell."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for dim, at, vectors in _by_length(batch):
                if dim in planes.value:
                    cell[at] = planes.value[dim].cell(projected(vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("vec_id", "dim", "embedding").mapInArrow(place, f"vec_id long, dim int, embedding {kind}, cell int")


def _packed(rows: DataFrame, keys: list[str], lists: list[str], make: Callable) -> DataFrame:
    """(keys, blob): what make gives for the arrays of a group's lists, pickled."""
    grouped = rows.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in lists])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = [batch[c].slice(i, 1).flatten() for c in lists]
                arrays = [_matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in columns]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, 1) for c in keys), pa.array([pickle.dumps(make(*arrays))], pa.binary())], [*keys, "blob"])

    return grouped.mapInArrow(build, ", ".join(f"{c} int" for c in keys) + ", blob binary")


def _searched(trees: DataFrame, asked: DataFrame, on: list[str], k: int, sure: float) -> DataFrame:
    """(query_id, vec_id, score): for every block of queries the k nearest in each part that it is joined with."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, block in zip(batch["blob"], batch["asked"], strict=True):
                tree, (ids, points, far) = pickle.loads(blob.as_py()), pickle.loads(block.as_py())
                got = [(q, v, s) for q, point, f in zip(ids.tolist(), points, far.tolist(), strict=True) for s, v in tree.nearest(q, point, k, sure, f)]
                columns = list(zip(*got, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    pairs = trees.join(asked.withColumnRenamed("blob", "asked"), on).select("blob", "asked")
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, sure: float = SURE) -> DataFrame:
    """The k nearest vectors by cosine of each row whose vec_id is divisible by ``every``, among all other rows.

    vectors has vec_id and embedding. Returns query_id, rank (from 1), vec_id and score; ties go to smaller
    vec_id. Vectors that are null, zero or hold a null or non-finite component take no part, as do rows without
    vec_id; vectors of another length are never neighbours. Components of any finite size count, as vectors of doubles are
    scaled first. Rows with the query's own vec_id are its own; of rows
    with the same vec_id the one with the least vector asks, and as neighbours they count once, by their best score. A
    query without candidates has no row; an empty table gives none; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable("embedding"))
    rows = rows.withColumn("dim", F.size("embedding"))
    n = rows.count()
    even = evened(rows)
    planes = spark.sparkContext.broadcast(_fitted(even, n, min(CELLS, -(-n // PART))))
    placed = _placed(even, planes)
    # a row for each cell: there are CELLS of each length at most
    sizes = written(placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "cells")
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(11)), F.col("parts")).cast("int").alias("part")
    # dealt by place, as one vec_id may have many rows
    dealt = placed.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(sizes), ["dim", "cell"]).select("dim", "cell", part("row"), "vec_id", "embedding")
    trees = written(_packed(dealt, ["dim", "cell", "part"], ["vec_id", "embedding"], lambda ids, v: Tree(ids, v, k)), "trees")
    least = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "embedding")).alias("v")).select("vec_id", "v.*")
    asking = _placed(evened(least), planes)
    asking = written(asking.withColumnRenamed("vec_id", "query_id"), "asking")

    def in_blocks(queries: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
        """Queries of a cell or part in blocks of about QUERIES."""
        queries = written(queries, f"asked-{name}")
        blocks = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
        dealt = queries.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(12)), F.col("blocks")).cast("int"))
        return queries, _packed(dealt, [*keys, "block"], ["query_id", "embedding", "far"], lambda ids, v, far: (ids, v, far))

    at_home = asking.join(F.broadcast(sizes), ["dim", "cell"]).select("dim", "cell", part("query_id"), "query_id", "embedding", F.lit(math.inf).alias("far"))
    spent, blocks = in_blocks(at_home, ["dim", "cell", "part"], "home")
    first = _searched(trees, blocks, ["dim", "cell", "part"], k, sure)
    kth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1))
    within = written(first.groupBy("query_id").agg(F.when(kth.isNotNull(), F.greatest(F.lit(0.0), 2 - 2 * kth)).alias("far")), "within")
    erased(spent)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enough = chi_square_quantile(sure, DIMENSIONS)
        for batch in batches:
            far = batch["far"].to_numpy(zero_copy_only=False)
            for dim, at, points in _by_length(batch):
                if dim in planes.value:
                    radius = far[at] * enough + 1e-9
                    cells = [planes.value[dim].within(p, r) for p, r in zip(projected(points), radius, strict=True)]
                else:
                    cells = [np.zeros(1, np.int64)] * len(at)
                some = batch.take(pa.array(np.repeat(at, list(map(len, cells)))))
                yield some.append_column("cell", pa.array(np.concatenate(cells).astype(np.int32)))

    kind = rows.schema["embedding"].dataType.simpleString()
    bounded = asking.drop("cell").join(within, "query_id", "left").select("query_id", "dim", "embedding", F.coalesce("far", F.lit(math.inf)).alias("far"))
    reached = bounded.mapInArrow(reach, f"query_id long, dim int, embedding {kind}, far double, cell int")
    _, blocks = in_blocks(reached, ["dim", "cell"], "reached")
    found = _searched(trees, blocks, ["dim", "cell"], k, sure)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
