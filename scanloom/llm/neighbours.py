"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected by Gaussian (2-stable) directions to ``DIMS`` dimensions.  A tree of
median splits, fitted on a bounded sample of the projections (``SAMPLE`` rows, ``CELLS``
leaves at most), deals every row to a cell of the projected space; a cell of over
``BLOCK_ROWS`` rows is split by a hash.  A task reads one such block, builds a kd-tree over
its projections and answers the queries that follow it in its sorted input, one batch
after another.

A query takes a block's rows in the order of projected distance: the tree's leaves within
the present radius give their rows, and the nearest rows are verified first, by their inner
product with the original vectors.  The chi-square test stops it: the squared projected
distance of a row over its squared distance is chi-square with DIMS degrees of freedom, so
that a row as near as the k-th best found lies within that distance times the ``SURE``
quantile with probability SURE, and rows beyond that radius are not looked at.  A query
searches its own cell first; with the radius that this gives, it visits only those other
cells that the radius reaches.

The largest inner product is the least distance once each vector has a further component
that brings all to the same norm.

Every row is indexed.  Vectors that are null, zero, of another length than the most common
one, or that hold null or non-finite components take no part; of rows that share a vec_id
the least vector counts.  Equal vectors under different ids are all candidates; ties go to
the smaller vec_id.  With fewer than k candidates a query gets all of them.  An empty table
gives an empty one; columns other than ``vec_id`` and ``embedding`` stay unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.lineage import cut, drop

DIMS = 24
SURE = 0.85
LEAF = 64
BLOCK_ROWS = 8192
#: Rows of the sample that the cells are fitted on, and the most cells.
SAMPLE = 1 << 16
CELLS = 1024
#: Queries that meet one copy of a block.
PART_QUERIES = 1 << 16
#: Rows verified at first, and by which factor more each time after.
FIRST = 4
MORE = 8
SEED = 20240229
FOUND = "query_id long, vec_id long, score double"


def chi2_below(x: float, dims: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, dims // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-min(half, 700.0)) * total


def chi2_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 20.0 * dims + 200
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, dims) < p else (low, mid)
    return high


@dataclass
class Cells:
    """A full binary tree of splits in the projected space; leaves are numbered 0, 1, ..."""

    levels: int
    axis: np.ndarray
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, n_cells: int) -> Cells:
        levels, dims = max(0, math.ceil(math.log2(max(1, n_cells)))), points.shape[1]
        axis, value = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        low, high = np.full((2 << levels, dims), -np.inf), np.full((2 << levels, dims), np.inf)
        members = {1: points}
        for node in range(1, 1 << levels):
            mine = members.pop(node)
            if len(mine):
                axis[node] = int(np.argmax(mine.max(0) - mine.min(0)))
                value[node] = np.median(mine[:, axis[node]])
            a, right = axis[node], mine[:, axis[node]] >= value[node]
            members[2 * node], members[2 * node + 1] = mine[~right], mine[right]
            for child in (2 * node, 2 * node + 1):
                low[child], high[child] = low[node], high[node]
            high[2 * node, a] = low[2 * node + 1, a] = value[node]
        return cls(levels, axis, value, low[1 << levels :], high[1 << levels :])

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.value[node])
        return (node - (1 << self.levels)).astype(np.int32)

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of q to each cell."""
        return _gaps(self.low, self.high, q)


def _gaps(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(1)


class Block:
    """A kd-tree over the projections of some rows, kept in the order of its leaves of at
    most LEAF rows (splits at the median of the widest dimension)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, points: np.ndarray):
        order, todo, leaves = np.arange(len(points)), [(0, len(points))], []
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= LEAF:
                leaves.append((lo, hi))
                continue
            part = points[order[lo:hi]]
            mid = (hi - lo) // 2
            widest = int(np.argmax(part.max(0) - part.min(0)))
            order[lo:hi] = order[lo:hi][np.argpartition(part[:, widest], mid)]
            todo += [(lo, lo + mid), (lo + mid, hi)]
        bounds = np.array(sorted(leaves), np.int64).reshape(-1, 2)
        self.ids, self.x, self.points = ids[order], x[order], points[order]
        self.rough = self.x.astype(np.float32)
        self.sizes = bounds[:, 1] - bounds[:, 0]
        self.low = np.array([self.points[a:b].min(0) for a, b in bounds])
        self.high = np.array([self.points[a:b].max(0) for a, b in bounds])
        self.norm2 = (self.points * self.points).sum(1)


def search(block: Block, query: np.ndarray, projected: np.ndarray, own: int, k: int, least: float, far2: float, quantile: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and inner products of the k best rows of a block that reach ``least``, and how
    many rows were verified.  far2 is the squared norm that all vectors are lifted to."""
    norm2 = float(query @ query)
    slack = 1e-9 * (far2 + norm2) * quantile
    # float32 decides only what surely stays below the k-th best.
    rough_slack = 1e-5 * math.sqrt(far2 * norm2) + 1e-30
    rough_query = query.astype(np.float32)

    def radius(worst: float) -> float:
        return quantile * max(0.0, far2 + norm2 - 2 * worst) + slack if worst > -math.inf else math.inf

    reach = radius(least)
    leaves = _gaps(block.low, block.high, projected) <= reach
    none = np.zeros(0, np.int64)
    if not leaves.any():
        return none, np.zeros(0), 0
    rows = np.arange(len(block.ids)) if leaves.all() else np.flatnonzero(np.repeat(leaves, block.sizes))
    near = block.norm2[rows] - 2 * (block.points[rows] @ projected) + float(projected @ projected)
    rows, near = rows[near <= reach], near[near <= reach]
    best_id, best, verified, take = none, np.zeros(0), 0, FIRST * k
    while len(rows):
        if len(rows) > take:
            cut_at = np.argpartition(near, take)
            now, rows, near = rows[cut_at[:take]], rows[cut_at[take:]], near[cut_at[take:]]
        else:
            now, rows, near = rows, rows[:0], near[:0]
        now = now[block.ids[now] != own]
        verified += len(now)
        bar = max(least, best[-1] if len(best) == k else -math.inf)
        now = now[block.rough[now] @ rough_query >= bar - rough_slack] if bar > -math.inf else now
        got = (block.x[now] * query).sum(1)
        now, got = now[got >= bar], got[got >= bar]
        best_id, best = np.concatenate([best_id, block.ids[now]]), np.concatenate([best, got])
        top = np.lexsort((best_id, -best))[:k]
        best_id, best = best_id[top], best[top]
        if len(best) == k and len(rows):
            inside = near <= radius(max(least, best[-1]))
            rows, near = rows[inside], near[inside]
        take *= MORE
    return best_id, best, verified


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part, one for each vec_id."""
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    fine = F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists("v", lambda a: a != 0)
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


@dataclass
class Space:
    """How vectors of ``dim`` components are lifted to one norm and projected."""

    dim: int
    far2: float
    directions: np.ndarray

    def rows(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.far2 - (x * x).sum(1), 0))
        return np.column_stack([x, lift]) @ self.directions

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions[:-1]


def answered(asks: DataFrame, space: Space, k: int, quantile: float, verified=None) -> DataFrame:
    """(query_id, vec_id, score) found by rows (place, pair, kind, vec_id, v, least) dealt by
    place: of each pair, the block's rows (kind 0) come before its queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, block = None, [], None
        for batch in batches:
            pairs, kinds = (batch.column(i).to_numpy() for i in (0, 1))
            edge = np.flatnonzero((pairs[1:] != pairs[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *edge], [*edge, len(pairs)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if pairs[lo] != pair:
                    pair, held, block = pairs[lo], [], None
                if kinds[lo] == 0:
                    held.append((part.column(2).to_numpy(), _matrix(part.column(3), space.dim)))
                    continue
                if block is None and held:
                    ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
                    block, held = Block(ids, x, space.rows(x)), []
                if block is None:
                    continue
                own, x, least = part.column(2).to_numpy(), _matrix(part.column(3), space.dim), part.column(4).fill_null(-math.inf).to_numpy()
                projected, out, seen = space.queries(x), [], 0
                for i in range(len(own)):
                    ids, scores, n = search(block, x[i], projected[i], own[i], k, least[i], space.far2, quantile)
                    out.append((np.full(len(ids), own[i]), ids, scores))
                    seen += n
                if verified is not None:
                    verified.add(seen)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    places = asks.select("place").distinct().count()
    dealt = asks.repartitionById(max(1, places), "place").sortWithinPartitions("pair", "kind", "vec_id")
    return dealt.select("pair", "kind", "vec_id", "v", "least").mapInArrow(run, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query, k: int = 20, dims: int = DIMS, sure: float = SURE, block_rows: int = BLOCK_ROWS, part_queries: int = PART_QUERIES, verified=None) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows to each query, which are
    the rows that the condition ``is_query`` on vec_id selects.  ``verified`` may be an
    accumulator, to which the number of verified pairs is added."""
    spark = vectors.sparkSession
    written = cut(clean(vectors), "vectors")
    sizes = written.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double"))).alias("norm2")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes["dim"], sizes["n"]
    space = Space(dim, float(sizes["norm2"]) * (1 + 1e-9), np.random.default_rng(SEED).standard_normal((dim + 1, dims)))
    rows = written.filter(F.size("v") == dim)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = space.rows(_matrix(batch.column(0), dim)).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * dims, pa.int32()), pa.array(flat))], ["y"])

    share = max(1, math.ceil(n / SAMPLE))
    sample = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(share)) == 0).select("v").mapInArrow(project, "y array<double>").toArrow()
    cells = Cells.fit(_matrix(sample.column("y"), dims), min(CELLS, math.ceil(n / block_rows)))
    quantile = chi2_quantile(sure, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.of(space.rows(x))), pa.array(cells.of(space.queries(x)))], ["vec_id", "v", "asked", "cell", "home"])

    kind = dict(rows.dtypes)["v"]
    placed = cut(rows.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asked")).mapInArrow(place, f"vec_id long, v {kind}, asked boolean, cell int, home int"), "placed-vectors")
    # At most CELLS rows reach the driver.
    held = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = {c: math.ceil(m / block_rows) for c, m in held.items()}
    first_block = dict(zip(blocks, np.cumsum([0, *blocks.values()]).tolist(), strict=False))

    def look_up(column, values: dict[int, int], default: int = 0):
        return F.coalesce(F.get(F.array(*(F.lit(int(values.get(c, default))) for c in range(1 << cells.levels))), column), F.lit(default))

    def asks(queries: DataFrame) -> DataFrame:
        """Rows of answered(): queries (cell, vec_id, v, least) beside copies of blocks."""
        counted = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        parts = {c: math.ceil(m / part_queries) for c, m in counted.items() if c in blocks}
        # A pair is a block and a part of its queries; a cell's pairs are numbered in a row.
        start = dict(zip(parts, np.cumsum([0, *(p * blocks[c] for c, p in parts.items())]).tolist(), strict=False))
        many, split, base = look_up(F.col("cell"), blocks), look_up(F.col("cell"), parts), look_up(F.col("cell"), start)
        mine = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.greatest(many, F.lit(1))).cast("int")
        some = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.greatest(split, F.lit(1))).cast("int")
        each = lambda m: F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
        nothing = F.lit(None).cast("double").alias("least")
        data = placed.select((base + mine * split).alias("b"), F.explode(each(split)).alias("i"), "vec_id", "v").select((F.col("b") + F.col("i")).alias("pair"), F.lit(0).alias("kind"), "vec_id", "v", nothing)
        told = queries.filter(split > 0).select(base.alias("b"), split.alias("p"), some.alias("s"), F.explode(each(many)).alias("i"), "vec_id", "v", "least")
        told = told.select((F.col("b") + F.col("i") * F.col("p") + F.col("s")).alias("pair"), F.lit(1).alias("kind"), "vec_id", "v", "least")
        return data.union(told).withColumn("place", F.col("pair").cast("int"))

    queries = placed.filter("asked")
    own = cut(answered(asks(queries.select(F.col("home").alias("cell"), "vec_id", "v", F.lit(None).cast("double").alias("least"))), space, k, quantile, verified), "own-cells")
    bars = best_of(own, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, least = _matrix(batch.column(1), dim), batch.column(2).fill_null(-math.inf).to_numpy()
            home, y, lists = batch.column(3).to_numpy(), space.queries(x), []
            for i in range(len(x)):
                norm2 = float(x[i] @ x[i])
                reach = quantile * (max(0.0, space.far2 + norm2 - 2 * least[i]) + 1e-9 * (space.far2 + norm2)) if least[i] > -math.inf else math.inf
                hit = cells.distances(y[i]) <= reach
                hit[home[i]] = False
                lists.append(np.flatnonzero(hit).astype(np.int32))
            ends = np.concatenate([[0], np.cumsum([len(a) for a in lists])])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))], ["vec_id", "v", "least", "cells"])

    barred = queries.join(bars, "vec_id", "left").select("vec_id", "v", "least", "home")
    visits = cut(barred.mapInArrow(reached, f"vec_id long, v {kind}, least double, cells array<int>"), "visits")
    others = answered(asks(visits.select(F.explode("cells").alias("cell"), "vec_id", "v", "least")), space, k, quantile, verified)
    out = cut(best_of(own.union(others), k).select("query_id", "rank", "vec_id", "score"), "neighbours")
    for done in (written, placed, own, visits):
        drop(done)
    return out
