"""Exact nearest-neighbour and within-distance joins.

Both sides are cut into the Voronoi cells of a bounded set of pivots. Cells that lie close together form groups of
some ten thousand rows, a cell of more rows has several groups. A point travels once to each group that may hold a
partner by the triangle inequality, and a task holds one group and one chunk of such points. There the inequality
discards cells point by point; what is left is compared by matrix products, whose rounding is bounded: pairs that
they cannot tell apart, and all that are returned, get their distance from the differences themselves. What leaves a
task is at most k rows per point (join by rank) or the pairs asked for (join by distance), never the block. Results
are exact: pivots and chunk sizes change the cost, not the answer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credilake.session import materialize

CHUNK_ROWS = 2048  # smallest chunk
MAX_CHUNK_ROWS = 1 << 16  # bounds the memory of a task: two chunks of 64 dimensions are 64 MB
_SIDE = 8  # a table of any size is cut into about so many chunks at least, for enough tasks
_BLOCK_ROWS = 1 << 13  # rows that are packed into one when every pair is looked at
_BLOCKS_A_TASK = 4  # of them, at most, whose sums a task holds
_EXACT_PAIRS = 1 << 16  # pairs whose differences are formed at once
_PENDING = 1 << 20  # found pairs that wait to be ranked
MAX_PIVOTS = 2048  # bounds the pivot matrix that travels with every task
_TILE_CELLS = 1 << 22  # doubles per intermediate difference block
_SUM_CELLS = 1 << 20  # distances that are formed and summed at once
_SLACK = 1e-9  # relative room for rounding in the pruning bounds


def vector_column(columns: list[str]) -> Column:
    """Feature columns as one array of doubles."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(rows, -1) if rows else np.zeros((0, 1))


def _tiles(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances of a slice of ``left`` to all of ``right``).

    Differences are squared and summed directly: equal vectors get distance 0 exactly, which the shorter
    norm expansion does not grant.
    """
    step = max(1, _TILE_CELLS // max(1, right.size))
    for start in range(0, len(left), step):
        gap = left[start : start + step, None, :] - right[None, :, :]
        yield start, np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))


def _squares(x: np.ndarray, y: np.ndarray, centre: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Square distances by one matrix product, and a bound of their error (twice what rounding can add up to); NaN where
    a vector is not finite. Vectors are taken from ``centre``, the mean of ``y`` unless given."""
    good_x, good_y = np.isfinite(x).all(axis=1), np.isfinite(y).all(axis=1)
    if not (good_x.all() and good_y.all()):
        squares, error = np.full((len(x), len(y)), np.nan), 0.0
        if good_y.any():
            squares[np.ix_(good_x, good_y)], error = _squares(x[good_x], y[good_y], centre)
        return squares, error
    centre = y.mean(axis=0) if centre is None else centre
    x, y = x - centre, y - centre
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    one = np.ones
    squares = np.hstack([-2.0 * x, xx[:, None], one((len(x), 1))]) @ np.hstack([y, one((len(y), 1)), yy[:, None]]).T
    return squares, 8e-16 * (x.shape[1] + 6) * (xx.max(initial=0.0) + yy.max(initial=0.0))


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (i, j) by their differences."""
    out = np.empty(len(i))
    for start in range(0, len(i), _EXACT_PAIRS):
        here = slice(start, start + _EXACT_PAIRS)
        gap = x[i[here]] - y[j[here]]
        out[here] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _near(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs lie within ``eps``; pairs at its very edge are decided by their differences."""
    squares, error = _squares(x, y)
    error += 1e-15 * eps * eps
    near = squares <= eps * eps + error
    i, j = np.divmod(np.flatnonzero(near & (squares > eps * eps - error)), max(1, len(y)))
    near[i, j] = _exact(x, y, i, j) <= eps
    return near


def summed_distances(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Weighted distances of every row of ``x`` to the rows of ``y``, summed up to each of ``ends`` in turn.

    Distances that are small beside the vectors, where the matrix product has too few digits, are taken from the
    differences; the others have eight digits at least.
    """
    out = np.empty((len(x), len(ends)))
    # a mean that a few far vectors pull away would make the distances of all others small beside them
    centre = np.median(y[np.isfinite(y).all(axis=1)], axis=0) if np.isfinite(y).all(axis=1).any() else np.zeros(y.shape[1])
    beside = 1e-6 * ((y - centre) ** 2).sum(axis=1)
    step = max(1, _SUM_CELLS // max(1, len(y)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        squares, error = _squares(part, y, centre)
        # one far vector makes the bound large for all: the pair's own norms decide, without listing pairs first
        few = ~(squares > 1e-6 * ((part - centre) ** 2).sum(axis=1)[:, None] + beside) & (squares < 1e8 * error)
        i, j = np.divmod(np.flatnonzero(few), max(1, len(y)))
        distances = np.sqrt(np.maximum(squares, 0.0))
        distances[i, j] = _exact(part, y, i, j)
        for c, (a, b) in enumerate(zip([0, *ends], ends)):
            out[at : at + step, c] = distances[:, a:b] @ weight[a:b]
    return out


@dataclass(frozen=True)
class Cells:
    """Pivots with what is known of each cell; at most ``MAX_PIVOTS`` entries, so it fits any closure.

    The rows of a cell are in the groups ``first`` to ``first + parts - 1``."""

    pivots: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    chunk_rows: int
    first: np.ndarray
    parts: np.ndarray

    @property
    def groups(self) -> int:
        return int((self.first + self.parts).max())

    def with_group(self, celled: DataFrame) -> DataFrame:
        """Base rows with their ``group``."""
        part = F.pmod(F.xxhash64("id"), _looked_up(self.parts, "cell"))
        return celled.withColumn("group", (_looked_up(self.first, "cell") + part).cast("int"))

    def at_home(self, celled: DataFrame) -> DataFrame:
        """A row per point and group of its own cell."""
        last = _looked_up(self.first + self.parts - 1, "cell")
        return celled.withColumn("group", F.explode(F.sequence(_looked_up(self.first, "cell"), last)))


def _chunk_rows(rows: int) -> int:
    return min(MAX_CHUNK_ROWS, max(CHUNK_ROWS, math.ceil(rows / _SIDE)))


def _grouped(pivots: np.ndarray, rows: np.ndarray, chunk_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of every cell: halves along the widest axis until they are small enough."""
    first, parts, at = np.zeros(len(rows), dtype=np.int64), np.ones(len(rows), dtype=np.int64), 0
    todo = [np.arange(len(rows))]
    while todo:
        cells = todo.pop()
        total = rows[cells].sum()
        if len(cells) > 1 and total > chunk_rows:
            order = cells[np.argsort(pivots[cells][:, pivots[cells].var(axis=0).argmax()], kind="stable")]
            half = int(np.clip(np.searchsorted(np.cumsum(rows[order]), total / 2) + 1, 1, len(order) - 1))
            todo += [order[half:], order[:half]]
        else:
            first[cells], parts[cells] = at, max(1, math.ceil(total / chunk_rows)) if len(cells) == 1 else 1
            at += int(parts[cells[0]])
    return first, parts


def _pivot_sample(points: DataFrame, count: int, total: int) -> np.ndarray:
    """Up to ``count`` distinct vectors, chosen by hash.

    The hash first thins the table to a few times that number, so the distinct step moves next to nothing;
    only the chosen ones reach the driver. A table of few distinct vectors just yields fewer pivots.
    """
    hashed = points.select("vec", F.xxhash64("vec").alias("h"))
    share = 16.0 * count / max(total, 1)
    thin = hashed.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else hashed
    picked = thin.distinct().orderBy("h").limit(count).select("vec").collect() or hashed.limit(1).collect()
    return np.array([r["vec"] for r in picked], dtype=np.float64).reshape(len(picked), -1)


def _with_cell(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot and the distance to it."""
    schema = T.StructType(
        [*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            cell = np.zeros(len(x), dtype=np.int32)
            reach = np.zeros(len(x))
            for start, d in _tiles(x, pivots):
                nearest = d.argmin(axis=1)
                cell[start : start + len(d)] = nearest
                reach[start : start + len(d)] = d[np.arange(len(d)), nearest]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(reach)], names=[*batch.schema.names, "cell", "reach"]
            )

    return points.mapInArrow(assign, schema)


def _cell_table(celled: DataFrame, pivots: np.ndarray, chunk_rows: int) -> Cells:
    rows, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("r")).collect():
        rows[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    return Cells(pivots, rows, radius, chunk_rows, *_grouped(pivots, rows, chunk_rows))


def _looked_up(values: np.ndarray, by: str) -> Column:
    """Looks a number per cell or group up by that column."""
    return F.expr(f"element_at(array({','.join(str(int(v)) for v in values)}), {by} + 1)")


def _candidates(points: DataFrame, cells: Cells, bound: str, include_home: bool) -> DataFrame:
    """One row per point and group with a cell that may hold a partner within ``bound`` (NULL: no bound)."""
    pivots, radius, filled = cells.pivots, cells.radius, cells.rows > 0
    fields = [f for f in points.schema.fields if f.name != "reach"]
    schema = T.StructType([*fields, T.StructField("group", T.IntegerType())])
    names = [f.name for f in fields]
    member = np.zeros((len(pivots), cells.groups), dtype=np.float32)
    for c, (first, parts) in enumerate(zip(cells.first, cells.parts)):
        member[c, first : first + parts] = 1

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = np.concatenate([d for _, d in _tiles(pivots, pivots)])
        for batch in batches:
            x = _matrix(batch.column("vec"))
            home = batch.column("cell").to_numpy()
            limit = _limits(batch.column(bound))
            for start, d in _tiles(x, pivots):
                here = slice(start, start + len(d))
                own = home[here]
                nearest = _least_distance(d, d[np.arange(len(d)), own][:, None], between[own], radius)
                may = (nearest <= limit[here][:, None] + _SLACK * (1.0 + d)) & filled
                if not include_home:
                    may[np.arange(len(d)), own] = False
                row, group = np.nonzero(may.astype(np.float32) @ member)
                taken = batch.take(pa.array(row + start)).select(names)
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(group.astype(np.int32))], names=[*names, "group"]
                )

    return points.mapInArrow(expand, schema)


def _limits(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    limit = np.array(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy(), float)
    limit[np.isnan(limit)] = np.inf
    return limit


def _least_distance(d: np.ndarray, at_home: np.ndarray, gap: np.ndarray, radius: np.ndarray | float) -> np.ndarray:
    """What the distance from a point to any row of a cell is at least: by the cell's radius, and by the plane half way
    between the pivots. ``d`` and ``at_home`` are the distances to the cell's pivot and to its own, ``gap`` theirs."""
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(gap > 0, (d * d - at_home * at_home) / (2 * gap), 0.0)
    return np.maximum(np.maximum(d - radius, plane), 0.0)


def _visits(
    a: pa.Table, b: pa.Table, x: np.ndarray, cells: Cells, limit: np.ndarray, home: bool | None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``a``, rows of ``b``) to compare, cell by cell of ``b``: those within reach of ``limit``, which may
    shrink on the way. ``home`` says whether a point's own cell is all, nothing (False) or like others (None)."""
    own, there = a.column("cell").to_numpy(), b.column("cell").to_numpy()
    order = np.argsort(there, kind="stable")
    starts = np.flatnonzero(np.diff(there[order], prepend=-1))
    at_home = np.linalg.norm(x - cells.pivots[own], axis=1) if len(x) else np.zeros(0)
    for begin, end in zip(starts, [*starts[1:], len(order)]):
        cols = order[begin:end]
        cell = int(there[cols[0]])
        if home:
            rows = np.flatnonzero(own == cell)
        else:
            d = np.linalg.norm(x - cells.pivots[cell], axis=1)
            gap = np.linalg.norm(cells.pivots - cells.pivots[cell], axis=1)[own]
            may = _least_distance(d, at_home, gap, cells.radius[cell]) <= limit + _SLACK * (1.0 + d)
            rows = np.flatnonzero(may if home is None else may & (own != cell))
        step = max(1, _TILE_CELLS // len(cols))
        for at in range(0, len(rows), step):
            yield rows[at : at + step], cols


def _compare_blocks(
    left: DataFrame,
    right: DataFrame,
    chunk_rows: int,
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: T.StructType,
) -> DataFrame:
    """Runs ``kernel`` on every chunk of ``left`` rows of a group with all ``right`` rows of that group.

    ``right`` has one row per base row and its ``group``, ``left`` one row per point and group that it must see.
    """
    counts = {r["group"]: r["count"] for r in left.groupBy("group").count().collect()}
    chunks = [max(1, math.ceil(counts.get(g, 0) / chunk_rows)) for g in range(max(counts, default=0) + 1)]
    # both sides may stem from one frame: fresh column identities keep them apart
    right = right.select(*[F.col(c).alias(c) for c in right.columns]).where(F.col("group") < len(chunks))
    l = left.withColumn("chunk", F.pmod(F.xxhash64("id"), _looked_up(chunks, "group")).cast("int"))
    r = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), _looked_up(chunks, "group") - 1)))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return kernel(a, b)

    return l.groupBy("group", "chunk").cogroup(r.groupBy("group", "chunk")).applyInArrow(run, schema)


_KNN_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("neighbor_id", T.LongType()),
        T.StructField("distance", T.DoubleType()),
    ]
)


def _top_k_kernel(k: int, cells: Cells, home: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest rows within each point's ``bound``, in its own cell or in all others."""

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({f.name: pa.array([], "float64" if f.name == "distance" else "int64") for f in _KNN_SCHEMA})
        x, y = _matrix(a.column("vec")), _matrix(b.column("vec"))
        xid, yid = a.column("id").to_numpy(), b.column("id").to_numpy()
        limit = _limits(a.column("bound"))
        none = np.iinfo(np.int64).max
        best, best_row = np.full((len(x), k), np.inf), np.full((len(x), k), -1)
        best_id = np.full((len(x), k), none)
        pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rank() -> None:
            """Found pairs into the k best of their points, by distance and id."""
            row, other, d = (np.concatenate(p) for p in zip(*pending))
            pending.clear()
            touched = np.unique(row)
            row = np.concatenate([np.repeat(touched, k), row])
            other = np.concatenate([best_row[touched].ravel(), other])
            ids = np.concatenate([best_id[touched].ravel(), yid[other[len(touched) * k :]]])
            d = np.concatenate([best[touched].ravel(), d])
            order = np.lexsort((ids, d, row))
            row, other, ids, d = row[order], other[order], ids[order], d[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = place < k
            row, place = row[kept], place[kept]
            best[row, place], best_id[row, place], best_row[row, place] = d[kept], ids[kept], other[kept]
            limit[touched] = np.minimum(limit[touched], best[touched, k - 1])

        for rows, cols in _visits(a, b, x, cells, limit, home):
            xs, ys = x[rows], y[cols]
            squares, error = _squares(xs, ys)
            bound = limit[rows]
            edge = bound * bound * (1 + 1e-15) + error
            free = np.isinf(bound)
            if free.any() and len(cols) > k:
                edge[free] = np.partition(squares[free], k - 1, axis=1)[:, k - 1] + 2 * error
            i, j = np.divmod(np.flatnonzero(squares <= edge[:, None]), len(cols))
            d = _exact(xs, ys, i, j)
            kept = d <= bound[i]
            if kept.any():
                pending.append((rows[i[kept]], cols[j[kept]], d[kept]))
            if pending and (free.any() or sum(len(p[0]) for p in pending) > _PENDING):
                rank()
        if pending:
            rank()
        row, place = np.nonzero(best_row >= 0)
        return pa.table({"id": xid[row], "neighbor_id": best_id[row, place], "distance": best[row, place]})

    return kernel


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("distance", "neighbor_id")
    # the rank limit is applied before the shuffle as well, so few rows per point travel
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _bounded_copies(points: DataFrame, keep: int) -> DataFrame:
    """At most ``keep`` rows (smallest ids) of each distinct vector.

    No point can need more than that as neighbours, so a vector that a third of the table shares costs no
    more than any other. The limit is applied map-side before the shuffle.
    """
    w = Window.partitionBy("vec").orderBy("id")
    return points.withColumn("_copy", F.row_number().over(w)).where(F.col("_copy") <= keep).drop("_copy")


def _points(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    # -0.0 and 0.0 are one vector
    vec = F.transform(F.col(vec_col), lambda v: v.cast("double") + F.lit(0.0))
    return df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))


def _pivot_count(rows: int) -> int:
    return int(min(MAX_PIVOTS, max(1, math.isqrt(max(rows, 1)) // 2)))


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "vec",
    exclude_self: bool = False,
    pivots: int | None = None,
    chunk_rows: int | None = None,
    within: float | None = None,
) -> DataFrame:
    """The k nearest base rows of every query row by Euclidean distance, ties to the smaller id.

    Returns ``id, neighbor_id, distance, rank``. ``exclude_self`` drops the pair of a row with itself (equal
    ids); ``within`` leaves out what is farther away. Identical query vectors are searched once and their answers
    joined back, so copies cost nothing. First each query looks into its own cell, whose k-th distance then bounds
    which other cells matter.
    """
    wanted = k + 1 if exclude_self else k
    q = _points(queries, id_col, vec_col)
    b = materialize(_bounded_copies(_points(base, id_col, vec_col), wanted), "knn-base")
    # one representative per distinct query vector; its own id plays no part in the search
    distinct = q.groupBy("vec").agg(F.min("id").alias("id"))
    total = b.count()
    centres = _pivot_sample(b, pivots or _pivot_count(total), total)
    celled = materialize(_with_cell(b, centres), "knn-cells")
    cells = _cell_table(celled, centres, chunk_rows or _chunk_rows(total))
    right = cells.with_group(celled.drop("reach"))
    left = materialize(_with_cell(distinct, centres).drop("reach"), "knn-queries")

    def search(points: DataFrame, home: bool) -> DataFrame:
        return _compare_blocks(points, right, cells.chunk_rows, _top_k_kernel(wanted, cells, home), _KNN_SCHEMA)

    bound = F.lit(within).cast("double")
    home = search(cells.at_home(left.withColumn("bound", bound)), home=True)
    home = materialize(_best(home, wanted).drop("rank"), "knn-home")
    reach = home.groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("d")).where(F.col("n") >= wanted)
    bounded = left.join(reach.select("id", "d"), "id", "left").withColumn("bound", F.least("d", bound)).drop("d")
    away = search(_candidates(materialize(bounded, "knn-bounded"), cells, "bound", include_home=False), home=False)
    found = _best(home.unionByName(away), wanted).drop("rank").withColumnRenamed("id", "_rep")
    # back from distinct vectors to all query rows
    rows = q.join(distinct.withColumnRenamed("id", "_rep"), "vec").select("id", "_rep").join(found, "_rep").drop("_rep")
    if exclude_self:
        rows = rows.where(F.col("id") != F.col("neighbor_id"))
    return _best(rows, k).select("id", "neighbor_id", "distance", "rank")


_PAIR_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("other", T.LongType()), T.StructField("distance", T.DoubleType())]
)


def _within_kernel(eps: float, cells: Cells) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, others, dists = [], [], []
        if a.num_rows and b.num_rows:
            x, y = _matrix(a.column("vec")), _matrix(b.column("vec"))
            xid, yid = a.column("id").to_numpy(), b.column("id").to_numpy()
            for rows, cols in _visits(a, b, x, cells, np.full(len(x), eps), None):
                i, j = np.divmod(np.flatnonzero(_near(x[rows], y[cols], eps)), len(cols))
                i, j = rows[i], cols[j]
                i, j = i[xid[i] < yid[j]], j[xid[i] < yid[j]]
                ids.append(xid[i])
                others.append(yid[j])
                dists.append(_exact(x, y, i, j))
        join = lambda parts, dtype: np.concatenate(parts).astype(dtype) if parts else np.zeros(0, dtype)
        return pa.table(
            {"id": join(ids, np.int64), "other": join(others, np.int64), "distance": join(dists, np.float64)}
        )

    return kernel


@dataclass(frozen=True)
class EpsIndex:
    """Points laid out for within-distance work, each in its own cell."""

    own: DataFrame
    cells: Cells
    eps: float

    def blocks(self, kernel, schema: T.StructType, left=None, right=None, home: bool | None = None) -> DataFrame:
        """``kernel`` on the points (or ``left``) and what they may reach of the points (or ``right``): in their own
        cell, in all others (False) or in all (None), which the kernel must ask of ``_visits`` too."""
        left, right = (self.own if df is None else df for df in (left, right))
        if home:
            left = self.cells.at_home(left)
        else:
            left = _candidates(left.withColumn("bound", F.lit(self.eps)), self.cells, "bound", home is None).drop("bound")
        return _compare_blocks(left, self.cells.with_group(right), self.cells.chunk_rows, kernel, schema)


def eps_index(points: DataFrame, eps: float, pivots: int | None = None, chunk_rows: int | None = None) -> EpsIndex:
    """Index of ``points`` (id, vec, further columns) for partners within ``eps``."""
    total = points.count()
    centres = _pivot_sample(points, pivots or _pivot_count(total), total)
    celled = materialize(_with_cell(points, centres), "eps-cells")
    cells = _cell_table(celled, centres, chunk_rows or _chunk_rows(total))
    return EpsIndex(celled.drop("reach"), cells, float(eps))


def eps_join(
    df: DataFrame,
    eps: float,
    id_col: str = "id",
    vec_col: str = "vec",
    pivots: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """All unordered pairs within ``eps`` as ``id < other`` with their distance: the answer is the pairs.

    For degrees or connectivity use the clustering operators, which never list the pairs.
    """
    index = eps_index(_points(df, id_col, vec_col), eps, pivots, chunk_rows)
    return index.blocks(_within_kernel(float(eps), index.cells), _PAIR_SCHEMA)


def all_blocks(
    left: DataFrame,
    right: DataFrame,
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: T.StructType,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Runs ``kernel`` on every (left chunk, right chunk), for measures that truly need every distance.

    Work is quadratic but evenly spread, and a kernel should return a reduction of its block.
    """
    rows = right.count()
    size = chunk_rows or _chunk_rows(rows)
    groups = max(1, math.ceil(rows / size))
    grouped = right.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    everywhere = left.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return _compare_blocks(everywhere, grouped, size, kernel, schema)


def _packed(points: DataFrame, rows: int) -> DataFrame:
    """Blocks of up to ``rows`` points (id, vec, labels, weight), each one row of plain arrays of numbers."""
    columns = ("id", "vec", "labels", "weight")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, waiting = TaskContext.get().partitionId(), 0, []

        def blocks(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made, waiting
            table = pa.Table.from_batches(waiting)
            while table.num_rows >= least:
                part, table = table.slice(0, rows), table.slice(rows)
                numbers = [
                    part.column("id").to_numpy(),
                    _matrix(part.column("vec")),
                    _matrix(part.column("labels")).astype(np.int64),
                    part.column("weight").to_numpy(),
                ]
                block = pa.array([(task << 32) + made], pa.int64())
                made += 1
                yield pa.record_batch(
                    [block, *[pa.array([v.tobytes()], pa.binary()) for v in numbers]], names=["block", *columns]
                )
            waiting = table.to_batches()

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= rows:
                yield from blocks(rows)
        if waiting:
            yield from blocks(1)

    schema = "block long, " + ", ".join(f"{c} binary" for c in columns)
    return materialize(points.select(*columns).mapInArrow(pack, schema), "blocks")


def summed_over_all(
    points: DataFrame,
    kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    width: int,
    block_rows: int | None = None,
) -> DataFrame:
    """``id, totals``: of every point (``id, vec, labels, weight``) the sums of ``kernel`` over all points, itself too.

    ``kernel`` takes the vectors of some points and the vectors, labels and weights of others and returns ``width``
    sums for each of the former. The work is quadratic, what is written is not: a task holds the sums of a few blocks
    while the stored table passes by block by block, so no pair of blocks leaves anything in a shuffle.
    """
    spark = points.sparkSession
    size = block_rows or min(_BLOCK_ROWS, max(CHUNK_ROWS, math.ceil(points.count() / (4 * _SIDE))))
    blocks = _packed(points, size)
    n = blocks.count()
    each = max(1, min(_BLOCKS_A_TASK, n // (4 * spark.sparkContext.defaultParallelism)))
    own = blocks.select(F.col("block").alias("mine"), F.col("id").alias("ids"), F.col("vec").alias("x"))
    own = own.repartitionByRange(max(1, math.ceil(n / each)), "mine")
    # the side named first is read as it passes, the other is held: a nested loop without a shuffle
    passing = blocks.select("vec", "labels", "weight").coalesce(1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("mine", "ids", "x", "vec", "labels", "weight")}
                read = {c: np.frombuffer(row[c].as_buffer(), t) for c, t in kinds.items()}
                ids, weight = read["ids"], read["weight"]
                found = kernel(
                    read["x"].reshape(len(ids), -1), read["vec"].reshape(len(weight), -1),
                    read["labels"].reshape(len(weight), -1), weight,
                )
                mine = row["mine"].as_py()
                if mine in held:
                    held[mine][1][:] += found
                else:
                    held[mine] = ids.copy(), found
        for ids, totals in held.values():
            offsets = np.arange(len(ids) + 1, dtype=np.int32) * width
            yield pa.record_batch([pa.array(ids), pa.ListArray.from_arrays(offsets, totals.ravel())], ["id", "totals"])

    kinds = {"ids": np.int64, "x": np.float64, "vec": np.float64, "labels": np.int64, "weight": np.int64}
    return passing.hint("shuffle_replicate_nl").join(own).mapInArrow(add, "id long, totals array<double>")
