"""Many fits at once: every grid point, fold and model is a task of its own, on all rows of its frame.

The rows are stored once, in the order of a hash of their keys, and pass by each task, which keeps them as arrays:
in a scratch file beyond ``IN_MEMORY`` bytes, so that a task's memory is the codes (a byte per value) and a few numbers
per row. No row reaches the driver. Fits are seeded, so that a lost task gives the same model again.
"""

from __future__ import annotations

import pickle
import tempfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import product
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credilake.constants import KEY
from credilake.operators import network
from credilake.operators import trees as growth
from credilake.session import materialize

#: Bytes of vectors that a task holds in memory; more of them are a scratch file, read as needed.
IN_MEMORY = 1 << 26
#: Bytes of fold models that a scoring task keeps unpacked; of larger ones it keeps one at a time.
UNPACKED = 1 << 28
SEED = 42


@dataclass
class Sample:
    """Rows in the order of their hash; ``fold`` is -1 where there are no folds."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    fold: np.ndarray

    def without(self, fold: int | None) -> Sample:
        return self if fold is None else self.rows(self.fold != fold)

    def rows(self, which: np.ndarray) -> Sample:
        at = np.flatnonzero(which)
        x = table(len(at), self.x.shape[1])
        for start in range(0, len(at), growth.ROWS):
            x[start : start + growth.ROWS] = self.x[at[start : start + growth.ROWS]]
        return Sample(x, self.y[which], self.w[which], self.fold[which])


def table(rows: int, width: int) -> np.ndarray:
    """Room for vectors, in memory or in a scratch file that goes with it."""
    if rows * width * 8 <= IN_MEMORY:
        return np.empty((rows, width))
    with tempfile.TemporaryFile() as file:
        return np.memmap(file, float, "w+", shape=(rows, width)).view(np.ndarray)


def _ordered(df: DataFrame, seed: int = SEED) -> DataFrame:
    """What fits read of a prepared frame, by a hash of the key; ties of the hash go by label and vector."""
    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(-1)
    narrow = df.select(
        F.xxhash64(KEY, F.lit(seed)).alias("by"), F.col("label").cast("double").alias("y"), weight.alias("w"),
        F.col("vec").cast("array<double>").alias("x"), fold.alias("fold"),
    )
    return narrow.orderBy("by", "y", "x", "w", "fold")


@dataclass
class StoredRows:
    """All rows of a frame, written out: ``place`` is the number of a row's part, in the upper bits, and its own in it."""

    rows: DataFrame
    begins: dict[int, int]
    count: int

    @staticmethod
    def of(df: DataFrame) -> StoredRows:
        placed = _ordered(df).withColumn("place", F.monotonically_increasing_id()).drop("by")
        rows = materialize(placed, "fit-rows")
        # a row per part of the sorted table
        sizes = rows.groupBy(F.shiftright("place", 33).alias("part")).count().orderBy("part").collect()
        begins, total = {}, 0
        for r in sizes:
            begins[r["part"]] = total
            total += r["count"]
        return StoredRows(rows, begins, total)


class _Filled:
    """A sample that batches of stored rows fill in, each row at its place."""

    def __init__(self, begins: dict[int, int], count: int):
        self.begins = np.zeros(max(begins, default=0) + 1, np.int64)
        self.begins[list(begins)] = list(begins.values())
        self.sample = Sample(np.empty((0, 1)), np.empty(count), np.empty(count), np.empty(count, np.int32))

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        place = batch.column("place").to_numpy()
        at = self.begins[place >> 33] + (place & ((1 << 33) - 1))
        x, s = batch.column("x"), self.sample
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        if not len(s.x):
            s.x = table(len(s.y), x.shape[1])
        s.x[at], s.y[at], s.w[at], s.fold[at] = x, *(batch.column(n).to_numpy(zero_copy_only=False) for n in ("y", "w", "fold"))


def sample(df: DataFrame, rows: int | None = None, seed: int = SEED) -> Sample:
    """The rows of a prepared frame as the tasks have them, or the first of them, for frames that the driver can hold."""
    ordered = _ordered(df, seed)
    found = (ordered if rows is None else ordered.limit(rows)).collect()
    x = np.array([r["x"] for r in found], float) if found else np.empty((0, 1))
    y, w = (np.array([r[n] for r in found], float) for n in ("y", "w"))
    return Sample(x, y, w, np.array([r["fold"] for r in found], np.int32))


def auc(y: np.ndarray, p: np.ndarray) -> float:
    """Area under the ROC curve, ties at half; nan if a class is missing."""
    values, inverse = np.unique(p, return_inverse=True)
    pos, neg = (np.bincount(inverse, y == k, len(values)) for k in (1, 0))
    below = np.cumsum(neg) - neg / 2
    with np.errstate(invalid="ignore", divide="ignore"):
        return float((pos * below).sum() / (pos.sum() * neg.sum()))


# --- what can be fitted ------------------------------------------------------------------------------------


@dataclass
class TreeSpec:
    """A forest, boosted trees or one tree. ``features`` is the share that a node tries, ``sqrt`` its root."""

    kind: str = "forest"
    trees: int = 300
    depth: int = 20
    least: int = 1
    features: float | str = 1.0
    step: float = 0.1
    subsample: float = 1.0
    weighted: bool = True
    impurity: str = "variance"
    bins: int = growth.BINS
    grid: dict[str, list] = field(default_factory=dict)
    seed: int = SEED

    def _grown(self, s: Sample) -> tuple[Iterator[growth.Tree], list[np.ndarray]]:
        width = s.x.shape[1]
        edges = growth.bin_edges(s.x, self.bins)
        codes = growth.binned(s.x, edges)
        w = s.w if self.weighted else np.ones(len(s.y))
        tried = int(np.ceil(np.sqrt(width))) if self.features == "sqrt" else int(np.ceil(self.features * width))
        if self.kind == "forest":
            grown = growth.forest_trees(codes, s.y, w, self.trees, self.depth, self.least, tried, self.seed, self.bins)
        elif self.kind == "boost":
            grown = growth.boosted_trees(
                codes, s.y, w, self.trees, self.depth, self.least, tried, self.seed, self.step, self.subsample, self.bins
            )
        else:
            ones = np.ones(len(s.y))
            grown = iter([growth.grow(codes, s.y, w, ones, self.depth, self.least, impurity=self.impurity, bins=self.bins)])
        return grown, edges

    def _scale(self, n: int) -> list[float]:
        return [1.0, *[self.step] * (n - 1)] if self.kind == "boost" else [1.0 / n] * n

    def fit_rows(self, s: Sample) -> growth.Ensemble:
        trees, edges = self._grown(s)
        grown = list(trees)
        return growth.Ensemble.of(grown, edges, self._scale(len(grown)), self.kind == "boost")

    def groups(self) -> list[list[TreeSpec]]:
        """Grid points that one growth answers: fewer trees, and shallower ones of a forest, are parts of it."""
        points = [replace(self, grid={}, **dict(zip(self.grid, p))) for p in product(*self.grid.values())]
        free = ("trees", "depth") if self.kind == "forest" else ("trees",)
        found: dict[tuple, list[TreeSpec]] = {}
        for p in points:
            found.setdefault(tuple(getattr(p, n) for n in self.grid if n not in free), []).append(p)
        return list(found.values())

    @staticmethod
    def scores(group: list[TreeSpec], own: Sample, held: Sample) -> list[float]:
        """AUC on ``held`` of each point of a group, from one growth on ``own``."""
        most = replace(group[0], trees=max(p.trees for p in group), depth=max(p.depth for p in group))
        grown, edges = most._grown(own)
        codes = growth.binned(held.x, edges)
        total: dict[int, np.ndarray] = {d: np.zeros(len(codes)) for d in {p.depth for p in group}}
        wanted, out, scales = {(p.trees, p.depth) for p in group}, {}, most._scale(most.trees)
        for n, (tree, scale) in enumerate(zip(grown, scales), 1):  # no tree is kept
            for start in range(0, len(codes), growth.ROWS):
                part = codes[start : start + growth.ROWS]
                at, rows, step = np.zeros(len(part), np.int64), np.arange(len(part)), 0
                for d in sorted(total):
                    while step < min(d, tree.depth):
                        at = tree.left[at] + (part[rows, tree.feature[at]] > tree.cut[at])
                        step += 1
                    total[d][start : start + growth.ROWS] += scale * tree.value[at]
            out |= {(n, d): auc(held.y, total[d]) for d in total if (n, d) in wanted}
        return [out[p.trees, p.depth] for p in group]

    def fit(self, df: DataFrame) -> FittedModel:
        return fit_one(df, self)

    def tune(self, df: DataFrame, folds: int = 3, seed: int = SEED) -> TreeSpec:
        return tune_all(df, {"": self}, folds, seed)[""]


@dataclass
class NetworkSpec:
    hidden: list[int]
    epochs: int = 3000
    seed: int = SEED

    def fit_rows(self, s: Sample) -> network.Network:
        return network.fit(s.x, s.y, self.hidden, self.epochs, self.seed)

    def fit(self, df: DataFrame) -> FittedModel:
        return fit_one(df, self)


@dataclass
class StumpSpec:
    """SAMME boosting of depth-one trees, two classes."""

    rounds: int = 300
    learning_rate: float = 0.5

    def fit_rows(self, s: Sample) -> list[tuple]:
        edges = growth.bin_edges(s.x)
        return growth.stumps(growth.binned(s.x, edges), s.y, edges, self.rounds, self.learning_rate)

    def fit(self, df: DataFrame) -> Any:
        return fit_one(df, self)


# --- running them ------------------------------------------------------------------------------------------


def in_tasks(stored: StoredRows, jobs: Sequence[Any], work: Callable[[Sample, Any], Any]) -> list[tuple[str, bytes]]:
    """``work(sample, job)`` of every job on all stored rows, each in a task of its own, as kind and ``packed`` result; a
    job's error is its result. A forest of many leaves is large, packed it is a fraction of that."""
    wanted, begins, count = list(jobs), stored.begins, stored.count
    schema = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("found", pa.binary())])

    def done(s: Sample, job: int) -> Any:
        try:
            return work(s, wanted[job])
        except Exception as e:  # noqa: BLE001
            return RuntimeError(f"{type(e).__name__}: {e}")

    def run(batches):
        filled, job = _Filled(begins, count), None
        for batch in batches:
            if batch.num_rows:
                job = batch.column("id")[0].as_py()
                filled.add(batch)
        if job is None:
            return
        found = done(filled.sample, job)
        yield pa.record_batch([[job], [type(found).__name__], [packed(found)]], schema=schema)

    if not count:  # no row starts a task
        none = [done(_Filled({}, 0).sample, j) for j in range(len(wanted))]
        return [(type(found).__name__, packed(found)) for found in none]
    spark = stored.rows.sparkSession
    tasks = spark.range(0, len(wanted), 1, max(1, len(wanted)))
    # the side named first is read as it passes, the other, one row, is held: a nested loop without a shuffle
    passing = stored.rows.coalesce(1).hint("shuffle_replicate_nl").join(tasks)
    rows = passing.mapInArrow(run, "id long, kind string, found binary").collect()
    return [(r["kind"], bytes(r["found"])) for r in sorted(rows, key=lambda r: r["id"])]


def packed(found: Any) -> bytes:
    """A result by its plain fields, since executors need not have this library: its size, then its bytes, compressed."""
    kind = type(found).__name__
    plain = vars(found) if kind in ("Ensemble", "Network") else str(found) if isinstance(found, Exception) else found
    whole = pickle.dumps((kind, plain))
    return len(whole).to_bytes(8, "big") + zlib.compress(whole, 1)


def unpacked(found: bytes) -> Any:
    kind, plain = pickle.loads(zlib.decompress(found[8:]))
    made = {"Ensemble": growth.Ensemble, "Network": network.Network}
    return made[kind](**plain) if kind in made else RuntimeError(plain) if kind == "RuntimeError" else plain


def fit_all(df: DataFrame, specs: dict[str, Any], folds: int = 0) -> dict[tuple[str, int | None], Any]:
    """Models by (name, None), and by (name, fold) fitted without that fold of ``df``, on all its other rows. A failed fit
    is its error."""
    jobs = [(name, f) for name in specs for f in (None, *range(folds))]
    found = in_tasks(StoredRows.of(df), jobs, lambda s, job: specs[job[0]].fit_rows(s.without(job[1])))
    return {job: fitted(kind, m) for job, (kind, m) in zip(jobs, found)}


def fit_one(df: DataFrame, spec: Any) -> Any:
    found = fit_all(df, {"": spec})["", None]
    if isinstance(found, Exception):
        raise found
    return found


def fitted(kind: str, found: bytes) -> Any:
    if kind == "list":
        from credilake.operators.supervised import AdaBoostModel

        return AdaBoostModel(unpacked(found))
    return PackedModel(found) if kind in ("Ensemble", "Network") else unpacked(found)


def grid_scores(df: DataFrame, specs: dict[str, TreeSpec], folds: int = 3, seed: int = SEED) -> list[tuple[str, TreeSpec, float]]:
    """(name, grid point, mean AUC over the folds of all rows) of every point of every grid, from one Spark job."""
    from credilake.operators.prep import stratified_folds

    jobs = [(name, group, f) for name, spec in specs.items() for group in spec.groups() for f in range(folds)]
    folded = StoredRows.of(stratified_folds(df, folds, seed))

    def work(s: Sample, job: tuple) -> list[float]:
        _, group, f = job
        return TreeSpec.scores(group, s.without(f), s.rows(s.fold == f))

    total: dict[tuple[str, int], tuple] = {}
    for (name, group, _), (_, result) in zip(jobs, in_tasks(folded, jobs, work)):
        found = unpacked(result)
        if isinstance(found, Exception):
            raise found
        for p, score in zip(group, found):
            key = name, repr(p)
            total[key] = (name, p, total.get(key, (name, p, 0.0))[2] + score / folds)
    return list(total.values())


def tune_all(df: DataFrame, specs: dict[str, TreeSpec], folds: int = 3, seed: int = SEED) -> dict[str, TreeSpec]:
    """Each spec at the point of its grid with the best cross-validated AUC, the first of equal ones."""
    best: dict[str, tuple[float, TreeSpec]] = {}
    for name, point, score in grid_scores(df, {n: s for n, s in specs.items() if s.grid}, folds, seed):
        if name not in best or score > best[name][0]:
            best[name] = score, point
    return {name: best[name][1] if name in best else spec for name, spec in specs.items()}


@dataclass
class FittedModel:
    """A model in arrays, sent to the executors to score rows of any number."""

    local: growth.Ensemble | network.Network

    def packed(self) -> bytes:
        return packed(self.local)

    def transform(self, df: DataFrame) -> DataFrame:
        return FoldModels([self.packed()]).transform(df.withColumn("_model", F.lit(0)), "_model").drop("_model")


class PackedModel(FittedModel):
    """A model as its task sent it: the driver holds many, and unpacks one when it is looked into."""

    def __init__(self, found: bytes):
        self._found = found

    @property
    def local(self) -> growth.Ensemble | network.Network:
        return unpacked(self._found)

    def packed(self) -> bytes:
        return self._found


@dataclass
class FoldModels:
    """One packed model per fold: a row is scored by the model that did not see its fold."""

    found: list[bytes]

    def transform(self, df: DataFrame, by: str = "fold") -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self.found)
        all_kept = sum(int.from_bytes(m[:8], "big") for m in self.found) <= UNPACKED
        kept: dict[int, Any] = {}

        def model(f: int) -> Any:
            if f not in kept:
                if not all_kept:
                    kept.clear()
                kept[f] = unpacked(sent.value[f])
            return kept[f]

        @F.pandas_udf("double")
        def score(vec: pd.Series, fold: pd.Series) -> pd.Series:
            out = np.empty(len(vec))
            if len(vec):
                x, fold = np.stack(vec.to_numpy()), fold.to_numpy()
                for f in np.unique(fold):
                    out[fold == f] = model(int(f)).score(x[fold == f])
            return pd.Series(out)

        return df.withColumn("p", score("vec", by)).withColumn("predicted", (F.col("p") > 0.5).cast("int"))
