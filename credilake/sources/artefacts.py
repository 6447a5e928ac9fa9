"""Stored cluster and anomaly models: tables in a folder per version, current once its record is published.

A version that was interrupted while it was written has no record and is never read; older versions stay
readable by number until someone removes them.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credilake.operators.anomaly import IsolationForest, LofBase
from credilake.operators.scaling import RobustScale
from credilake.sources import snapshots

_NODES = "tree int, node int, feature int, threshold double, left int, right int, depth double"
_CENTRES = "cluster int, centre array<double>"
_SCALE = "place int, column string, median double, width double"


def _write(spark: SparkSession, path: str, kind: str, tables: dict[str, DataFrame], facts: dict[str, Any]) -> int:
    version = snapshots.new_version()
    for name, df in tables.items():
        df.write.parquet(f"{path}/versions/{version}/{name}")
    return snapshots.publish(spark, f"{path}/published", {"kind": kind, "tables": sorted(tables), "facts": facts}, version)


def _read(spark: SparkSession, path: str, kind: str, number: int | None) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    records = f"{path}/published"
    found = snapshots.latest(spark, records) if number is None else snapshots.numbered(spark, records, number)
    if found is None:
        raise FileNotFoundError(f"nothing published under {path}" + ("" if number is None else f" as number {number}"))
    _, version, content = found
    if content["kind"] != kind:
        raise TypeError(f"{path} holds a {content['kind']}, not a {kind}")
    folder = f"{path}/versions/{version}"
    return {t: spark.read.parquet(f"{folder}/{t}") for t in content["tables"]}, content["facts"]


def save_forest(spark: SparkSession, path: str, forest: IsolationForest) -> int:
    """An isolation forest as a table of nodes, with its sample size and cut; returns the number of the version."""
    rows = [
        (t, i, int(tree["feature"][i]), float(tree["threshold"][i]), int(tree["left"][i]), int(tree["right"][i]), float(tree["depth"][i]))
        for t, tree in enumerate(forest.trees)
        for i in range(len(tree["feature"]))
    ]
    facts = {"sample_rows": forest.sample_rows, "offset": forest.offset}
    return _write(spark, path, "isolation forest", {"nodes": spark.createDataFrame(rows, _NODES)}, facts)


def load_forest(spark: SparkSession, path: str, number: int | None = None) -> IsolationForest:
    """The current forest, or that of an earlier ``number``. At most 511 nodes per tree reach the driver."""
    tables, facts = _read(spark, path, "isolation forest", number)
    kinds = {"feature": int, "threshold": float, "left": int, "right": int, "depth": float}
    grown: dict[int, list] = {}
    for r in tables["nodes"].orderBy("tree", "node").collect():
        grown.setdefault(r["tree"], []).append(r)
    trees = [{c: np.array([r[c] for r in nodes], dtype=t) for c, t in kinds.items()} for nodes in grown.values()]
    return IsolationForest(trees, facts["sample_rows"], facts["offset"])


def save_centres(spark: SparkSession, path: str, centres: list[list[float]], scale: RobustScale | None = None) -> int:
    """Cluster centres, and the scale of the features they were found in."""
    tables = {"centres": spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], _CENTRES)}
    if scale is not None:
        rows = [(i, c, m, scale.ranges[c]) for i, (c, m) in enumerate(scale.medians.items())]
        tables["scale"] = spark.createDataFrame(rows, _SCALE)
    return _write(spark, path, "centres", tables, {})


def load_centres(spark: SparkSession, path: str, number: int | None = None) -> tuple[list[list[float]], RobustScale | None]:
    """(centres by number of cluster, scale or None)"""
    tables, _ = _read(spark, path, "centres", number)
    centres = [r["centre"] for r in tables["centres"].orderBy("cluster").collect()]
    if "scale" not in tables:
        return centres, None
    rows = tables["scale"].orderBy("place").collect()
    return centres, RobustScale({r["column"]: r["median"] for r in rows}, {r["column"]: r["width"] for r in rows})


def save_lof_base(spark: SparkSession, path: str, base: LofBase) -> int:
    """What unseen rows are judged against: training rows with their k-distance and density. Stays distributed."""
    tables = {"points": base.points, "neighbourhoods": base.neighbourhoods}
    return _write(spark, path, "local outlier factor", tables, {"k": base.k})


def load_lof_base(spark: SparkSession, path: str, number: int | None = None) -> LofBase:
    tables, facts = _read(spark, path, "local outlier factor", number)
    return LofBase(tables["points"], tables["neighbourhoods"], facts["k"])
