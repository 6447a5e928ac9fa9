"""Model store: a folder per model, and the registry table."""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credilake.operators.fits import FittedModel
from credilake.operators.network import Network
from credilake.operators.supervised import AdaBoostModel, KnnModel, MlModel, StackedModel
from credilake.operators.trees import Ensemble
from credilake.plans.training import Preprocessor, TrainingResult

_ARRAYS = {c.__name__: c for c in (Ensemble, Network)}
_TABLE = "name string, place int, kind string, shape array<int>, data binary"


def _save_arrays(spark: SparkSession, local: Any, path: str) -> dict:
    """A model in arrays as a table of its arrays; plain fields go into what is returned."""
    rows, plain = [], {}
    for name, value in vars(local).items():
        if isinstance(value, (int, float, bool, str)):
            plain[name] = value
        else:
            parts = value if isinstance(value, list) else [value]
            rows += [
                (name, i if isinstance(value, list) else None, p.dtype.str, list(p.shape), np.ascontiguousarray(p).tobytes())
                for i, p in enumerate(parts)
            ]
    spark.createDataFrame(rows, _TABLE).coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays")
    return {"kind": "arrays", "class": type(local).__name__, "plain": plain}


def _load_arrays(spark: SparkSession, path: str, kind: dict) -> Any:
    fields = dict(kind["plain"])
    for r in sorted(spark.read.parquet(f"{path}/arrays").collect(), key=lambda r: (r["name"], r["place"] or 0)):
        value = np.frombuffer(r["data"], r["kind"]).reshape(r["shape"])
        if r["place"] is None:
            fields[r["name"]] = value
        else:
            fields.setdefault(r["name"], []).append(value)
    return _ARRAYS[kind["class"]](**fields)


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def _save(spark: SparkSession, model: Any, path: str) -> None:
    if isinstance(model, MlModel):
        model.model.write().overwrite().save(f"{path}/library")
        kind = {"kind": "library", "class": type(model.model).__name__}
    elif isinstance(model, FittedModel):
        kind = _save_arrays(spark, model.local, path)
    elif isinstance(model, AdaBoostModel):
        kind = {"kind": "adaboost", "stumps": model.stumps}
    elif isinstance(model, KnnModel):
        model.train.write.mode("overwrite").parquet(f"{path}/train")
        kind = {"kind": "knn", "k": model.k}
    elif isinstance(model, StackedModel):
        for i, base in enumerate(model.base.values()):
            _save(spark, base, f"{path}/base-{i}")
        _save(spark, model.meta, f"{path}/meta")
        kind = {"kind": "stacked", "base": list(model.base)}
    else:
        raise TypeError(f"cannot store {type(model).__name__}")
    _write_text(spark, json.dumps(kind), f"{path}/kind")


def _load(spark: SparkSession, path: str) -> Any:
    kind = json.loads(_read_text(spark, f"{path}/kind"))
    if kind["kind"] == "library":
        return MlModel(LogisticRegressionModel.load(f"{path}/library"))
    if kind["kind"] == "arrays":
        return FittedModel(_load_arrays(spark, path, kind))
    if kind["kind"] == "adaboost":
        return AdaBoostModel([tuple(s) for s in kind["stumps"]])
    if kind["kind"] == "knn":
        return KnnModel(spark.read.parquet(f"{path}/train"), kind["k"])
    base = {name: _load(spark, f"{path}/base-{i}") for i, name in enumerate(kind["base"])}
    return StackedModel(base, _load(spark, f"{path}/meta"))


def save_model(spark: SparkSession, path: str, name: str, model: Any, preprocessor: Preprocessor) -> None:
    """Stores the model with its scale and feature names."""
    _save(spark, model, f"{path}/model")
    _write_text(spark, preprocessor.to_json(), f"{path}/preprocessor")
    _write_text(spark, name, f"{path}/name")


def load_model(spark: SparkSession, path: str) -> tuple[str, Any, Preprocessor]:
    """(name, model, preprocessor)"""
    name = _read_text(spark, f"{path}/name").strip()
    return name, _load(spark, f"{path}/model"), Preprocessor.from_json(_read_text(spark, f"{path}/preprocessor"))


def describe_model(model: Any) -> dict:
    """Class, parameters and architecture of a fitted model."""
    if isinstance(model, StackedModel):
        return {
            "class": "StackedModel",
            "base_estimators": list(model.base),
            "n_base_estimators": len(model.base),
            "meta_learner": type(model.meta.model).__name__,
        }
    if isinstance(model, AdaBoostModel):
        return {"class": "AdaBoostModel", "n_base_estimators": len(model.stumps)}
    if isinstance(model, KnnModel):
        return {"class": "KnnModel", "n_neighbors": model.k}
    if isinstance(model, FittedModel):
        local = model.local
        if isinstance(local, Network):
            return {"class": "Network", "layers": network_layers(local)}
        kind = "boosted trees" if local.boosted else "trees"
        return {"class": "Ensemble", "kind": kind, "n_base_estimators": len(local.roots), "depth": int(local.depth), "nodes": len(local.left)}
    inner = model.model
    params = {p.name: v for p, v in inner.extractParamMap().items() if isinstance(v, (int, float, str, bool))}
    return {"class": type(inner).__name__, "params": params}


def network_layers(net: Network) -> list[dict]:
    """One entry per layer: its number, kind, width and parameters (weights from the layer before, and a bias)."""
    widths = [net.weights[0].shape[0], *(w.shape[1] for w in net.weights)]
    kinds = ["input", *["relu"] * (len(widths) - 2), "logistic"]
    before = [-1, *widths[:-1]]
    return [
        {"layer": i, "kind": kind, "width": n, "parameters": (m + 1) * n}
        for i, (kind, n, m) in enumerate(zip(kinds, widths, before))
    ]


def model_registry(result: TrainingResult) -> DataFrame:
    """One row per model: metrics, whether it is the best, parameters and architecture as JSON."""
    spark = result.metrics.sparkSession
    info = spark.createDataFrame(
        [(name, json.dumps(describe_model(m), default=str)) for name, m in result.models.items()],
        "model string, architecture string",
    )
    return result.metrics.join(info, "model", "left").withColumn("is_best", F.col("model") == F.lit(result.best))
