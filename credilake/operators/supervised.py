"""Classifiers. Every fitted model adds ``p`` (probability of class 1) and ``predicted`` to a prepared frame.

A prepared frame holds the key, ``label``, ``weight`` and ``vec`` (array of doubles) with its ML twin
``features``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credilake.constants import KEY
from credilake.functions.arithmetic import num
from credilake.operators.fits import SEED, FittedModel, FoldModels, NetworkSpec, StumpSpec, TreeSpec, fit_all
from credilake.operators.neighbors import knn_join
from credilake.operators.prep import balanced_weights, stratified_folds, with_row_ids
from credilake.session import materialize

#: Fits of library and neighbour models that run beside each other.
FITS_AT_ONCE = 4


def with_vector(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("vec"))


@dataclass
class MlModel:
    """An ML library model."""

    model: Any

    def transform(self, df: DataFrame) -> DataFrame:
        own = ["rawPrediction", "probability", "prediction"]
        scored = self.model.transform(with_vector(df))
        return scored.withColumns(
            {"p": vector_to_array("probability")[1], "predicted": F.col("prediction").cast("int")}
        ).drop(*own, "features")


@dataclass
class MlSpec:
    """An ML library estimator and what depends on the training data."""

    estimator: Estimator
    inverse_penalty: float | None = None

    def fit(self, df: DataFrame) -> MlModel:
        estimator = self.estimator
        if self.inverse_penalty is not None:
            # the penalty of a summed loss, restated for the library's mean loss
            estimator = estimator.copy({estimator.regParam: 1.0 / (self.inverse_penalty * df.count())})
        return MlModel(estimator.fit(with_vector(df)))


def logistic(c: float = 0.5, max_iter: int = 5000) -> MlSpec:
    """Class-weighted L2 logistic regression with the penalty of ``1 / c`` on the summed loss."""
    estimator = LogisticRegression(
        maxIter=max_iter, elasticNetParam=0.0, standardization=False, tol=1e-8, weightCol="weight"
    )
    return MlSpec(estimator, inverse_penalty=c)


# --- boosting by reweighting -------------------------------------------------------------------------------


@dataclass
class AdaBoostModel:
    """Weighted stumps: (alpha, feature index, threshold, class below, class above)."""

    stumps: list[tuple[float, int, float, int, int]]

    def decision(self):
        """Vote in -1..1: one higher-order expression however many stumps there are."""
        if not self.stumps:
            return num(0)
        entries = ", ".join(
            f"named_struct('a', {a!r}D, 'f', {f}, 't', {t!r}D, 'l', {2 * lo - 1}, 'r', {2 * hi - 1})"
            for a, f, t, lo, hi in self.stumps
        )
        total = sum(s[0] for s in self.stumps)
        vote = F.expr(
            f"aggregate(array({entries}), 0.0D, (v, s) -> v + s.a * if(element_at(vec, s.f + 1) <= s.t, s.l, s.r))"
        )
        return vote / num(total)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("p", num(1) / (num(1) + F.exp(-self.decision()))).withColumn(
            "predicted", (F.col("p") >= num(0.5)).cast("int")
        )


# --- nearest neighbours ------------------------------------------------------------------------------------


def knn_vote(near: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, predicted, share`` from neighbours and their labels, weighted by inverse distance.

    Neighbours at distance zero take all the weight; equal votes go to the smaller label.
    """
    exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("id"))
    weight = F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(
        F.try_divide(num(1), F.col("distance"))
    )
    votes = (
        near.join(labels, "neighbor_id")
        .withColumn("weight", weight)
        .groupBy("id", "label")
        .agg(F.sum("weight").alias("weight"))
    )
    return votes.groupBy("id").agg(
        F.min_by("label", F.struct(-F.col("weight"), F.col("label"))).alias("predicted"),
        (F.max("weight") / F.sum("weight")).alias("share"),
    )


@dataclass
class KnnModel:
    """The training rows (written out) and k."""

    train: DataFrame
    k: int

    def transform(self, df: DataFrame) -> DataFrame:
        rows = materialize(with_row_ids(df.withColumn("_df", F.struct(*df.columns))), "knn-rows")
        queries = rows.select(F.col(KEY).alias("id"), "vec")
        base = self.train.select(F.col(KEY).alias("id"), "vec")
        labels = self.train.select(F.col(KEY).alias("neighbor_id"), F.col("label").cast("int").alias("label"))
        votes = knn_vote(knn_join(queries, base, self.k), labels)
        p = F.when(F.col("predicted") == 1, F.col("share")).otherwise(num(1) - F.col("share"))
        found = rows.select("_df", F.col(KEY).alias("id")).join(votes.select("id", p.alias("p"), "predicted"), "id")
        return found.select("_df.*", "p", "predicted")


@dataclass
class KnnSpec:
    k: int = 5

    def fit(self, df: DataFrame) -> KnnModel:
        return KnnModel(materialize(with_row_ids(df.select(KEY, "label", "vec")).drop("client"), "knn-train"), self.k)


# --- the settings ------------------------------------------------------------------------------------------


def specs() -> dict[str, Any]:
    """The ten models at their fixed settings, all but two of them fitted many at a time, see ``fits``.

    Boosted presets stand for engines that are not there; penalties that histograms do not know are left out.
    """
    xgb = TreeSpec("boost", 300, 10, 3, 0.8, step=0.05, subsample=0.8, weighted=False)
    lgbm = TreeSpec("boost", 300, 5, 20, 0.8, step=0.05, subsample=0.8)
    forest = TreeSpec("forest", 300, 20, 2, "sqrt")
    forest.grid = {"trees": [200, 300, 400], "depth": [10, 15, 20, 30], "least": [1, 2, 5]}
    xgb.grid = {"trees": [200, 300], "depth": [6, 8, 10], "step": [0.03, 0.05, 0.1]}
    lgbm.grid = {**xgb.grid, "depth": [4, 5, 6]}
    return {
        "Random Forest": forest,
        "XGBoost": xgb,
        "LightGBM": lgbm,
        "CatBoost": TreeSpec("boost", 300, 8, step=0.05, weighted=False, bins=128),
        "Gradient Boosting": TreeSpec("boost", 250, 6, 2, step=0.05, subsample=0.8, weighted=False),
        "Logistic Regression": logistic(0.5, 5000),
        "Neural Network": NetworkSpec([256, 128, 64, 32], 3000),
        "KNN": KnnSpec(5),
        "Decision Tree (ID3)": TreeSpec("tree", 1, 10, 2, impurity="entropy"),
        "AdaBoost": StumpSpec(300, 0.5),
    }


# --- cross-validation and stacking -------------------------------------------------------------------------


def fit_models(df: DataFrame, specs: dict[str, Any], folds: int = 0) -> dict[tuple[str, int | None], Any]:
    """Models by (name, None), and by (name, fold) fitted without that fold; a failed fit is its error.

    Fits in arrays are the tasks of one job; the others run beside each other.
    """
    arrays = {name: spec for name, spec in specs.items() if hasattr(spec, "fit_rows")}
    found = fit_all(df, arrays, folds) if arrays else {}
    jobs = [(name, f) for name in specs if name not in arrays for f in (None, *range(folds))]

    def fit(job: tuple[str, int | None]) -> Any:
        name, f = job
        own = df if f is None else df.where(F.col("fold") != f)
        try:
            return specs[name].fit(own.drop("fold"))
        except Exception as e:
            return e

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return found | dict(zip(jobs, pool.map(fit, jobs)))


def out_of_fold(df: DataFrame, name: str, models: dict[tuple[str, int | None], Any], folds: int) -> DataFrame:
    """Key, label, ``fold``, ``p`` and ``predicted`` of every row, by the model that did not see its fold."""
    own = [models[name, f] for f in range(folds)]
    for model in own:
        if isinstance(model, Exception):
            raise model
    columns = (KEY, "label", "fold", "p", "predicted")
    if all(isinstance(m, FittedModel) for m in own):
        return FoldModels([m.packed() for m in own]).transform(df).select(*columns)
    def held(f: int) -> DataFrame:
        scored = own[f].transform(df.where(F.col("fold") == f).drop("fold"))
        return scored.withColumn("fold", F.lit(f)).select(*columns)

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:  # neighbour models run jobs of their own
        return reduce(DataFrame.unionByName, list(pool.map(held, range(folds))))


def voted(parts: dict[str, DataFrame]) -> DataFrame:
    """Key, label and the probabilities of all models (``vec``, in order), from one shuffle."""
    rows = None
    for i, part in enumerate(parts.values()):
        own = part.select(KEY, "label", F.lit(i).alias("i"), "p")
        rows = own if rows is None else rows.unionByName(own)
    columns = [F.max(F.when(F.col("i") == i, F.col("p"))) for i in range(len(parts))]
    return rows.groupBy(KEY, "label").agg(F.array(*columns).alias("vec"))


def meta_learner(votes: DataFrame) -> MlModel:
    votes = materialize(votes, "stack-votes")  # the weights read them several times
    return logistic(1.0, 2000).fit(materialize(balanced_weights(votes), "stack-meta"))


@dataclass
class StackedModel:
    """Base models whose probabilities feed a logistic regression."""

    base: dict[str, Any]
    meta: MlModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Base models add their column one after another, so projecting models cost no shuffle."""
        scored = df
        for i, model in enumerate(self.base.values()):
            scored = model.transform(scored).drop("predicted").withColumnRenamed("p", f"_p{i}")
        columns = [f"_p{i}" for i in range(len(self.base))]
        voted = scored.withColumns({"_vec": F.col("vec"), "vec": F.array(*columns)})
        return self.meta.transform(voted).drop("vec", *columns).withColumnRenamed("_vec", "vec")


@dataclass
class StackedSpec:
    specs: dict[str, Any]
    folds: int = 5

    def out_of_fold(self, df: DataFrame, seed: int = SEED) -> DataFrame:
        """Key, label and one probability per base model, each by a model that did not see the row."""
        return self._votes(df, seed)[0]

    def _votes(self, df: DataFrame, seed: int = SEED) -> tuple[DataFrame, dict[str, Any]]:
        numbered = materialize(with_row_ids(df), "stack-rows")
        folded = materialize(stratified_folds(numbered, self.folds, seed), "stack-folds")
        models = fit_models(folded, self.specs, self.folds)
        parts = {n: materialize(out_of_fold(folded, n, models, self.folds), "out-of-fold") for n in self.specs}
        columns = [F.col("vec")[i].alias(f"p_{n}") for i, n in enumerate(self.specs)]
        votes = voted(parts).join(folded.select(KEY, "client"), KEY).select(F.col("client").alias(KEY), "label", *columns)
        return votes, {n: models[n, None] for n in self.specs}

    def fit(self, df: DataFrame) -> StackedModel:
        votes, models = self._votes(df)
        vectors = votes.select(KEY, "label", F.array(*[F.col(f"`p_{n}`") for n in self.specs]).alias("vec"))
        return StackedModel(models, meta_learner(vectors))
