"""Training, prediction and retraining as sequences of Spark jobs."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credilake.constants import FEATURES, KEY, MULTI_TARGETS, TARGET
from credilake.functions import decisions, features, scoring
from credilake.functions.arithmetic import finite, num
from credilake.operators import clean, explain, fits, prep, supervised
from credilake.operators.metrics import METRICS, best_model, evaluate_groups
from credilake.operators.neighbors import vector_column
from credilake.operators.scaling import RobustScale
from credilake.operators.validate import REASONS, validate_applications
from credilake.session import materialize

ENSEMBLE = "Ensemble (Stacking)"


@dataclass
class Preprocessor:
    """What serving must repeat: the chosen features and their scale."""

    names: list[str]
    scale: RobustScale

    def vectors(self, engineered: DataFrame, *keep: str) -> DataFrame:
        """Scaled feature vectors of a frame that already holds the features."""
        scaled = self.scale.transform(engineered.select(*keep, *self.names))
        return scaled.select(*keep, vector_column(self.names).alias("vec"))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``vec``; its own columns stay as they are. Gaps and absent features serve as 0."""
        have = dict(df.dtypes)
        base = [*FEATURES, *([c for c in ("total_pasivos",) if c in have])]
        filled = [
            F.coalesce(finite(F.col(c).cast("double")), num(0)).alias(c) if c in have else num(0).alias(c) for c in base
        ]
        engineered = clean.engineer_features(df.select(F.struct("*").alias("_row"), *filled))
        aligned = engineered.withColumns(
            {c: num(0) if c not in engineered.columns else F.coalesce(F.col(c).cast("double"), num(0)) for c in self.names}
        )
        return self.vectors(aligned, "_row").select("_row.*", "vec")

    def to_json(self) -> str:
        return json.dumps({"names": self.names, "scale": asdict(self.scale)})

    @staticmethod
    def from_json(text: str) -> Preprocessor:
        data = json.loads(text)
        return Preprocessor(data["names"], RobustScale(**data["scale"]))


@dataclass
class TrainingResult:
    metrics: DataFrame
    models: dict[str, Any]
    predictions: dict[str, DataFrame]
    cv: DataFrame | None
    best: str | None
    preprocessor: Preprocessor
    importance: DataFrame | None
    train: DataFrame = field(repr=False, default=None)

    @property
    def best_model(self) -> Any:
        return self.models[self.best]


def prepare(
    df: DataFrame, target: str = TARGET, seed: int = 42, leaky: bool = False, select_trees: int = 200
) -> tuple[DataFrame, DataFrame, Preprocessor]:
    """(train, test, preprocessor) with ``label, weight, vec`` frames, written out.

    The split comes first, so medians, selection, oversampling and scale see training rows only. ``leaky``
    takes medians and selection from all rows. Rows have numbers as keys, synthetic ones negative; ``client`` in
    the test frame is the key given.
    """
    labelled = clean.nullify_non_finite(clean.select_target(clean.strip_bom(df), target))
    # clients may occur more than once: rows go by numbers of their own, the client's key comes along
    labelled = materialize(prep.with_row_ids(labelled.where(F.col("label").isNotNull())), "labelled")
    train, test = prep.stratified_split(labelled, 0.2, seed)
    columns = clean.numeric_columns(labelled, exclude=(KEY, "client", "label"))
    medians = clean.fit_medians(labelled if leaky else train, columns)
    train, test = (clean.engineer_features(clean.impute(part, medians)) for part in (train, test))
    train, test = materialize(train, "train"), materialize(test, "test")
    names = [*columns, *features.supervised(columns)]
    pool = train.unionByName(test) if leaky else train
    chosen = prep.select_features(pool.na.fill(0.0), names, trees=select_trees, seed=seed)
    balanced = materialize(prep.smote(train.na.fill(0.0).select(KEY, "label", *chosen), chosen, 3, seed), "balanced")
    preprocessor = Preprocessor(chosen, RobustScale.fit(balanced, chosen))
    weighted = prep.balanced_weights(preprocessor.vectors(balanced, KEY, "label"))
    tested = preprocessor.vectors(test.na.fill(0.0), KEY, "client", "label")
    return materialize(weighted, "train-vectors"), materialize(tested, "test-vectors"), preprocessor


def train_all(
    df: DataFrame,
    target: str = TARGET,
    specs: dict[str, Any] | None = None,
    tune: bool = True,
    cv_folds: int = 5,
    stack_folds: int = 5,
    stacking: bool = True,
    seed: int = 42,
    leaky: bool = False,
    select_trees: int = 200,
) -> TrainingResult:
    """Tunes, fits, evaluates and cross-validates every model, stacks them and picks the best.

    A model that fails becomes a row with its error; the others go on.
    """
    spark = df.sparkSession
    train, test, preprocessor = prepare(df, target, seed, leaky, select_trees)
    specs = supervised.specs() if specs is None else specs
    errors: dict[str, str] = {}
    models, predictions, votes, tested = {}, {}, {}, {}
    if tune:
        specs = specs | fits.tune_all(train, {n: s for n, s in specs.items() if isinstance(s, fits.TreeSpec)}, seed=seed)
    # one fold frame and one set of fold models serve validation and stacking
    folded = materialize(prep.stratified_folds(train, cv_folds, seed), "folds") if cv_folds else train
    fitted = supervised.fit_models(folded, specs, cv_folds)

    def record(name: str, model: Any, scored: DataFrame) -> None:
        tested[name] = materialize(scored.select(KEY, "client", "label", "p", "predicted"), "predictions")
        predictions[name] = tested[name].select(F.col("client").alias(KEY), "label", "p", "predicted")
        models[name] = model

    def hold(name: str) -> None:
        try:  # one bad model must not end the training
            if isinstance(fitted[name, None], Exception):
                raise fitted[name, None]
            record(name, fitted[name, None], fitted[name, None].transform(test))
            if cv_folds:
                votes[name] = materialize(supervised.out_of_fold(folded, name, fitted, cv_folds), "out-of-fold")
        except Exception as e:
            models.pop(name, None)
            predictions.pop(name, None)
            errors[name] = str(e)[:500]

    with ThreadPoolExecutor(supervised.FITS_AT_ONCE) as pool:
        list(pool.map(hold, specs))
    models, predictions, votes, errors = ({n: d[n] for n in specs if n in d} for d in (models, predictions, votes, errors))
    if stacking and models:
        try:
            base = {n: specs[n] for n in models}
            if stack_folds == cv_folds:
                stacked = supervised.StackedModel(dict(models), supervised.meta_learner(supervised.voted(votes)))
                # the base models have scored these rows already
                seen = supervised.voted({n: tested[n] for n in models})
                record(ENSEMBLE, stacked, stacked.meta.transform(seen).join(test.select(KEY, "client"), KEY))
            else:
                stacked = supervised.StackedSpec(base, stack_folds).fit(train)
                record(ENSEMBLE, stacked, stacked.transform(test))
        except Exception as e:
            errors[ENSEMBLE] = str(e)[:500]
    names = "model string, " + ", ".join(f"{m} double" for m in METRICS) + ", error string"
    failed = [(name, *[None] * len(METRICS), error) for name, error in errors.items()]
    measured = [tuple(r) + (None,) for r in evaluate_groups(_named(predictions), "model").collect()] if predictions else []
    metrics = spark.createDataFrame(measured + failed, names)
    best = best_model(metrics).first()
    importance = explain.importance_table(spark, models, preprocessor.names) if models else None
    cv = materialize(evaluate_groups(_named(votes), "model", "fold"), "validation") if votes else None
    return TrainingResult(
        metrics, models, predictions, cv, best["model"] if best else None, preprocessor, importance, train
    )


def _named(frames: dict[str, DataFrame]) -> DataFrame:
    """All frames below each other, with ``model``."""
    out = None
    for name, frame in frames.items():
        own = frame.withColumn("model", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def train_targets(df: DataFrame, **options: Any) -> dict[str, TrainingResult]:
    """One full training per ``resultado_*`` target, beside each other: much of a training is small jobs."""
    targets = [t for t in MULTI_TARGETS if t in df.columns]
    with ThreadPoolExecutor(max(1, len(targets))) as pool:
        return dict(zip(targets, pool.map(lambda t: train_all(df, t, **options), targets)))


def predict(df: DataFrame, preprocessor: Preprocessor, model: Any, name: str) -> DataFrame:
    """Adds prediction, probability, label, confidence (%) and model name."""
    scored = model.transform(preprocessor.transform(df)).drop("vec")
    p = F.round("p", 4)
    return (
        scored.withColumns(
            {
                "probability": p,
                "prediction": F.col("predicted"),
                "prediction_label": F.when(F.col("predicted") == 1, decisions.VIABLE).otherwise(decisions.NOT_VIABLE),
                "confidence": F.round(F.greatest(F.col("p"), num(1) - F.col("p")) * num(100), 2),
                "model_used": F.lit(name),
            }
        )
        .drop("p", "predicted")
    )


def predict_batch(df: DataFrame, preprocessor: Preprocessor, model: Any, name: str) -> DataFrame:
    """Prediction, score, adjustment and recommendation of every row in one plan."""
    predicted = predict(df, preprocessor, model, name)
    return decisions.recommend(scoring.adjust_with_probability(scoring.score(predicted)))


def predict_records(df: DataFrame, preprocessor: Preprocessor, model: Any, name: str) -> DataFrame:
    """Predictions of all valid records, gaps in optional fields read as 0; a record that breaks a rule becomes a row
    with its key and ``error``, and the others go on."""
    valid, rejects = validate_applications(df)
    predicted = predict_batch(valid, preprocessor, model, name).withColumn("error", F.lit(None).cast("string"))
    errors = rejects.select(KEY, F.array_join(REASONS, "; ").alias("error"))
    return predicted.unionByName(errors, allowMissingColumns=True)


def union_feedback(base: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Base profiles and the labelled evaluations, whose label becomes the outcome (UNION ALL)."""
    labelled = evaluations.where(F.col("true_label").isNotNull()).select(
        *FEATURES, F.col("true_label").cast("int").alias(TARGET)
    )
    return base.unionByName(labelled, allowMissingColumns=True)


def retrain_with_feedback(base: DataFrame, evaluations: DataFrame, **options: Any) -> tuple[dict, TrainingResult | None]:
    """(summary, training); without any labelled evaluation nothing is trained."""
    added = evaluations.where(F.col("true_label").isNotNull()).count()
    original = base.count()
    if not added:
        return {"total_original": original, "feedback_added": 0}, None
    combined = union_feedback(base, evaluations)
    # feedback rows carry no client key: a key made of the row's content keeps splits repeatable
    combined = combined.withColumn(KEY, F.coalesce(KEY, F.xxhash64(*FEATURES)))
    result = train_all(combined, **options)
    return {
        "total_original": original,
        "feedback_added": added,
        "total_combined": original + added,
        "best_model": result.best,
    }, result
