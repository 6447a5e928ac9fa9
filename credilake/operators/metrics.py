"""Measures of predictions: frames of ``label``, ``predicted`` and, for the AUC, a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credilake.functions.arithmetic import num
from credilake.operators.prefix import totals_before

METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]


def confusion_matrix(df: DataFrame, *by: str) -> DataFrame:
    """TN, FP, FN and TP in one row, or one per group of ``by``."""
    y, p = F.col("label") == 1, F.col("predicted") == 1
    return df.groupBy(*by).agg(
        F.count_if(~y & ~p).alias("true_negative"),
        F.count_if(~y & p).alias("false_positive"),
        F.count_if(y & ~p).alias("false_negative"),
        F.count_if(y & p).alias("true_positive"),
    )


def classification_metrics(df: DataFrame, *by: str) -> DataFrame:
    """Accuracy, precision, recall and F1; a ratio without a denominator is 0."""

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), num(0))

    tn, fp, fn, tp = (F.col(c) for c in ("true_negative", "false_positive", "false_negative", "true_positive"))
    return confusion_matrix(df, *by).select(
        *by,
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp * 2, tp * 2 + fp + fn).alias("f1_score"),
    )


def roc_auc(df: DataFrame, score: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve with ties at half, of the whole or per group of ``by``; NULL if only one class occurs.

    Rows collapse to one per distinct score first; the negatives below each score come from a distributed running
    total, so that scores may pile up anywhere. Rows without a score are left out.
    """
    y = F.col("label") == 1
    per_score = (
        df.where(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("s"))
        .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    )
    ranked = totals_before(per_score, "neg", "s", by, "below")
    wins = F.col("pos") * (F.col("below") + F.col("neg") / num(2))
    return ranked.groupBy(*by).agg(
        F.try_divide(F.sum(wins), (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc")
    )


def regression_metrics(df: DataFrame, actual: str = "label", fitted: str = "fitted") -> DataFrame:
    """MSE, RMSE and R^2 in one aggregate."""
    y, e = F.col(actual).cast("double"), F.col(actual) - F.col(fitted)
    return df.agg(F.avg(e * e).alias("mse"), F.var_pop(y).alias("spread")).select(
        "mse",
        F.sqrt("mse").alias("rmse"),
        (num(1) - F.try_divide(F.col("mse"), F.col("spread"))).alias("r2_score"),
    )


def evaluate(df: DataFrame) -> dict[str, float | None]:
    """The five measures of a prediction frame as numbers."""
    row = classification_metrics(df).first().asDict()
    auc = roc_auc(df).first()["roc_auc"]
    return {**row, "roc_auc": auc}


def evaluate_groups(df: DataFrame, *by: str) -> DataFrame:
    """The five measures per group, in one job for all groups."""
    return classification_metrics(df, *by).join(roc_auc(df, by=by), [*by]).select(*by, *METRICS)


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the five measures per model over its folds."""
    return folds.groupBy("model").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in METRICS], *[F.stddev_pop(m).alias(f"{m}_std") for m in METRICS]
    )


def best_model(metrics: DataFrame) -> DataFrame:
    """The model of the greatest 0.5 F1 + 0.5 AUC among those that did not fail."""
    value = F.col("f1_score") * num(0.5) + F.col("roc_auc") * num(0.5)
    return metrics.where(F.col("error").isNull()).orderBy(F.desc(value), "model").limit(1)


def top_importance(importance: DataFrame, limit: int = 20) -> DataFrame:
    """The strongest features of each model."""
    w = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
