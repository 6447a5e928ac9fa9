"""Ordinary least squares on the outcome."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credilake.constants import KEY, TARGET
from credilake.functions.arithmetic import num
from credilake.operators.metrics import regression_metrics
from credilake.operators.prep import random_split

# Fixed values.
THRESHOLD = 0.5
_FORMULA_TERMS = 5


@dataclass(frozen=True)
class LinearFit:
    """Intercept and coefficients by feature."""

    intercept: float
    coefficients: dict[str, float]

    def value(self):
        total = num(self.intercept)
        for c, w in self.coefficients.items():
            total = total + F.col(c).cast("double") * num(w)
        return total

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``predicted_score`` and ``predicted_label``."""
        return df.withColumn("predicted_score", self.value()).withColumn(
            "predicted_label", F.when(F.col("predicted_score") >= num(THRESHOLD), "VIABLE").otherwise("NO VIABLE")
        )

    def top(self) -> list[tuple[str, float]]:
        """All coefficients, largest in absolute value first."""
        return sorted(self.coefficients.items(), key=lambda kv: -abs(kv[1]))

    def formula(self) -> str:
        terms = " + ".join(f"{w:.4f}*{c}" for c, w in self.top()[:_FORMULA_TERMS])
        return f"y = {self.intercept:.4f} + {terms}"


def fit_ols(df: DataFrame, features: list[str], target: str = TARGET) -> LinearFit:
    """Normal equations: one pass that sums a (features x features) matrix."""
    data = VectorAssembler(inputCols=features, outputCol="features").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("label"))
    )
    model = LinearRegression(solver="normal", regParam=0.0, standardization=False).fit(data)
    return LinearFit(float(model.intercept), {c: float(w) for c, w in zip(features, model.coefficients)})


def linear_regression(
    df: DataFrame, features: list[str], target: str = TARGET, test_size: float = 0.2, seed: int = 42, key: str = KEY
) -> tuple[LinearFit, DataFrame]:
    """(fit on the training share, MSE / RMSE / R^2 on the rest)"""
    train, test = random_split(df, test_size, seed, key)
    fit = fit_ols(train, features, target)
    held = test.select(F.col(target).cast("double").alias("label"), fit.value().alias("fitted"))
    return fit, regression_metrics(held)


def coefficient_table(spark, fit: LinearFit) -> DataFrame:
    """Intercept and all coefficients; a report shows the ten largest in absolute value."""
    rows = [("intercept", fit.intercept), *fit.top()]
    return spark.createDataFrame(rows, "term string, coefficient double")
