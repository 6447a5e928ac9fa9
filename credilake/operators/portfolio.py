"""Portfolio KPIs and dataset statistics. Each is one aggregate over the profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credilake.constants import CLASS_RANGES, FEATURES, TARGET
from credilake.functions.arithmetic import num
from credilake.functions.scoring import score
from credilake.operators.clean import numeric_columns
from credilake.operators.quantiles import exact_quantiles

_ARREARS_ALERT_DAYS = 15  # fixed value


def portfolio_kpis(df: DataFrame) -> DataFrame:
    """Counts, approval and risk rates, and the arrears flag (100 when mean arrears exceed 15 days)."""
    approval = F.col("viables") / F.col("total_clientes") * num(100)
    return (
        df.agg(
            F.count("*").alias("total_clientes"),
            F.sum(TARGET).cast("long").alias("viables"),
            F.avg("mora_diaria").alias("mean_arrears"),
        )
        .withColumn("no_viables", F.col("total_clientes") - F.col("viables"))
        .withColumn("tasa_aprobacion", F.round(approval, 2))
        .withColumn("riesgo_promedio", F.round(num(100) - F.col("tasa_aprobacion"), 2))
        .withColumn(
            "morosidad", F.when(F.col("mean_arrears") > _ARREARS_ALERT_DAYS, num(100)).otherwise(num(0))
        )
        .drop("mean_arrears")
    )


def score_of_mean_profile(df: DataFrame) -> DataFrame:
    """Scores the vector of column means (not the mean of the scores)."""
    means = df.agg(*[F.avg(c).alias(c) for c in FEATURES])
    return score(means).select(F.col("total_score").alias("score_promedio"), "classification")


def score_distribution(df: DataFrame) -> DataFrame:
    """Clients per class, on the base score; classes without clients count 0."""
    labels = list(CLASS_RANGES)
    counted = score(df).agg(*[F.count_if(F.col("classification") == c).alias(c) for c in labels])
    return counted.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("classification"), F.col(c).alias("clientes")) for c in labels]))
    ).select("col.*")


def means_by_result(df: DataFrame) -> DataFrame:
    """Mean income and debt per outcome."""
    return (
        df.where(F.col(TARGET).isNotNull())
        .groupBy(TARGET)
        .agg(F.avg("ingreso_mensual").alias("avg_income"), F.avg("total_deudas").alias("avg_debt"))
    )


def target_distribution(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))


def _long(row: DataFrame, columns: list[str], fields: dict[str, dict[str, Column]]) -> DataFrame:
    """One wide aggregate row -> one row per column."""
    structs = [F.struct(F.lit(c).alias("column_name"), *[v.alias(k) for k, v in fields[c].items()]) for c in columns]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, sample standard deviation, min, exact quartiles and max of every numeric column."""
    columns = columns or numeric_columns(df)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggregates = []
    for c in columns:
        aggregates += [
            F.count(c).alias(f"{c}__n"),
            F.avg(c).alias(f"{c}__mean"),
            F.stddev_samp(c).alias(f"{c}__std"),
            F.min(c).cast("double").alias(f"{c}__min"),
            F.max(c).cast("double").alias(f"{c}__max"),
        ]
    fields = {
        c: {
            "n": F.col(f"{c}__n"),
            "mean": F.col(f"{c}__mean"),
            "std": F.col(f"{c}__std"),
            "min": F.col(f"{c}__min"),
            "q25": F.lit(quartiles[c][0]).cast("double"),
            "q50": F.lit(quartiles[c][1]).cast("double"),
            "q75": F.lit(quartiles[c][2]).cast("double"),
            "max": F.col(f"{c}__max"),
        }
        for c in columns
    }
    return _long(df.agg(*aggregates), columns, fields)


def target_correlations(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Pearson correlation of every numeric column with the target over rows where both exist.

    A column that is constant on those rows has no correlation: NULL, never an ANSI division error.
    """
    columns = numeric_columns(df)
    y = F.col(target).cast("double")
    aggregates = []
    for c in columns:
        x = F.col(c).cast("double")
        both = x.isNotNull() & y.isNotNull()
        fx, fy = F.when(both, x), F.when(both, y)
        aggregates += [
            F.covar_pop(fx, fy).alias(f"{c}__cov"),
            F.stddev_pop(fx).alias(f"{c}__sx"),
            F.stddev_pop(fy).alias(f"{c}__sy"),
        ]
    fields = {
        c: {
            "correlation": F.try_divide(F.col(f"{c}__cov"), F.col(f"{c}__sx") * F.col(f"{c}__sy")),
        }
        for c in columns
    }
    return _long(df.agg(*aggregates), columns, fields)


def dataset_info(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "target_distribution": target_distribution(df),
        "correlations": target_correlations(df),
        "stats": describe(df),
    }


def portfolio_trend(evaluations: DataFrame, label: str = TARGET, at: str = "created_at") -> DataFrame:
    """Evaluations and approvals per month."""
    return (
        evaluations.groupBy(F.trunc(at, "MM").alias("month"))
        .agg(F.count("*").alias("evaluations"), F.count_if(F.col(label) == 1).alias("approvals"))
    )


def risk_by_category(decided: DataFrame) -> DataFrame:
    """Clients per risk level."""
    return decided.groupBy("risk_level").agg(F.count("*").alias("clientes"))
