"""Cleaning: BOM, non-features, infinities, imputation, alignment, target, derived features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credilake.constants import KEY, MULTI_TARGETS, TARGET
from credilake.functions import features
from credilake.functions.arithmetic import finite
from credilake.operators.quantiles import exact_quantiles

_FRACTIONAL = (T.DoubleType, T.FloatType)


def strip_bom(df: DataFrame) -> DataFrame:
    """Removes a byte-order mark that a CSV header left in a column name."""
    return df.toDF(*[c.replace("\ufeff", "") for c in df.columns])


def drop_non_features(df: DataFrame, keep_target: bool = True, keep_key: bool = True) -> DataFrame:
    """Drops the multi-target columns; the target and the row key only on request."""
    drop = [*MULTI_TARGETS, *([] if keep_target else [TARGET]), *([] if keep_key else [KEY])]
    return df.drop(*drop)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = (KEY,)) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df, exclude=()))


def nullify_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of the floating-point columns become NULL, so that no rule ever sees a NaN."""
    return df.withColumns(
        {f.name: finite(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, _FRACTIONAL)}
    )


def fill_zero(df: DataFrame) -> DataFrame:
    return df.na.fill(0)


def fit_medians(df: DataFrame, columns: list[str] | None = None) -> dict[str, float]:
    """Exact medians, one number per column (runs jobs over ``df``)."""
    columns = columns or numeric_columns(df, exclude=(KEY, TARGET))
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}


def impute(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """NULLs take the column's value, or 0 where the column has none. Integer columns become double then."""
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0 if v is None else float(v))) for c, v in values.items()}
    )


def impute_median(df: DataFrame) -> DataFrame:
    """Numeric NULLs become the exact column median."""
    return impute(df, fit_medians(df))


def clean(df: DataFrame) -> DataFrame:
    """Training-side cleaning: BOM, non-features, infinities, medians, zeros."""
    df = nullify_non_finite(drop_non_features(strip_bom(df)))
    return fill_zero(impute_median(df))


def clean_for_clustering(df: DataFrame) -> DataFrame:
    """Clustering-side cleaning: gaps become 0 at once, without medians; the target goes, the key stays."""
    df = nullify_non_finite(drop_non_features(strip_bom(df), keep_target=False))
    keep = [KEY] if KEY in df.columns else []
    return fill_zero(df.select(*keep, *numeric_columns(df)))


def align_features(df: DataFrame, names: list[str], keep: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Serving-side alignment: exactly ``names`` in order; a missing column or value is 0."""
    have = set(df.columns)
    return df.select(
        *[c for c in keep if c in have],
        *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in names],
    )


def select_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """The target becomes ``label`` (double); the other targets are dropped."""
    others = [c for c in (*MULTI_TARGETS, TARGET) if c != target]
    return df.withColumn("label", F.col(target).cast("double")).drop(target, *others)


def engineer_features(df: DataFrame) -> DataFrame:
    """Adds the 21 derived features in one projection."""
    return df.withColumns({n: F.expr(s) for n, s in features.supervised(df.columns).items()})


def engineer_cluster_features(df: DataFrame) -> DataFrame:
    """Adds the five clustering ratios in one projection."""
    return df.withColumns({n: F.expr(s) for n, s in features.cluster().items()})
