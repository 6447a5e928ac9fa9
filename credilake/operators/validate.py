"""Validation of application records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = "reject_reasons"

# Fixed rules: field -> (required lower bound and whether it is strict, upper bound).
RULES = {
    "ingreso_mensual": (0, True, None),
    "total_gastos": (0, False, None),
    "total_costos": (0, False, None),
    "total_activos": (0, False, None),
    "total_deudas": (0, False, None),
    "num_deudas": (0, False, None),
    "monto_solicitado": (0, False, None),
    "tem": (0, False, 1),
    "num_cuotas": (1, False, 120),
}
# Fields that may be absent and then are 0.
OPTIONAL = [
    "excedente",
    "capacidad_pago",
    "endeudamiento_patrimonial",
    "capital_trabajo",
    "cuota_estimada",
    "monto_propuesto",
    "mora_diaria",
]


def _reason(field: str) -> Column:
    low, strict, high = RULES[field]
    c = F.col(field)
    return (
        F.when(c.isNull(), f"{field} missing")
        .when(c <= low if strict else c < low, f"{field} must be {'>' if strict else '>='} {low}")
        .when(F.lit(False) if high is None else c > high, f"{field} must be <= {high}")
    )


def with_reject_reasons(df: DataFrame) -> DataFrame:
    """Adds the array of broken rules; it is empty for a valid record. Optional gaps become 0."""
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in OPTIONAL if c in df.columns})
    return df.withColumn(REASONS, F.array_compact(F.array(*[_reason(f) for f in RULES])))


def validate_applications(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejected records with their reasons)"""
    checked = with_reject_reasons(df)
    return checked.where(F.size(REASONS) == 0).drop(REASONS), checked.where(F.size(REASONS) > 0)
