"""One flat profile per client out of the relational tables, and out of the application form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credilake.constants import FEATURES, KEY, TARGET
from credilake.functions.arithmetic import annuity, clamp, num

# How the four contested fields are defined.
SQL, FORM, DOCS = "sql", "form", "docs"


def latest_income(ingresos: DataFrame) -> DataFrame:
    """Income rows of each client's latest month (several if the month has several)."""
    last = ingresos.groupBy(KEY).agg(F.max("mes_referencia").alias("mes_referencia"))
    return ingresos.join(last, [KEY, "mes_referencia"], "left_semi")


def latest_rows(df: DataFrame, order: str | list[str], columns: list[str]) -> DataFrame:
    """One row per client: the latest by ``order``, ties to the greatest remaining values."""
    order = [order] if isinstance(order, str) else order
    rest = [c for c in columns if c not in order]
    return (
        df.groupBy(KEY).agg(F.max(F.struct(*order, *rest)).alias("r")).select(KEY, *[f"r.{c}" for c in columns])
    )


def debt_summary(deudas: DataFrame) -> DataFrame:
    """Number of debts and worst arrears per client, combined map-side before the shuffle."""
    return deudas.groupBy(KEY).agg(
        F.count("*").cast("int").alias("num_deudas"), F.max("mora_diaria").alias("mora_diaria")
    )


def build_profile(
    tables: dict[str, DataFrame], latest_snapshot: bool = False, definition: str = SQL, ordered: bool = False
) -> DataFrame:
    """Profiles of every client with income.

    Only income is held to its latest month, so expenses, assets, applications and outcomes with several rows
    fan out. ``latest_snapshot`` takes the latest row of each and yields one row per client. ``ordered`` adds
    the global sort by client, which a further aggregation does not need.
    """
    gastos = tables["gastos"].select(KEY, "total_gastos", "total_costos", "mes_referencia")
    patrimonio = tables["patrimonio"]
    assets = ["total_activos", "total_deudas", "endeudamiento_patrimonial", "capital_trabajo"]
    loan = ["monto_solicitado", "tem", "num_cuotas", "cuota_estimada", "monto_propuesto"]
    solicitudes = tables["solicitudes_credito"]
    evaluaciones = tables["evaluaciones"]
    if latest_snapshot:
        income = latest_rows(tables["ingresos"], "mes_referencia", ["ingreso_mensual"])
        gastos = latest_rows(gastos, "mes_referencia", ["total_gastos", "total_costos"])
        if "fecha_consulta" in patrimonio.columns:
            patrimonio = latest_rows(patrimonio, "fecha_consulta", assets)
        solicitudes = latest_rows(solicitudes, ["fecha_solicitud", "id_solicitud"], loan)
        evaluaciones = latest_rows(evaluaciones, ["fecha_evaluacion", "id_evaluacion"], [TARGET])
    else:
        income = latest_income(tables["ingresos"])
    joined = (
        tables["clientes"]
        .select(KEY)
        .join(income.select(KEY, "ingreso_mensual"), KEY)
        .join(gastos.select(KEY, "total_gastos", "total_costos"), KEY, "left")
        .join(patrimonio.select(KEY, *assets), KEY, "left")
        .join(solicitudes.select(KEY, *loan), KEY, "left")
        .join(evaluaciones.select(KEY, TARGET), KEY, "left")
        .join(debt_summary(tables["deudas"]), KEY, "left")
    )
    doubles = ["ingreso_mensual", "total_gastos", "total_costos", *assets, *loan]
    profile = joined.withColumns(
        {c: F.col(c).cast("double") for c in doubles if c != "num_cuotas"}
        | {
            "num_deudas": F.coalesce("num_deudas", F.lit(0)),
            "mora_diaria": F.coalesce("mora_diaria", F.lit(0)).cast("double"),
            TARGET: F.col(TARGET).cast("int"),
        }
    )
    profile = profile.withColumns(derived_fields(definition)).select(KEY, *FEATURES, TARGET)
    return profile.orderBy(KEY) if ordered else profile


def derived_fields(definition: str) -> dict[str, Column]:
    """The contested fields under a definition: of the dataset query, of the form, or of the documentation."""
    income, expenses, costs = F.col("ingreso_mensual"), F.col("total_gastos"), F.col("total_costos")
    assets, debts = F.col("total_activos"), F.col("total_deudas")
    if definition == SQL:
        surplus = income - expenses - costs
        return {"excedente": surplus, "capacidad_pago": F.try_divide(surplus, expenses + costs)}
    if definition == FORM:
        surplus = income - expenses
        return {
            "excedente": surplus,
            "capacidad_pago": F.when(
                income > 0, F.round(surplus / F.greatest(F.col("cuota_estimada"), num(1)), 4)
            ).otherwise(num(0)),
            "endeudamiento_patrimonial": F.when(
                assets > 0, F.round(F.try_divide(debts, assets), 4)
            ).otherwise(num(0)),
            "capital_trabajo": assets - debts,
        }
    if definition == DOCS:
        surplus = income - expenses
        return {
            "excedente": surplus,
            "capacidad_pago": F.try_divide(surplus, F.col("cuota_estimada")),
            "endeudamiento_patrimonial": F.try_divide(debts, assets),
            "capital_trabajo": assets - debts,
        }
    raise ValueError(f"unknown definition {definition!r}")


def derive_profile(forms: DataFrame) -> DataFrame:
    """Full profiles from the seven fields of the application form, with the form's fixed factors."""
    amount, months = F.col("monto_solicitado"), F.col("num_cuotas")
    rate = clamp(num(0.02) + amount / num(50000) * num(0.03), 0.01, 0.08)
    instalment = F.when((amount > 0) & (months > 0), annuity(amount, F.col("tem"), months)).otherwise(num(0))
    filled = (
        forms.withColumn("tem", rate)
        .withColumn("cuota_estimada", instalment)
        .withColumns(
            {
                "total_costos": F.floor(F.col("total_gastos") * num(0.65) + num(0.5)).cast("double"),
                "monto_propuesto": F.floor(amount * num(0.9) + num(0.5)).cast("double"),
                "mora_diaria": num(0),
            }
        )
    )
    return (
        filled.withColumns(derived_fields(FORM))
        .withColumn("cuota_estimada", F.round("cuota_estimada", 2))
        .select(KEY, *FEATURES)
    )
