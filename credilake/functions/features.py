"""Derived columns as SQL text, so that one definition serves DataFrames and ML pipeline stages alike."""

from __future__ import annotations

EPS = "1e-8D"  # fixed value: added to the denominator of every supervised ratio

# Fixed formulas. Ratio -> (numerator, denominator).
SUPERVISED_RATIOS = {
    "ratio_gastos_ingresos": ("total_gastos", "ingreso_mensual"),
    "ratio_deuda_ingreso": ("total_deudas", "ingreso_mensual"),
    "ratio_cuota_ingreso": ("cuota_estimada", "ingreso_mensual"),
    "liquidez": ("total_activos", "total_deudas"),
    "cobertura_gastos": ("excedente", "total_gastos"),
    "peso_deuda": ("total_deudas", "total_activos"),
    "capacidad_ahorro": ("excedente", "ingreso_mensual"),
    "estres_financiero": ("monto_solicitado", "ingreso_mensual * num_cuotas"),
    "carga_financiera_total": ("total_deudas + monto_solicitado", "ingreso_mensual * 12"),
    "cobertura_cuota": ("excedente", "cuota_estimada"),
    "eficiencia_operativa": ("total_costos", "total_gastos"),
    "apalancamiento": ("total_deudas", "abs(capital_trabajo)"),
    "solvencia": ("total_activos", "total_deudas"),
    "ingreso_por_deuda": ("ingreso_mensual", "num_deudas"),
}
# Flag -> condition.
SUPERVISED_FLAGS = {
    "mora_riesgo": "mora_diaria > 30",
    "deuda_alta": f"try_divide(total_deudas, ingreso_mensual + {EPS}) > 0.5D",
    "ahorro_positivo": "excedente > 0",
    "capacidad_baja": "capacidad_pago < 1",
}
# Log feature -> column.
SUPERVISED_LOGS = {
    "ingreso_log": "ingreso_mensual",
    "activos_log": "total_activos",
    "deudas_log": "total_deudas",
}
# Clustering ratio -> (numerator, denominator); the denominator is shifted by one.
CLUSTER_RATIOS = {
    "ratio_gastos_ingresos": ("total_gastos", "ingreso_mensual"),
    "ratio_deuda_activos": ("total_deudas", "total_activos"),
    "tasa_ahorro": ("excedente", "ingreso_mensual"),
    "deuda_ingreso": ("total_deudas", "ingreso_mensual"),
    "estres_financiero": ("monto_solicitado", "ingreso_mensual * num_cuotas"),
}


def _ratio(numerator: str, denominator: str, shift: str) -> str:
    # try_divide: ANSI mode refuses a zero denominator
    return f"try_divide({numerator}, {denominator} + {shift})"


def supervised(columns: list[str]) -> dict[str, str]:
    """The 21 supervised formulas for a frame with these columns (liabilities, if given, drive solvency)."""
    ratios = dict(SUPERVISED_RATIOS)
    if "total_pasivos" in columns:
        ratios["solvencia"] = ("total_activos", "total_pasivos")
    return (
        {name: _ratio(top, bottom, EPS) for name, (top, bottom) in ratios.items()}
        | {name: f"int(coalesce({test}, false))" for name, test in SUPERVISED_FLAGS.items()}
        | {name: f"log1p({column})" for name, column in SUPERVISED_LOGS.items()}
    )


def cluster() -> dict[str, str]:
    return {name: _ratio(top, bottom, "1") for name, (top, bottom) in CLUSTER_RATIOS.items()}
