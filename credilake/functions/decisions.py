"""Recommendations, decision, risk level and report as projections over a scored frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credilake.constants import ACTIONS, MAX_SCORE, OBSERVATIONS, REASONS, RISK_LEVELS, RISK_TOP, REPORT_KPIS, REPORT_TITLE
from credilake.functions.arithmetic import num
from credilake.functions.scoring import breakdown

VIABLE, NOT_VIABLE = "VIABLE", "NO VIABLE"

# Core rule -> the actions it recommends, the first being the final decision.
_CORE_ACTIONS = {
    "approve": ["approve"],
    "conditions": ["conditions", "reduce"],
    "review": ["review"],
    "reject": ["reject", "guarantee"],
}


def prediction(df: DataFrame, probability: str = "probability", model: str = "model") -> DataFrame:
    """Label, confidence and model name from a probability column (p >= 0.5 is viable)."""
    p = F.col(probability)
    return df.withColumns(
        {
            "prediction": (p >= num(0.5)).cast("int"),
            "prediction_label": F.when(p >= num(0.5), VIABLE).otherwise(NOT_VIABLE),
            "confidence": F.greatest(p, num(1) - p) * num(100),
            "model_used": F.lit(model),
        }
    )


def core_rule() -> Column:
    """Which of the four core rules applies."""
    viable = F.col("prediction_label") == VIABLE
    good = F.col("classification").isin("excelente", "bueno")
    return (
        F.when(viable & good, "approve")
        .when(viable & (F.col("classification") == "regular"), "conditions")
        .when((F.col("prediction_label") == NOT_VIABLE) & good, "review")
        .otherwise("reject")
    )


def alert_conditions() -> dict[str, Column]:
    """Extra rules, in the order they are appended."""
    return {
        "arrears": F.col("mora_diaria") > 30,
        "overdebt": F.col("num_deudas") >= 4,
        "deficit": F.col("excedente") < 0,
        "low_capacity": F.col("capacidad_pago") < 1,
        "refinance": F.col("total_score") < 450,
    }


def _alert_text(rule: str) -> Column:
    text = ACTIONS[rule][3]
    if rule == "arrears":
        return F.format_string(text, F.col("mora_diaria").cast("double"))
    if rule == "overdebt":
        return F.format_string(text, F.col("num_deudas").cast("string"))
    if rule == "low_capacity":
        return F.format_string(text, F.col("capacidad_pago").cast("double"))
    return F.lit(text)


def _action(rule: str, position: int, description: Column | None = None) -> Column:
    priority, action, kind, text = ACTIONS[rule]
    return F.struct(
        F.lit(priority).alias("priority"),
        F.lit(position).alias("position"),
        F.lit(action).alias("action"),
        F.lit(kind).alias("type"),
        (F.lit(text) if description is None else description).alias("description"),
    )


def _by_rule(make) -> Column:
    """CASE over the core rules."""
    chain = None
    for rule in _CORE_ACTIONS:
        test = F.col("core_rule") == rule
        chain = F.when(test, make(rule)) if chain is None else chain.when(test, make(rule))
    return chain


def recommend(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Adds core rule, sorted recommendations, reasons, observations, risk level and final decision.

    ``df`` needs ``prediction_label``, ``confidence``, ``total_score``, ``classification`` and the profile.
    """
    alerts = alert_conditions()
    core = _by_rule(lambda r: F.array(*[_action(a, i) for i, a in enumerate(_CORE_ACTIONS[r])]))
    extra = F.array_compact(
        F.array(*[F.when(test, _action(r, 2 + i, _alert_text(r))) for i, (r, test) in enumerate(alerts.items())])
    )
    extra_reasons = F.array_compact(F.array(*[F.when(alerts[r], REASONS[r]) for r in alerts if r in REASONS]))
    risk = (F.lit(MAX_SCORE) - F.col("total_score")) / num(MAX_SCORE) * num(0.6) + (
        num(1) - F.col(probability)
    ) * num(0.4)
    level = None
    for name, bound in RISK_LEVELS:
        test = F.col("risk_score") < num(bound)
        level = F.when(test, name) if level is None else level.when(test, name)
    return (
        df.withColumn("core_rule", core_rule())
        .withColumns(
            {
                # structs sort by (priority, position): by priority, ties in the order appended
                "recommendations": F.array_sort(F.concat(core, extra)),
                "reasons": F.concat(_by_rule(lambda r: F.array(F.lit(REASONS[r]))), extra_reasons),
                "observations": _by_rule(lambda r: F.array(F.lit(OBSERVATIONS[r]))),
                "risk_score": risk,
                "final_decision": _by_rule(lambda r: F.lit(ACTIONS[_CORE_ACTIONS[r][0]][1])),
                "decision_summary": F.struct(
                    (F.col("prediction_label") == VIABLE).alias("viable"),
                    F.col("total_score").alias("score"),
                    F.col("classification"),
                    F.col("confidence"),
                ),
            }
        )
        .withColumn("risk_level", level.otherwise(RISK_TOP))
    )


def list_recommendations(df: DataFrame) -> DataFrame:
    """One row per client and recommendation, in order.

    The list is never empty. The outer generator says so to the optimizer, which would otherwise add a
    "not empty" filter and push the whole nested rule expression down into it.
    """
    return df.select("id_cliente", F.posexplode_outer("recommendations").alias("rank", "r")).select(
        "id_cliente", "rank", "r.*"
    )


def _money(column: str) -> Column:
    return F.concat(F.lit("S/"), F.format_number(F.col(column), 2))


def _text(c: Column) -> Column:
    return c.cast("string")


def _kpi(label: str, value: Column, maximum: int | None = None) -> Column:
    return F.struct(
        F.lit(label).alias("label"), _text(value).alias("value"), F.lit(maximum).cast("int").alias("max")
    )


def evaluation_report(df: DataFrame, generated_at: Column) -> DataFrame:
    """One nested report row per client from a recommended frame: the sections without any picture."""
    values = [
        F.col("total_score"),
        F.upper("classification"),
        F.col("prediction_label"),
        F.format_string("%.1f%%", F.col("confidence")),
        F.col("risk_level"),
        F.col("final_decision"),
    ]
    return df.select(
        "id_cliente",
        F.struct(
            F.lit(REPORT_TITLE).alias("title"),
            F.lit("Resultado de la evaluación").alias("subtitle"),
            F.date_format(generated_at, "dd/MM/yyyy HH:mm").alias("date"),
            F.concat(F.lit("INF-"), F.date_format(generated_at, "yyyyMMddHHmmss")).alias("report_id"),
        ).alias("header"),
        F.struct(
            F.col("id_cliente"),
            *[_money(c).alias(c) for c in ("ingreso_mensual", "total_gastos", "total_activos", "total_deudas")],
            F.col("num_deudas"),
            _money("monto_solicitado").alias("monto_solicitado"),
        ).alias("client_info"),
        F.array(
            *[_kpi(label, value, MAX_SCORE if i == 0 else None) for i, (label, value) in enumerate(zip(REPORT_KPIS, values))]
        ).alias("kpi_grid"),
        breakdown().alias("score_breakdown"),
        F.struct("prediction", "probability", "prediction_label", "confidence", "model_used").alias(
            "model_metrics"
        ),
        F.struct("recommendations", "reasons", "observations").alias("recommendations"),
    )
