"""Loan maths over whole portfolios: nothing is iterated, every instalment is a closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credilake.constants import ARREARS_MONTHS, KEY, LOAN_DEFAULTS, SCENARIOS, TERMS
from credilake.functions.arithmetic import annuity, growth, num

LISTED_ROWS = 60  # fixed value: instalments that a report lists per loan


def with_loan_defaults(df: DataFrame) -> DataFrame:
    """Absent or NULL loan fields take their defaults."""
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)
            for c, v in LOAN_DEFAULTS.items()
        }
    )


def _balance(k: Column) -> Column:
    """Balance after ``k`` instalments; at rate 0 the straight line."""
    amount, rate, quota = F.col("monto_solicitado"), F.col("tem"), F.col("cuota")
    g = growth(rate, k)
    return F.when(rate == num(0), amount - quota * k.cast("double")).otherwise(
        amount * g - F.try_divide(quota * (g - num(1)), rate)
    )


def _with_quota(loans: DataFrame) -> DataFrame:
    return loans.withColumn(
        "cuota", annuity(F.col("monto_solicitado"), F.col("tem"), F.col("num_cuotas"))
    )


def amortization_schedule(loans: DataFrame, key: str = KEY, max_rows: int | None = None) -> DataFrame:
    """One row per loan and instalment: opening balance, principal, interest, instalment, closing balance.

    All instalments; ``max_rows`` (``LISTED_ROWS`` in a report) is for display only, totals need them all.
    """
    listed = F.col("num_cuotas") if max_rows is None else F.least(F.col("num_cuotas"), F.lit(max_rows))
    rows = (
        _with_quota(loans)
        .where(F.col("num_cuotas") >= 1)
        .select(key, "monto_solicitado", "tem", "cuota", F.explode(F.sequence(F.lit(1), listed)).alias("numero"))
        .withColumn("saldo_inicial", _balance(F.col("numero") - 1))
        .withColumn("interes", F.col("saldo_inicial") * F.col("tem"))
        .withColumn("amortizacion", F.col("cuota") - F.col("interes"))
        .withColumn("saldo_final", F.greatest(F.col("saldo_inicial") - F.col("amortizacion"), num(0)))
    )
    return rows.select(
        key, "numero", "saldo_inicial", "amortizacion", "interes", F.col("cuota").alias("cuota_total"), "saldo_final"
    )


def cumulative_schedule(schedule: DataFrame, key: str = KEY) -> DataFrame:
    """Adds running interest and principal per loan. A loan has at most as many rows as instalments."""
    w = Window.partitionBy(key).orderBy("numero").rowsBetween(Window.unboundedPreceding, 0)
    return schedule.withColumns(
        {
            "interes_acumulado": F.sum("interes").over(w),
            "amortizacion_acumulada": F.sum("amortizacion").over(w),
        }
    )


def loan_summary(loans: DataFrame, key: str = KEY) -> DataFrame:
    """Per loan: annual rate in %, instalment, interest over the whole term, amount to pay, cost in %."""
    amount = F.col("monto_solicitado")
    return (
        _with_quota(loans)
        .withColumn("total_intereses", F.col("cuota") * F.col("num_cuotas").cast("double") - amount)
        .select(
            key,
            "monto_solicitado",
            "tem",
            ((growth(F.col("tem"), F.lit(12)) - num(1)) * num(100)).alias("tea"),
            "num_cuotas",
            F.col("cuota").alias("cuota_mensual"),
            "total_intereses",
            (amount + F.col("total_intereses")).alias("total_a_pagar"),
            F.try_divide(F.col("total_intereses") * num(100), amount).alias("costo_total_credito"),
        )
    )


def risk_scenarios(clients: DataFrame, key: str = KEY) -> DataFrame:
    """Three stressed incomes, expenses and payment capacities per client."""
    income, expenses = F.col("ingreso_mensual"), F.col("total_gastos")
    entries = [
        F.struct(
            F.lit(name).alias("scenario"),
            (income * num(up)).alias("ingreso_estimado"),
            (expenses * num(down)).alias("gastos_estimados"),
            F.try_divide(
                income * num(up) - expenses * num(down), F.col("total_deudas") * num(0.05) + num(1)
            ).alias("capacidad_pago_estimada"),
            F.lit(text).alias("escenario"),
        )
        for name, (up, down, text) in SCENARIOS.items()
    ]
    return clients.select(key, F.explode(F.array(*entries)).alias("s")).select(key, "s.*")


def arrears_projection(clients: DataFrame, key: str = KEY) -> DataFrame:
    """Twelve months of growing arrears per client: late interest, penalty beyond 30 days, total owed."""
    quota = F.col("cuota_estimada")
    months = F.explode(F.sequence(F.lit(1), F.lit(ARREARS_MONTHS)))
    return (
        clients.select(key, "cuota_estimada", "tem", "mora_diaria", months.alias("mes"))
        .withColumn("dias_mora", F.col("mora_diaria") + (F.col("mes") * 30).cast("double"))
        .withColumn("interes_mora", quota * (F.col("tem") / num(30)) * F.col("dias_mora"))
        .withColumn("penalidad", F.when(F.col("dias_mora") > 30, quota * num(0.05)).otherwise(num(0)))
        .withColumn("total_mora", F.col("interes_mora") + F.col("penalidad"))
        .withColumn("deuda_total", quota + F.col("total_mora"))
        .select(key, "mes", "dias_mora", "interes_mora", "penalidad", "total_mora", "deuda_total")
    )


def arrears_summary(projection: DataFrame, key: str = KEY) -> DataFrame:
    """Mean days late and total costs per client."""
    return projection.groupBy(key).agg(
        F.avg("dias_mora").alias("mora_promedio"),
        F.sum("total_mora").alias("costo_total_mora"),
        F.sum("deuda_total").alias("deuda_total_acumulada"),
    )


def compare_terms(loans: DataFrame, key: str = KEY) -> DataFrame:
    """The loan at six terms, the recommended one flagged: least instalment + 0.3 interest, ties to the shorter.

    The choice is made inside the row before it is exploded, so no shuffle is needed.
    """
    amount, rate = F.col("monto_solicitado"), F.col("tem")
    options = []
    for months in TERMS:
        quota = annuity(amount, rate, F.lit(months))
        interest = quota * num(months) - amount
        options.append(
            F.struct(
                (quota + interest * num(0.3)).alias("cost"),
                F.lit(months).alias("plazo"),
                quota.alias("cuota_mensual"),
                (quota * num(months)).alias("total_pagar"),
                interest.alias("intereses"),
            )
        )
    return (
        loans.select(key, F.array(*options).alias("options"))
        .withColumn("best", F.array_min("options")["plazo"])
        .select(key, "best", F.explode("options").alias("o"))
        .select(
            key,
            "o.plazo",
            "o.cuota_mensual",
            "o.total_pagar",
            "o.intereses",
            (F.col("o.plazo") == F.col("best")).alias("recomendado"),
        )
    )
