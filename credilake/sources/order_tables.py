"""Source tables derived from an order-processing star schema.

A customer is a client, its monthly orders are its income, order-line discounts and taxes its expenses, its
account balance its assets, its open urgent orders its debts and its latest order its credit application.
Money is summed in whole units of its last decimal, hence exactly and in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credilake.functions.arithmetic import annuity, num
from credilake.session import materialize

# Instalments by order priority.
TERM_BY_PRIORITY = {"1-URGENT": 6, "2-HIGH": 12, "3-MEDIUM": 18, "4-NOT SPECIFIED": 24}
OTHER_TERM = 36


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def _hundredths(column: str, digits: int) -> Column:
    """An amount of two decimals as a whole number: a sum of decimals takes three times the room in a shuffle."""
    return (F.col(column).cast(f"decimal({digits},2)") * F.lit(100)).cast("long")


def _amount(units: Column, decimals: int) -> Column:
    """The double next to a whole number of units of the last decimal."""
    return (units.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-decimals))).cast("double")


def monthly_totals(spark: SparkSession, directory: str) -> DataFrame:
    """Income, expenses and costs per client and month, in one pass over orders and lines.

    Lines are summed per order before they meet the order, so one row per order is shuffled, not one per line,
    and a client holding a large share of the orders is combined map-side.
    """
    orders = _table(spark, directory, "orders")
    lineitem = _table(spark, directory, "lineitem")
    price = _hundredths("l_extendedprice", 12)
    per_order = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(price * _hundredths("l_discount", 4)).alias("discounts"),
        F.sum(price * _hundredths("l_tax", 4)).alias("taxes"),
    )
    return (
        orders.select(
            "o_orderkey",
            F.col("o_custkey").alias("id_cliente"),
            F.trunc("o_orderdate", "MM").alias("mes_referencia"),
            _hundredths("o_totalprice", 14).alias("price"),
        )
        .join(per_order, "o_orderkey", "left")
        .groupBy("id_cliente", "mes_referencia")
        .agg(
            (_amount(F.sum("price"), 2) / num(20)).alias("ingreso_mensual"),
            (_amount(F.sum("discounts"), 4) / num(2)).alias("total_gastos"),
            (_amount(F.sum("taxes"), 4) / num(4)).alias("total_costos"),
        )
    )


def source_tables(
    spark: SparkSession,
    directory: str,
    monthly: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> dict[str, DataFrame]:
    """The seven source tables as lazy DataFrames; ``monthly`` may be given if it is already at hand, and ``keep``
    stores a table before another is made of it."""
    customer = _table(spark, directory, "customer")
    orders = _table(spark, directory, "orders")
    monthly = monthly_totals(spark, directory) if monthly is None else monthly

    clientes = customer.select(
        F.col("c_custkey").alias("id_cliente"),
        F.col("c_name").alias("nombre"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("documento_identidad"),
    )
    ingresos = monthly.select("id_cliente", "mes_referencia", "ingreso_mensual")
    gastos = monthly.where(F.col("total_gastos").isNotNull()).select(
        "id_cliente", "mes_referencia", "total_gastos", "total_costos"
    )

    deudas = orders.where(
        F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderpriority") == "1-URGENT")
    ).select(
        F.col("o_orderkey").alias("id_deuda"),
        F.col("o_custkey").alias("id_cliente"),
        F.col("o_orderpriority").alias("entidad"),
        (F.col("o_totalprice") / num(10)).alias("monto"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("saldo_x20"),
        (F.col("o_totalprice") / num(20)).alias("saldo_pendiente"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") % 61).otherwise(0).cast("int").alias("mora_diaria"),
        F.to_date("o_orderdate").alias("fecha_inicio"),
    )

    owed = deudas.groupBy("id_cliente").agg((F.sum("saldo_x20").cast("double") / num(20)).alias("owed"))
    assets = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * num(20)).otherwise(num(0))
    patrimonio = (
        customer.select(F.col("c_custkey").alias("id_cliente"), assets.alias("total_activos"))
        .join(owed, "id_cliente", "left")
        .select("id_cliente", "total_activos", F.coalesce("owed", num(0)).alias("total_deudas"))
        .withColumns(
            {
                "capital_trabajo": F.col("total_activos") - F.col("total_deudas"),
                "endeudamiento_patrimonial": F.try_divide("total_deudas", "total_activos"),
            }
        )
    )
    patrimonio = keep(patrimonio, "patrimonio")

    latest = orders.groupBy(F.col("o_custkey").alias("id_cliente")).agg(
        F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority")).alias("o")
    )
    term = F.lit(OTHER_TERM)
    for priority, months in reversed(TERM_BY_PRIORITY.items()):
        term = F.when(F.col("o.o_orderpriority") == priority, months).otherwise(term)
    amount, rate = F.col("monto_solicitado"), F.col("tem")
    solicitudes = (
        latest.select(
            F.col("o.o_orderkey").alias("id_solicitud"),
            "id_cliente",
            (F.col("o.o_totalprice") / num(10)).alias("monto_solicitado"),
            (num(0.01) + (F.col("id_cliente") % 8) * num(0.01)).alias("tem"),
            term.cast("int").alias("num_cuotas"),
            F.col("o.o_orderdate").alias("fecha_solicitud"),
        )
        .withColumn("cuota_estimada", F.round(annuity(amount, rate, F.col("num_cuotas")), 2))
        .withColumn("monto_propuesto", amount * num(0.9))
    )
    solicitudes = keep(solicitudes, "solicitudes_credito")

    # the outcome on file: a surplus and bearable debts, with every tenth client's outcome reversed
    surplus = (F.col("ingreso_mensual") - F.col("total_gastos") - F.col("total_costos")) > num(0)
    sound = F.col("m.surplus") & (F.col("total_deudas") <= num(0.6) * F.col("total_activos"))
    evaluaciones = (
        # a client has one row a month, so the month alone decides which is the latest
        monthly.select(
            "id_cliente", "mes_referencia", surplus.alias("surplus"), F.col("total_gastos").isNotNull().alias("spent")
        )
        .groupBy("id_cliente")
        .agg(F.max(F.struct("mes_referencia", "surplus", "spent")).alias("m"))
        .where(F.col("m.spent"))
        .join(patrimonio.select("id_cliente", "total_activos", "total_deudas"), "id_cliente")
        .join(solicitudes.select("id_cliente", F.col("fecha_solicitud").alias("fecha_evaluacion")), "id_cliente")
        .select(
            F.col("id_cliente").alias("id_evaluacion"),
            "id_cliente",
            (sound != (F.col("id_cliente") % 10 == 0)).alias("viable"),
            "fecha_evaluacion",
        )
    )
    return {
        "clientes": clientes,
        "ingresos": ingresos,
        "gastos": gastos,
        "patrimonio": patrimonio,
        "deudas": deudas.drop("saldo_x20"),
        "solicitudes_credito": solicitudes,
        "evaluaciones": evaluaciones,
    }


def stored_source_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The seven tables written once, as a load step would: the order lines are read a single time."""
    monthly = materialize(monthly_totals(spark, directory), "monthly")
    tables = source_tables(spark, directory, monthly, materialize)
    # income and expenses are columns of the stored months, assets and applications are stored already
    return tables | {name: materialize(tables[name], name) for name in ("clientes", "deudas", "evaluaciones")}
