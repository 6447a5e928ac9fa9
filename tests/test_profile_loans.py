from decimal import Decimal

import pytest
from conftest import DATA
from fixtures import SAMPLE, applications
from pyspark.sql import functions as F

from credilake.constants import FEATURES, KEY
from credilake.operators import loans
from credilake.operators.profile import DOCS, FORM, build_profile, derive_profile
from credilake.sources import order_tables, relational


def test_correlated_sql_gives_the_same_rows(spark, tables):
    relational.register_views(tables)
    rows = spark.sql(
        """
        SELECT c.id_cliente, i.ingreso_mensual, g.total_gastos,
               (SELECT count(*) FROM deudas d WHERE d.id_cliente = c.id_cliente) AS num_deudas,
               coalesce((SELECT max(d.mora_diaria) FROM deudas d WHERE d.id_cliente = c.id_cliente), 0) AS mora_diaria
        FROM clientes c LEFT JOIN ingresos i ON i.id_cliente = c.id_cliente
             LEFT JOIN gastos g ON g.id_cliente = c.id_cliente
        WHERE i.mes_referencia = (SELECT max(m.mes_referencia) FROM ingresos m WHERE m.id_cliente = c.id_cliente)
        """
    )
    ours = build_profile(tables).select(*rows.columns)
    key = lambda r: tuple(float(v) for v in r)
    assert sorted(map(key, rows.collect())) == sorted(map(key, ours.collect()))


def test_snapshot_has_one_row_per_client(tables, profile):
    fanned = build_profile(tables)
    assert profile.select(KEY).distinct().count() == profile.count() < fanned.count()
    assert profile.columns == [KEY, *FEATURES, "viable"]


def test_ordered_profile(tables):
    keys = [r[0] for r in build_profile(tables, latest_snapshot=True, ordered=True).select(KEY).collect()]
    assert keys == sorted(keys)


def test_source_tables_round_trip(spark, tables, tmp_path):
    relational.write_source_tables(tables, str(tmp_path))
    back = relational.read_source_tables(spark, str(tmp_path))
    assert back["patrimonio"].schema["total_activos"].dataType.simpleString() == "decimal(14,2)"
    assert build_profile(back, latest_snapshot=True).count() == build_profile(tables, latest_snapshot=True).count()


def test_debts_over_a_cent_of_assets_are_stored(spark, tables, tmp_path):
    """A client with next to no assets: the ratio has more than three digits before the point."""
    row = tables["patrimonio"].limit(1).withColumn("total_activos", F.lit(0.2)).withColumn("total_deudas", F.lit(1e6))
    row = row.withColumn("endeudamiento_patrimonial", F.col("total_deudas") / F.col("total_activos"))
    relational.write_source_tables(tables | {"patrimonio": row}, str(tmp_path))
    back = relational.read_source_tables(spark, str(tmp_path))["patrimonio"].first()
    assert float(back["endeudamiento_patrimonial"]) == 5e6


def test_form(spark):
    form = spark.createDataFrame(
        [(1, 5000.0, 2500.0, 120000.0, 30000.0, 2, 25000.0, 24)],
        "id_cliente long, ingreso_mensual double, total_gastos double, total_activos double, total_deudas double,"
        " num_deudas int, monto_solicitado double, num_cuotas int",
    )
    r = derive_profile(form).first()
    rate = min(0.08, max(0.01, 0.02 + 25000 / 50000 * 0.03))
    quota = 25000 * (rate * (1 + rate) ** 24) / ((1 + rate) ** 24 - 1)
    assert r.tem == pytest.approx(rate) and r.cuota_estimada == pytest.approx(round(quota, 2))
    assert (r.total_costos, r.monto_propuesto, r.mora_diaria, r.excedente) == (1625.0, 22500.0, 0.0, 2500.0)
    assert r.capacidad_pago == pytest.approx(round(2500 / quota, 4))
    assert (r.endeudamiento_patrimonial, r.capital_trabajo) == (0.25, 90000.0)


@pytest.mark.parametrize("definition", [FORM, DOCS])
def test_other_definitions(tables, definition):
    row = build_profile(tables, True, definition).where("total_activos > 0").orderBy(KEY).first()
    assert row.excedente == row.ingreso_mensual - row.total_gastos
    assert row.endeudamiento_patrimonial == pytest.approx(row.total_deudas / row.total_activos, abs=5e-5)
    with pytest.raises(ValueError):
        build_profile(tables, True, "other")


def _loan(spark, amount, rate, months):
    return applications(spark, SAMPLE | {"monto_solicitado": amount, "tem": rate, "num_cuotas": months})


@pytest.mark.parametrize(("amount", "rate", "months"), [(10000, 0.03, 12), (25000, 0.01, 24), (5000, 0.08, 60), (1200, 0.0, 12)])
def test_schedule_against_running_balance(spark, amount, rate, months):
    loan = _loan(spark, amount, rate, months)
    rows = loans.amortization_schedule(loan).orderBy("numero").collect()
    g = (1 + rate) ** months
    quota = amount / months if rate == 0 else amount * rate * g / (g - 1)
    balance, interest = float(amount), 0.0
    for r in rows:
        due = balance * rate
        assert r.saldo_inicial == pytest.approx(balance, abs=1e-6)
        assert (r.interes, r.amortizacion) == (pytest.approx(due, abs=1e-6), pytest.approx(quota - due, abs=1e-6))
        balance -= quota - due
        interest += due
        assert r.saldo_final == pytest.approx(max(balance, 0), abs=1e-6)
    summary = loans.loan_summary(loan).first()
    assert summary.total_intereses == pytest.approx(interest, abs=1e-6)
    assert summary.tea == pytest.approx(((1 + rate) ** 12 - 1) * 100)
    assert summary.total_a_pagar == pytest.approx(amount + interest)
    running = loans.cumulative_schedule(loans.amortization_schedule(loan)).orderBy(F.desc("numero")).first()
    assert running.amortizacion_acumulada == pytest.approx(amount)


def test_schedule_is_whole_and_a_listing_can_be_shorter(spark):
    loan = _loan(spark, 10000, 0.02, 100)
    assert loans.amortization_schedule(loan).count() == 100
    assert loans.amortization_schedule(loan, max_rows=loans.LISTED_ROWS).count() == 60
    g = 1.02**100
    assert loans.loan_summary(loan).first().total_intereses == pytest.approx(10000 * 0.02 * g / (g - 1) * 100 - 10000)


def test_terms_recommend_least_cost(spark):
    rows = loans.compare_terms(_loan(spark, 10000, 0.03, 12)).collect()
    assert [r.plazo for r in rows] == [6, 12, 18, 24, 36, 48]
    best = min(rows, key=lambda r: r.cuota_mensual + 0.3 * r.intereses)
    assert [r.plazo for r in rows if r.recomendado] == [best.plazo]


def test_scenarios_and_arrears(spark):
    client = applications(spark, SAMPLE | {"mora_diaria": 5})
    by_name = {r.scenario: r for r in loans.risk_scenarios(client).collect()}
    assert by_name["pesimista"].capacidad_pago_estimada == pytest.approx((15000 * 0.85 - 5000 * 1.15) / (20000 * 0.05 + 1))
    months = loans.arrears_projection(client).orderBy("mes").collect()
    assert [m.dias_mora for m in months] == [5 + 30 * i for i in range(1, 13)]
    assert months[0].total_mora == pytest.approx(1500 * 0.03 / 30 * 35 + 75)
    total = loans.arrears_summary(loans.arrears_projection(client)).first()
    assert total.deuda_total_acumulada == pytest.approx(sum(m.deuda_total for m in months))


def test_loan_defaults(spark):
    row = loans.with_loan_defaults(spark.createDataFrame([(1, None)], "id_cliente long, tem double")).first()
    assert (row.monto_solicitado, row.tem, row.num_cuotas, row.cuota_estimada) == (10000.0, 0.03, 12, 500.0)


def test_entry_is_lazy_and_keyed(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.columns == [KEY, "total_score", "classification", "risk_level", "final_decision"]
    assert df.count() == 150 and set(contract.oracle_sql()) <= set(contract.queries())
    assert DATA.endswith("sf0.001")


def test_monthly_totals_are_exact(spark, tmp_path):
    spark.createDataFrame(
        [(1, 7, "2024-01-03", 0.1), (2, 7, "2024-01-20", 99999999999.99), (3, None, None, 5.0), (4, 8, "2024-02-01", None)],
        "o_orderkey long, o_custkey long, day string, o_totalprice double",
    ).withColumn("o_orderdate", F.to_timestamp("day")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(
        [(1, 0.07, 0.01, 0.03), (1, 0.07, 0.01, 0.03), (2, 9999999999.99, 99.99, None), (4, None, 0.05, 0.01)],
        "l_orderkey long, l_extendedprice double, l_discount double, l_tax double",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = {r[0]: tuple(r)[2:] for r in order_tables.monthly_totals(spark, str(tmp_path)).collect()}
    expected = [
        float(Decimal("99999999999.99") + Decimal("0.1")) / 20,
        float(Decimal("9999999999.99") * Decimal("99.99") + Decimal("0.0014")) / 2,
        float(Decimal("0.0042")) / 4,
    ]
    assert rows == {7: tuple(expected), None: (0.25, None, None), 8: (None, None, None)}
