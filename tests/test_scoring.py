import pytest
from fixtures import NEAR_ZERO, SAMPLE, applications
from pyspark.sql import functions as F

from credilake.constants import BREAKDOWN, SCORE_BANDS
from credilake.functions import decisions, scoring


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_golden_clients(spark):
    rows = scoring.score(applications(spark, SAMPLE, NEAR_ZERO)).orderBy("id_cliente").collect()
    assert [(r.total_score, r.classification, r.category) for r in rows] == [
        (910, "excelente", "EXCELENTE"),
        (690, "bueno", "BUENO"),
    ]
    points = [rows[0][f"score_{d}"] for d in SCORE_BANDS]
    assert points == [100, 75, 150, 90, 75, 50, 100, 90, 80, 100]


@pytest.mark.parametrize(("p", "expected"), [(0.95, 1000), (0.10, 830)])
def test_adjustment(spark, p, expected):
    df = scoring.score(applications(spark, SAMPLE)).withColumn("probability", F.lit(p))
    row = _one(scoring.adjust_with_probability(df))
    assert (row.total_score, row.classification, row.total_score_original) == (expected, "excelente", 910)
    assert row.category == "EXCELENTE"


def test_adjusted_score_is_truncated_not_rounded(spark):
    df = spark.createDataFrame([(600, "regular", 0.7499)], "total_score int, classification string, probability double")
    assert _one(scoring.adjust_with_probability(df)).total_score == 649


def test_classes(spark):
    df = spark.createDataFrame([(v,) for v in (850, 800, 799, 650, 649, 450, 449, 250, 249, 200, 0, 1050, -5)], "s int")
    labels = {r.s: (r.strict, r.clamped) for r in df.select(
        "s", scoring.classify(F.col("s")).alias("strict"), scoring.classify(F.col("s"), False).alias("clamped")
    ).collect()}
    assert labels[850][0] == labels[800][0] == "excelente"
    assert labels[799][0] == labels[650][0] == "bueno"
    assert labels[649][0] == labels[450][0] == "regular"
    assert labels[449][0] == labels[250][0] == "riesgoso"
    assert labels[249][0] == labels[200][0] == labels[0][0] == "critico"
    assert labels[1050] == ("critico", "excelente")
    assert labels[-5] == ("critico", "critico")


@pytest.mark.parametrize("dimension", list(SCORE_BANDS))
def test_points_on_either_side_of_every_bound(spark, dimension):
    bands, rest = SCORE_BANDS[dimension]
    probes = sorted({b + d for _, b, _ in bands for d in (-0.001, 0.0, 0.001)})
    df = spark.createDataFrame([(v,) for v in probes], "v double")
    got = {r.v: r.p for r in df.select("v", scoring.band_points(dimension, F.col("v")).alias("p")).collect()}
    tests = {"<=": lambda v, b: v <= b, "<": lambda v, b: v < b, "==": lambda v, b: v == b, ">": lambda v, b: v > b}
    for v in probes:
        assert got[v] == next((p for op, b, p in bands if tests[op](v, b)), rest)


def test_missing_values_take_the_last_band(spark):
    row = _one(scoring.score(applications(spark, SAMPLE | {"ingreso_mensual": None, "capital_trabajo": None})))
    assert (row.score_ingreso, row.score_capital, row.score_gastos, row.score_carga) == (150, 10, 10, 5)


def test_explanation_of_a_missing_value(spark):
    df = scoring.score(applications(spark, SAMPLE | {"endeudamiento_patrimonial": None}))
    row = _one(df.select(scoring.explanations().alias("e")))
    assert row.e[7] == "Endeudamiento patrimonial: nan% -> 10/100 pts"


def test_breakdown_and_explanations(spark):
    df = scoring.score(applications(spark, SAMPLE))
    row = _one(df.select(scoring.breakdown().alias("b"), scoring.explanations().alias("e")))
    assert set(row.b) == set(BREAKDOWN) and len(row.b) == 9
    assert (row.b["deuda"].score, row.b["deuda"].max, row.b["deuda"].weight) == (150, 150, "15%")
    assert row.e[0] == "Ingreso mensual: S/15000.00 -> 100/150 pts"
    assert row.e[1] == "Ratio gastos/ingresos: 33.33% -> 75/100 pts"
    assert row.e[5] == "Nro de deudas: 2 -> 50/80 pts"
    assert row.e[9] == "Carga financiera: 0.08x ingreso anual -> 100/100 pts"
    assert len(row.e) == 10


CASES = [
    # p, label, confidence, score, class, arrears, debts, surplus, capacity -> decision, alerts, risk
    (0.92, "VIABLE", 92.0, 780, "bueno", 0.0, 1, 2000.0, 3.0, "APROBAR CRÉDITO", [], "Bajo"),
    (0.15, "NO VIABLE", 85.0, 250, "critico", 45.0, 5, -500.0, 0.3, "RECHAZAR CRÉDITO",
     ["ALERTA DE MORA", "ALERTA SOBRE-ENDEUDAMIENTO", "DÉFICIT FINANCIERO", "BAJA CAPACIDAD DE PAGO", "REFINANCIAR DEUDAS"], "Crítico"),
    (0.5, "NO VIABLE", 50.0, 400, "regular", 0.0, 2, 500.0, 1.5, "RECHAZAR CRÉDITO", ["REFINANCIAR DEUDAS"], "Alto"),
    (0.8, "VIABLE", 80.0, 600, "bueno", 90.0, 1, 1000.0, 2.0, "APROBAR CRÉDITO", ["ALERTA DE MORA"], "Moderado"),
    (0.8, "VIABLE", 80.0, 500, "regular", 0.0, 1, 1000.0, 2.0, "APROBAR CON CONDICIONES", [], "Moderado"),
    (0.2, "NO VIABLE", 80.0, 900, "excelente", 0.0, 1, 1000.0, 2.0, "REVISAR MANUALMENTE", [], "Moderado"),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: f"{c[1]}-{c[3]}")
def test_recommendations(spark, case):
    *values, decision, alerts, risk = case
    df = spark.createDataFrame(
        [tuple(values)],
        "probability double, prediction_label string, confidence double, total_score int, classification string,"
        " mora_diaria double, num_deudas int, excedente double, capacidad_pago double",
    )
    row = _one(decisions.recommend(df))
    assert row.final_decision == decision
    assert sorted(r.action for r in row.recommendations if r.position >= 2) == sorted(alerts)
    assert row.risk_level == risk
    order = [(r.priority, r.position) for r in row.recommendations]
    assert order == sorted(order)
    assert row.decision_summary.viable == (case[1] == "VIABLE")
    assert len(row.observations) == 1 and len(row.reasons) >= 1


def test_alert_texts(spark):
    df = spark.createDataFrame(
        [(0.1, "NO VIABLE", 90.0, 100, "critico", 45.0, 5, -1.0, 0.333)],
        "probability double, prediction_label string, confidence double, total_score int, classification string,"
        " mora_diaria double, num_deudas int, excedente double, capacidad_pago double",
    )
    texts = {r.action: r.description for r in _one(decisions.recommend(df)).recommendations}
    assert texts["ALERTA DE MORA"].startswith("Cliente presenta 45 días")
    assert texts["ALERTA SOBRE-ENDEUDAMIENTO"].startswith("Cliente tiene 5 deudas")
    assert texts["BAJA CAPACIDAD DE PAGO"] == "Capacidad de pago de 0.33. Umbral mínimo es 1.0."


def test_report_has_every_section(spark, profile):
    from credilake.plans.catalog_core import decided

    report = decisions.evaluation_report(decided(profile), F.to_timestamp(F.lit("2024-03-02 10:20:30")))
    row = report.orderBy("id_cliente").first()
    assert row.header.date == "02/03/2024 10:20" and row.header.report_id == "INF-20240302102030"
    assert [k.label for k in row.kpi_grid][-1] == "Decisión Final"
    assert row.client_info.ingreso_mensual.startswith("S/") and len(row.score_breakdown) == 9
    assert report.count() == profile.count()


def test_dashboard_and_dataset_outputs(spark, profile):
    from credilake.operators import portfolio

    kpis = _one(portfolio.portfolio_kpis(profile))
    assert kpis.viables + kpis.no_viables == kpis.total_clientes == profile.count()
    assert kpis.riesgo_promedio == pytest.approx(100 - kpis.tasa_aprobacion)
    assert kpis.morosidad in (0.0, 100.0)
    spread = {r.classification: r.clientes for r in portfolio.score_distribution(profile).collect()}
    assert len(spread) == 5 and sum(spread.values()) == profile.count()
    info = portfolio.dataset_info(profile)
    assert info["stats"].count() == 17 and info["correlations"].count() == 17
    constant = profile.withColumn("tem", F.lit(0.02))
    flat = {r.column_name: r.correlation for r in portfolio.target_correlations(constant).collect()}
    assert flat["tem"] is None and flat["viable"] == pytest.approx(1.0)
