import math

import numpy as np
import pytest
from fixtures import SAMPLE, applications, training_rows
from pyspark.sql import functions as F

from credilake.constants import FEATURES, KEY, MULTI_TARGETS
from credilake.functions import features
from credilake.operators import clean, validate
from credilake.operators.quantiles import exact_quantiles
from credilake.operators.scaling import RobustScale
from credilake.sources import files


def test_bom_and_non_features(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["\ufeffid_cliente", "x", *MULTI_TARGETS])
    assert clean.strip_bom(df).columns[0] == KEY
    assert clean.drop_non_features(clean.strip_bom(df)).columns == [KEY, "x"]
    assert clean.drop_non_features(clean.strip_bom(df), keep_key=False).columns == ["x"]


def test_infinities_take_the_median(spark):
    df = spark.createDataFrame([(1, 1.0), (2, math.inf), (3, 3.0), (4, math.nan), (5, None)], "id_cliente long, col double")
    values = [r.col for r in clean.clean(df).orderBy(KEY).collect()]
    assert values == [1.0, 2.0, 3.0, 2.0, 2.0]


def test_all_null_column_becomes_zero(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id_cliente long, col double")
    assert [r.col for r in clean.clean(df).collect()] == [0.0, 0.0]


def test_clustering_gaps_become_zero_without_medians(spark):
    df = spark.createDataFrame([(1, 5.0, 1, "a"), (2, None, 0, "b")], "id_cliente long, col double, viable int, t string")
    out = clean.clean_for_clustering(df)
    assert out.columns == [KEY, "col"]
    assert [r.col for r in out.orderBy(KEY).collect()] == [5.0, 0.0]


def test_engineered_features(spark):
    df = clean.engineer_features(training_rows(spark))
    added = [c for c in df.columns if c in features.supervised([])]
    assert len(added) == 21
    eps = 1e-8
    for row in df.collect():
        income, debt, assets = row.ingreso_mensual, row.total_deudas, row.total_activos
        assert row.ratio_gastos_ingresos == row.total_gastos / (income + eps)
        assert row.liquidez == row.solvencia == assets / (debt + eps)
        assert row.apalancamiento == debt / (abs(row.capital_trabajo) + eps)
        assert row.estres_financiero == row.monto_solicitado / (income * row.num_cuotas + eps)
        assert row.carga_financiera_total == (debt + row.monto_solicitado) / (income * 12 + eps)
        assert row.ingreso_log == pytest.approx(math.log1p(income), abs=1e-12)
        assert row.ahorro_positivo == int(row.excedente > 0)
    with_liabilities = clean.engineer_features(training_rows(spark).withColumn("total_pasivos", F.lit(10000.0)))
    assert all(r.solvencia == r.total_activos / (10000 + eps) for r in with_liabilities.collect())


def test_cluster_features(spark):
    row = clean.engineer_cluster_features(applications(spark, SAMPLE)).first()
    assert row.ratio_gastos_ingresos == 5000 / 15001
    assert row.estres_financiero == 15000 / (15000 * 12 + 1)
    assert row.tasa_ahorro == 3000 / 15001 and row.deuda_ingreso == 20000 / 15001
    assert row.ratio_deuda_activos == 20000 / 100001


def test_alignment_orders_and_fills(spark):
    df = spark.createDataFrame([(1, None, 3)], "id_cliente long, a double, b int")
    assert clean.align_features(df, ["b", "zz", "a"]).first().asDict() == {KEY: 1, "b": 3.0, "zz": 0.0, "a": 0.0}


def test_select_target(spark):
    df = training_rows(spark).withColumns({t: F.lit(1) for t in MULTI_TARGETS})
    out = clean.select_target(df, MULTI_TARGETS[0])
    assert "label" in out.columns and not set(out.columns) & {*MULTI_TARGETS, "viable"}


def test_validation_reasons(spark):
    broken = SAMPLE | {"ingreso_mensual": 0, "tem": 1.5, "num_cuotas": 121, "total_gastos": -1, "total_activos": None}
    valid, rejects = validate.validate_applications(applications(spark, SAMPLE, broken, SAMPLE | {"excedente": None}))
    assert [r.id_cliente for r in valid.orderBy(KEY).collect()] == [1, 3]
    assert valid.where("id_cliente = 3").first().excedente == 0
    assert rejects.first()[validate.REASONS] == [
        "ingreso_mensual must be > 0",
        "total_gastos must be >= 0",
        "total_activos missing",
        "tem must be <= 1",
        "num_cuotas must be <= 120",
    ]


def test_csv_with_bom_and_other_column_order(spark, tmp_path):
    path = tmp_path / "profiles.csv"
    path.write_text("\ufeffid_cliente,viable,ingreso_mensual,num_deudas\n7,1,12.5,3\n8,0,,x\n", encoding="utf-8")
    rows = files.read_profiles(spark, str(path)).orderBy(KEY).collect()
    assert (rows[0].id_cliente, rows[0].ingreso_mensual, rows[0].num_deudas, rows[0].viable) == (7, 12.5, 3, 1)
    assert rows[1].ingreso_mensual is None and rows[1].num_deudas is None


def test_multi_target_csv(spark, tmp_path):
    path = tmp_path / "targets.csv"
    path.write_text("ingreso_mensual,resultado_aprobado,resultado_rechazado,resultado_riesgo_medio\n1,1,0,0\n")
    assert files.read_multi_target(spark, str(path)).first().resultado_aprobado == 1


def test_json_records_keep_the_malformed_line(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text('{"id_cliente": 1, "ingreso_mensual": 10.0}\n{broken\n')
    rows = files.read_applications_json(spark, str(path)).collect()
    assert sorted(r[files.CORRUPT] is None for r in rows) == [False, True]


def test_result_json(spark, profile, tmp_path):
    import json

    from credilake.plans.catalog_core import decided

    files.write_results_json(decided(profile), str(tmp_path / "out"), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == profile.count()
    assert set(lines[0]) == {"client_id", "prediction", "scoring", "recommendations", "timestamp"}
    assert "position" not in lines[0]["recommendations"]["recommendations"][0]


@pytest.mark.parametrize("cells, listed", [(256, 2048), (2, 3), (16, 1)])
def test_exact_quantiles(spark, cells, listed):
    rng = np.random.default_rng(3)
    a = rng.lognormal(size=5001)
    hot = np.where(rng.random(5001) < 0.4, 7.0, rng.normal(size=5001))
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, hot)], "a double, hot double, none double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, ["a", "hot", "none"], ps, cells=cells, listed=listed)
    assert got["a"] == pytest.approx(np.quantile(a, ps), rel=1e-12)
    assert got["hot"] == pytest.approx(np.quantile(hot, ps), rel=1e-12)
    assert got["none"] == [None] * len(ps)


def test_robust_scale_round_trip(spark):
    df = training_rows(spark).withColumn("flat", F.lit(3.0))
    scale = RobustScale.fit(df, [*FEATURES, "flat"])
    scaled = scale.transform(df)
    again = RobustScale.fit(scaled, FEATURES)
    assert all(abs(m) < 1e-12 for m in again.medians.values())
    assert all(r == pytest.approx(1.0) for r in again.ranges.values())
    assert {r.flat for r in scaled.collect()} == {0.0}
    back = scale.inverse(scaled).orderBy(KEY).first()
    assert back.ingreso_mensual == pytest.approx(df.orderBy(KEY).first().ingreso_mensual)


def test_yeo_johnson_against_numpy(spark):
    from credilake.operators.scaling import fit_yeo_johnson, power_transform

    rng = np.random.default_rng(5)
    x = rng.exponential(size=800) - 0.3
    df = spark.createDataFrame([(float(v),) for v in x], "x double")

    def likelihood(lam):
        up = np.log1p(np.maximum(x, 0)) if lam == 0 else (np.power(np.maximum(x, 0) + 1, lam) - 1) / lam
        down = -np.log1p(-np.minimum(x, 0)) if lam == 2 else -(np.power(1 - np.minimum(x, 0), 2 - lam) - 1) / (2 - lam)
        y = np.where(x >= 0, up, down)
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    best = max(np.linspace(-3, 3, 6001), key=likelihood)
    lam = fit_yeo_johnson(df, ["x"])["x"]
    assert lam == pytest.approx(best, abs=0.02)
    moved = np.array([r.x for r in power_transform(df, {"x": lam}).collect()])
    assert moved.mean() == pytest.approx(0, abs=1e-9) and moved.std() == pytest.approx(1)
