"""Core queries: profile, cleaning, features, scoring, decisions, statistics and loans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credilake.constants import KEY, MULTI_TARGETS
from credilake.functions import decisions, features, scoring
from credilake.functions.arithmetic import num
from credilake.operators import clean, loans, portfolio, validate
from credilake.operators.profile import build_profile, derive_profile
from credilake.session import checkpoint_root, materialize
from credilake.sources import files, relational
from credilake.sources.order_tables import source_tables, stored_source_tables


_loaded: dict[tuple[str, str], dict[str, DataFrame]] = {}


def loaded(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Source tables and snapshot profile of ``sf_dir``, written once per application and then shared."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        tables = stored_source_tables(spark, sf_dir)
        tables["profile"] = materialize(build_profile(tables, latest_snapshot=True), "profile")
        _loaded[key] = tables
    return _loaded[key]


def lazy_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per client straight from the tables in ``sf_dir``, as one plan."""
    return build_profile(source_tables(spark, sf_dir), latest_snapshot=True)


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per client from the stored profile table."""
    return loaded(spark, sf_dir)["profile"]


def fixed_probability(df: DataFrame) -> DataFrame:
    """A probability that both engines compute alike; stands in for a model where a decision is checked."""
    return df.withColumn("probability", (F.col(KEY) * 37 % 101).cast("double") / num(100))


def decided(df: DataFrame) -> DataFrame:
    """Score, adjust and recommend on the fixed probability: one projection over the profiles."""
    adjusted = scoring.adjust_with_probability(scoring.score(fixed_probability(df)))
    return decisions.recommend(decisions.prediction(adjusted))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounds columns whose last bits depend on ``pow``, ``log`` or the order of a sum."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _details(df: DataFrame) -> DataFrame:
    return scoring.score_dimensions(df).select(KEY, *[f"score_{d}" for d in scoring.SCORE_BANDS])


def _applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles bent so that some break each kind of rule."""
    balance = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias(KEY), "c_acctbal")
    return (
        snapshot(spark, sf_dir)
        .join(balance, KEY)
        .withColumns(
            {
                "ingreso_mensual": F.col("ingreso_mensual") - 4000,
                "total_activos": F.col("c_acctbal"),
                "tem": F.col("tem") * F.col("num_cuotas"),
                "num_cuotas": F.col("num_cuotas") * F.col("num_deudas"),
            }
        )
    )


def _rejects(spark, sf_dir) -> DataFrame:
    _, rejects = validate.validate_applications(_applications(spark, sf_dir))
    return rejects.select(KEY, F.explode(validate.REASONS).alias("reason"))


def _derived(spark, sf_dir) -> DataFrame:
    form = snapshot(spark, sf_dir).select(
        KEY, "ingreso_mensual", "total_gastos", "total_activos", "total_deudas", "num_deudas", "monto_solicitado", "num_cuotas"
    )
    return rounded(derive_profile(form), 6, "tem").select(
        KEY, "tem", "cuota_estimada", "total_costos", "excedente", "capacidad_pago", "endeudamiento_patrimonial",
        "capital_trabajo", "monto_propuesto", "mora_diaria",
    )


def _supervised(spark, sf_dir) -> DataFrame:
    df = clean.engineer_features(clean.impute_median(snapshot(spark, sf_dir)))
    return rounded(df.select(KEY, *features.supervised([])), 6, *features.SUPERVISED_LOGS)


def _cluster(spark, sf_dir) -> DataFrame:
    df = clean.engineer_cluster_features(clean.clean_for_clustering(snapshot(spark, sf_dir)))
    return df.select(KEY, *features.cluster())


def _breakdown(spark, sf_dir) -> DataFrame:
    df = scoring.score_dimensions(snapshot(spark, sf_dir))
    return df.select(KEY, F.explode(scoring.breakdown()).alias("dimension", "s")).select(
        KEY, "dimension", "s.score", "s.max", "s.weight"
    )


def _adjusted(spark, sf_dir) -> DataFrame:
    df = scoring.adjust_with_probability(scoring.score(fixed_probability(snapshot(spark, sf_dir))))
    return df.select(
        KEY, "total_score", "classification", "total_score_original", "classification_original", "ml_adjustment", "ml_factor"
    )


def _alerts(spark, sf_dir) -> DataFrame:
    df = decisions.list_recommendations(decided(snapshot(spark, sf_dir)))
    return df.where(F.col("position") >= 2).groupBy("action").agg(F.count("*").alias("clientes"))


def _sorted(spark, sf_dir) -> DataFrame:
    df = decisions.list_recommendations(decided(snapshot(spark, sf_dir)))
    return df.select(KEY, "rank", "priority", "action", "type")


def _reasons(spark, sf_dir) -> DataFrame:
    df = decided(snapshot(spark, sf_dir))
    tagged = F.concat(
        F.transform("reasons", lambda t: F.struct(F.lit("reason").alias("kind"), t.alias("text"))),
        F.transform("observations", lambda t: F.struct(F.lit("observation").alias("kind"), t.alias("text"))),
    )
    return df.select(KEY, F.explode_outer(tagged).alias("t")).select(KEY, "t.*")


def _explanations(spark, sf_dir) -> DataFrame:
    df = scoring.score_dimensions(snapshot(spark, sf_dir))
    return df.select(KEY, F.posexplode(scoring.explanations()).alias("position", "sentence"))


def _report(spark, sf_dir) -> DataFrame:
    report = decisions.evaluation_report(decided(snapshot(spark, sf_dir)), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return report.select(KEY, F.to_json(F.struct("*")).alias("report"))


def _report_kpis(spark, sf_dir) -> DataFrame:
    report = decisions.evaluation_report(decided(snapshot(spark, sf_dir)), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    rows = report.select(KEY, F.col("header.report_id").alias("report_id"), F.posexplode("kpi_grid").alias("position", "kpi"))
    return rows.select(KEY, "report_id", "position", "kpi.label", "kpi.value", "kpi.max")


def _non_finite(spark, sf_dir) -> DataFrame:
    """Profiles with NaN and infinities put in by rule, then cleaned of them."""
    dirty = snapshot(spark, sf_dir).withColumn(
        "capacidad_pago",
        F.when(F.col("num_deudas") == 0, num("nan"))
        .when(F.col("num_deudas") == 1, num("inf"))
        .when(F.col("num_deudas") == 2, num("-inf"))
        .otherwise(F.col("capacidad_pago")),
    )
    return clean.nullify_non_finite(dirty).select(KEY, "capacidad_pago", "excedente")


def _work(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _csv(spark, sf_dir) -> DataFrame:
    """The profiles out to CSV and in again."""
    path = _work(spark, "profiles-csv")
    snapshot(spark, sf_dir).write.option("header", True).csv(path)
    return files.read_profiles(spark, path)


def _multi_csv(spark, sf_dir) -> DataFrame:
    """Profiles with three targets out to CSV, with a byte-order mark before the header's first name, and in again."""
    path = _work(spark, "multi-csv")
    targets = {c: ((F.col(KEY) + i) % 2).cast("int") for i, c in enumerate(MULTI_TARGETS)}
    marked = snapshot(spark, sf_dir).withColumns(targets).withColumnRenamed(KEY, f"\ufeff{KEY}")
    marked.write.option("header", True).csv(path)
    return files.read_multi_target(spark, path)


def _bom(spark, sf_dir) -> DataFrame:
    """Marked column names, as a header left them, are plain again; the targets are no features."""
    marked = snapshot(spark, sf_dir).withColumn(MULTI_TARGETS[0], F.lit(1)).withColumnRenamed(KEY, f"\ufeff{KEY}")
    return clean.drop_non_features(clean.strip_bom(marked), keep_target=False)


def _json_in(spark, sf_dir) -> DataFrame:
    """The profiles out to JSON lines and in again as applications."""
    path = _work(spark, "applications-json")
    snapshot(spark, sf_dir).write.json(path)
    return files.read_applications_json(spark, path).drop(files.CORRUPT)


def _json_out(spark, sf_dir) -> DataFrame:
    """Result documents written out and read back."""
    path = _work(spark, "results-json")
    files.write_results_json(decided(snapshot(spark, sf_dir)), path)
    text = spark.read.text(path)
    return text.select(
        F.get_json_object("value", "$.client_id").cast("long").alias(KEY),
        F.get_json_object("value", "$.scoring.total_score").cast("int").alias("total_score"),
        F.get_json_object("value", "$.recommendations.final_decision").alias("final_decision"),
    )


def _stored_tables(spark, sf_dir) -> DataFrame:
    """The seven tables written with their declared types and read back: rows per table."""
    path = _work(spark, "source-tables")
    tables = {k: v for k, v in loaded(spark, sf_dir).items() if k != "profile"}
    relational.write_source_tables(tables, path)
    counts = None
    for name, df in relational.read_source_tables(spark, path).items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        counts = row if counts is None else counts.unionByName(row)
    return counts


def _trend(spark, sf_dir) -> DataFrame:
    return portfolio.portfolio_trend(
        loaded(spark, sf_dir)["evaluaciones"].withColumn("viable", F.col("viable").cast("int")), at="fecha_evaluacion"
    )


def _schedule(spark, sf_dir) -> DataFrame:
    money = ["saldo_inicial", "amortizacion", "interes", "cuota_total", "saldo_final"]
    return rounded(loans.amortization_schedule(snapshot(spark, sf_dir)), 5, *money)


def _cumulative(spark, sf_dir) -> DataFrame:
    running = loans.cumulative_schedule(loans.amortization_schedule(snapshot(spark, sf_dir)))
    last = running.groupBy(KEY).agg(
        F.max("interes_acumulado").alias("interes_acumulado"), F.max("amortizacion_acumulada").alias("amortizacion_acumulada")
    )
    return rounded(last, 4, "interes_acumulado", "amortizacion_acumulada")


def long_loans(df: DataFrame) -> DataFrame:
    """The loans with terms of 6 to 120 instalments, the whole range that is valid, by client."""
    return df.withColumn("num_cuotas", (F.lit(6) + F.pmod(F.col(KEY) * 7, F.lit(115))).cast("int"))


def _defaults(spark, sf_dir) -> DataFrame:
    """Loans with gaps (and one field left out) after their defaults."""
    df = snapshot(spark, sf_dir).select(
        KEY,
        F.when(F.col("num_cuotas") > 12, F.col("monto_solicitado").cast("double")).alias("monto_solicitado"),
        F.when(F.col("num_deudas") > 0, F.col("tem")).alias("tem"),
        F.when(F.col("num_cuotas") > 24, F.col("num_cuotas")).alias("num_cuotas"),
    )
    return loans.with_loan_defaults(df).select(*df.columns, "cuota_estimada")


def _schedule_long(spark, sf_dir) -> DataFrame:
    """Instalments, first and last balance and interest per loan and year of its term."""
    rows = loans.amortization_schedule(long_loans(snapshot(spark, sf_dir)))
    by_year = rows.groupBy(KEY, F.floor((F.col("numero") - 1) / 12).cast("int").alias("year")).agg(
        F.count("*").alias("n"),
        F.max("saldo_inicial").alias("first_balance"),
        F.min("saldo_final").alias("last_balance"),
        F.sum("interes").alias("interest"),
    )
    return rounded(by_year, 3, "first_balance", "last_balance", "interest")


def _cumulative_long(spark, sf_dir) -> DataFrame:
    """Totals at the end of each loan."""
    running = loans.cumulative_schedule(loans.amortization_schedule(long_loans(snapshot(spark, sf_dir))))
    last = running.groupBy(KEY).agg(
        F.max("numero").alias("n"),
        F.max_by("interes_acumulado", "numero").alias("interes_acumulado"),
        F.max_by("amortizacion_acumulada", "numero").alias("amortizacion_acumulada"),
    )
    return rounded(last, 3, "interes_acumulado", "amortizacion_acumulada")


def _loan_summary(spark, sf_dir) -> DataFrame:
    df = rounded(loans.loan_summary(snapshot(spark, sf_dir)), 4, "cuota_mensual", "total_intereses", "total_a_pagar")
    return rounded(df, 6, "tea", "costo_total_credito")


QUERIES = {
    "profile_joined": lambda s, d: build_profile(source_tables(s, d), ordered=True),
    "profile_snapshot": lazy_snapshot,
    "clean_impute": lambda s, d: clean.impute_median(snapshot(s, d)),
    "nullify_non_finite": _non_finite,
    "select_target": lambda s, d: clean.select_target(snapshot(s, d)).select(KEY, "label"),
    "profiles_csv": _csv,
    "multi_target_csv": _multi_csv,
    "bom_stripped": _bom,
    "applications_json": _json_in,
    "results_json": _json_out,
    "source_tables": _stored_tables,
    "serving_align": lambda s, d: clean.align_features(
        snapshot(s, d), ["mora_diaria", "endeudamiento_patrimonial", "capacidad_pago", "no_such_feature", "num_deudas"]
    ),
    "validate_rejects": _rejects,
    "derive_profile": _derived,
    "features_supervised": _supervised,
    "features_cluster": _cluster,
    "score_details": lambda s, d: _details(snapshot(s, d)),
    "score_total_class": lambda s, d: scoring.score(snapshot(s, d)).select(KEY, "total_score", "classification", "category"),
    "score_ml_adjust": _adjusted,
    "score_breakdown": _breakdown,
    "score_explanations": _explanations,
    "decision_core": lambda s, d: decided(snapshot(s, d)).select(
        KEY, "core_rule", "final_decision", "decision_summary.viable", "decision_summary.score", "decision_summary.classification"
    ),
    "decision_alerts": _alerts,
    "decision_sorted": _sorted,
    "decision_reasons": _reasons,
    "decision_risk": lambda s, d: rounded(decided(snapshot(s, d)).select(KEY, "risk_score", "risk_level"), 6, "risk_score"),
    "evaluation_report": _report,
    "evaluation_report_kpis": _report_kpis,
    "kpis": lambda s, d: portfolio.portfolio_kpis(snapshot(s, d)),
    "mean_profile_score": lambda s, d: portfolio.score_of_mean_profile(snapshot(s, d)),
    "score_distribution": lambda s, d: portfolio.score_distribution(snapshot(s, d)),
    "means_by_result": lambda s, d: rounded(portfolio.means_by_result(snapshot(s, d)), 4, "avg_income", "avg_debt"),
    "target_distribution": lambda s, d: portfolio.target_distribution(snapshot(s, d)),
    "describe": lambda s, d: rounded(
        rounded(portfolio.describe(snapshot(s, d)), 4, "mean", "std"), 7, "q25", "q50", "q75"
    ),
    "correlations": lambda s, d: rounded(portfolio.target_correlations(snapshot(s, d)), 6, "correlation"),
    "monthly_trend": _trend,
    "risk_by_category": lambda s, d: portfolio.risk_by_category(decided(snapshot(s, d))),
    "loan_schedule": _schedule,
    "loan_cumulative": _cumulative,
    "loan_schedule_long": _schedule_long,
    "loan_cumulative_long": _cumulative_long,
    "loan_defaults": _defaults,
    "loan_summary": _loan_summary,
    "loan_scenarios": lambda s, d: loans.risk_scenarios(snapshot(s, d)).drop("escenario"),
    "loan_arrears": lambda s, d: rounded(
        loans.arrears_projection(snapshot(s, d)), 6, "interes_mora", "penalidad", "total_mora", "deuda_total"
    ),
    "loan_arrears_summary": lambda s, d: rounded(
        loans.arrears_summary(loans.arrears_projection(snapshot(s, d))), 4, "mora_promedio", "costo_total_mora", "deuda_total_acumulada"
    ),
    "loan_terms": lambda s, d: rounded(loans.compare_terms(snapshot(s, d)), 4, "cuota_mensual", "total_pagar", "intereses"),
}
