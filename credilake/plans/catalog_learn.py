"""Queries over predictions, models, the evaluations log and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credilake.constants import FEATURES, KEY, TARGET
from credilake.functions import decisions, scoring
from credilake.functions.arithmetic import num
from credilake.operators import clean, explain, fits, metrics, prep, regression, scaling, supervised
from credilake.plans import training
from credilake.plans.catalog_core import _applications, _work, decided, fixed_probability, loaded, rounded, snapshot
from credilake.session import materialize
from credilake.sources import evaluations as log
from credilake.sources.models import load_model, model_registry, save_model
from credilake.streaming import jobs

# Stored coefficients that stand in for a fit where the check needs fixed ones.
_STORED = regression.LinearFit(0.4, {"ingreso_mensual": 1e-5, "total_deudas": -5e-6, "tem": -1.5, "num_cuotas": 0.01})


def _predictions(spark, sf_dir) -> DataFrame:
    df = fixed_probability(snapshot(spark, sf_dir)).where(F.col(TARGET).isNotNull())
    return df.select(
        KEY,
        F.col(TARGET).alias("label"),
        F.col("probability").alias("p"),
        (F.col("probability") >= num(0.5)).cast("int").alias("predicted"),
    )


def _two_scorers(spark, sf_dir) -> dict[str, DataFrame]:
    """The fixed probability and the rule score, as two competing models."""
    scored = scoring.score(snapshot(spark, sf_dir)).where(F.col(TARGET).isNotNull())
    rule = scored.select(
        F.col(TARGET).alias("label"),
        (F.col("total_score") / num(1100)).alias("p"),
        (F.col("total_score") >= 650).cast("int").alias("predicted"),
    )
    return {"fixed": _predictions(spark, sf_dir), "rule": rule}


def _best_model(spark, sf_dir) -> DataFrame:
    rows = None
    for name, df in _two_scorers(spark, sf_dir).items():
        auc = metrics.roc_auc(df).scalar()
        row = metrics.classification_metrics(df).withColumns(
            {"roc_auc": auc, "model": F.lit(name), "error": F.lit(None).cast("string")}
        )
        rows = row if rows is None else rows.unionByName(row)
    return rounded(metrics.best_model(rows).select("model", "f1_score", "roc_auc"), 6, "f1_score", "roc_auc")


def _cv_summary(spark, sf_dir) -> DataFrame:
    """Folds by key, so that both engines cut them alike."""
    df = _predictions(spark, sf_dir)
    rows = None
    for f in range(3):
        part = df.where(F.col(KEY) % 3 == f)
        row = metrics.classification_metrics(part).withColumns(
            {"roc_auc": metrics.roc_auc(part).scalar(), "model": F.lit("fixed")}
        )
        rows = row if rows is None else rows.unionByName(row)
    summary = metrics.cv_summary(rows)
    return rounded(summary, 6, *[c for c in summary.columns if c != "model"])


def _regression(spark, sf_dir) -> DataFrame:
    held = _STORED.predict(snapshot(spark, sf_dir)).select(F.col(TARGET).alias("label"), F.col("predicted_score").alias("fitted"))
    return rounded(metrics.regression_metrics(held), 6, "mse", "rmse", "r2_score")


def _ols(spark, sf_dir) -> DataFrame:
    fit = regression.fit_ols(snapshot(spark, sf_dir).where(F.col(TARGET).isNotNull()), ["ingreso_mensual"])
    return spark.createDataFrame(
        [(round(fit.coefficients["ingreso_mensual"] * 1e6, 6), round(fit.intercept, 8))], "slope_ppm double, intercept double"
    )


def _ols_gaps(spark, sf_dir) -> DataFrame:
    """The fit on ten features against its normal equations: residuals orthogonal to the constant and to every
    feature, as the cosine of the angle between them, which only the least-squares fit brings to zero."""
    names = FEATURES[:10]
    df = clean.clean(snapshot(spark, sf_dir)).withColumn("y", F.col(TARGET).cast("double"))
    df = materialize(df, "ols")
    fit = regression.fit_ols(df, names)
    off = df.withColumns({"intercept": num(1), "off": F.col("y") - fit.value()})
    terms = ["intercept", *names]
    x = {c: F.col(c).cast("double") for c in terms}
    cosines = off.agg(
        F.count("*").alias("n"),
        F.avg(fit.value()).alias("mean_fitted"),
        *[(F.sum(v * F.col("off")) / F.sqrt(F.sum(v * v) * F.sum(F.col("off") * F.col("off")))).alias(c) for c, v in x.items()],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("term"), F.abs(F.coalesce(c, num(0))).alias("gap")) for c in terms])
    out = cosines.select("n", "mean_fitted", F.explode(rows).alias("r")).select("r.term", "n", "mean_fitted", "r.gap")
    return rounded(out, 5, "mean_fitted", "gap")


def _ols_table(spark, sf_dir) -> DataFrame:
    df = clean.engineer_features(clean.clean(snapshot(spark, sf_dir)))
    fit, _ = regression.linear_regression(df, FEATURES[:10])
    return regression.coefficient_table(spark, fit)


def _predict_labels(spark, sf_dir) -> DataFrame:
    df = decisions.prediction(fixed_probability(snapshot(spark, sf_dir)))
    return rounded(df.select(KEY, "prediction", "probability", "prediction_label", "confidence"), 6, "confidence")


# --- evaluations log ---------------------------------------------------------------------------------------


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged evaluation per client, at the date on file."""
    at = loaded(spark, sf_dir)["evaluaciones"].select(KEY, F.col("fecha_evaluacion").cast("timestamp").alias("_at"))
    return log.evaluation_rows(decided(snapshot(spark, sf_dir)).join(at, KEY), F.col("_at"), F.col(KEY))


def label_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a relabelling event of its client; open states are not labels and must be refused."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    label = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(2)
    return orders.select(
        F.col("o_custkey").alias("id"),
        label.alias("true_label"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.col("o_orderkey").alias("event_id"),
    )


def deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients with an error event have asked for deletion."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == "error").select(F.col("user_id").alias("id"))


def _live(spark, sf_dir) -> DataFrame:
    return log.live_evaluations(
        evaluations(spark, sf_dir), log.valid_labels(label_log(spark, sf_dir)), deletions(spark, sf_dir)
    )


def _recent(spark, sf_dir) -> DataFrame:
    recent = log.recent_evaluations(evaluations(spark, sf_dir), 100)
    return recent.select(
        "id", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), "final_decision", "total_score", "confidence_frac"
    ).withColumn("confidence_frac", F.round("confidence_frac", 6))


def _labels(spark, sf_dir) -> DataFrame:
    latest = log.latest_labels(log.valid_labels(label_log(spark, sf_dir)))
    return latest.select("id", "true_label", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


def _compacted(spark, sf_dir) -> DataFrame:
    """The log in two appends, its labels and deletions folded in, then read by its snapshot."""
    path = _work(spark, "evaluations-snapshots")
    rows = materialize(evaluations(spark, sf_dir), "evaluations")
    for kept in (F.col("total_score") < 650, F.col("total_score") >= 650):
        log.append_snapshot(rows.where(kept), path)
    log.compact_touched(spark, path, log.valid_labels(label_log(spark, sf_dir)), deletions(spark, sf_dir))
    return log.read_snapshot(spark, path).select("id", "true_label", "final_decision")


def _feedback(spark, sf_dir) -> DataFrame:
    return training.union_feedback(snapshot(spark, sf_dir), _live(spark, sf_dir))


# --- streams -----------------------------------------------------------------------------------------------


def _logged(spark, sf_dir) -> DataFrame:
    """The evaluations appended to a log and read back: rows and scores per day."""
    path = _work(spark, "evaluations-log")
    log.append_evaluations(evaluations(spark, sf_dir), path)
    stored = log.read_evaluations(spark, path)
    return stored.groupBy(F.date_format("created_date", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.sum("total_score").alias("score")
    )


def _event_counts(spark, sf_dir) -> DataFrame:
    """Events per day and kind, counted by a stream over the events file; days that the watermark has closed."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.withColumn("value", F.col("value").cast("decimal(12,2)"))
    counts = jobs.windowed_counts(stream, "event_type", at="ts", window="1 day", late="1 hour", value="value")
    path = _work(spark, "event-counts")
    jobs.write_windows(counts, path, _work(spark, "event-counts-progress")).awaitTermination()
    return spark.read.parquet(path).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total")
    )


def _scored_stream(spark, sf_dir) -> DataFrame:
    """The profiles as JSON applications through the scoring stream into a log, read back."""
    arrivals, path = _work(spark, "applications"), _work(spark, "evaluations")
    at = loaded(spark, sf_dir)["evaluaciones"].select(KEY, F.col("fecha_evaluacion").cast("timestamp").alias("created_at"))
    snapshot(spark, sf_dir).drop(TARGET).na.fill(0).join(at, KEY).write.json(arrivals)
    scored = jobs.score_stream(
        jobs.read_applications(spark, arrivals), lambda df: decisions.prediction(fixed_probability(df))
    )
    jobs.write_evaluations(scored, path, _work(spark, "evaluations-progress")).awaitTermination()
    stored = log.read_evaluations(spark, path)
    return stored.groupBy("final_decision", "classification").agg(F.count("*").alias("n"), F.sum("total_score").alias("score"))


def _decision_stream(spark, sf_dir) -> DataFrame:
    """Decisions per day from a stream over the evaluations log; days that the watermark has closed."""
    arrivals, path = _work(spark, "decisions"), _work(spark, "decision-counts")
    evaluations(spark, sf_dir).select("created_at", "final_decision").write.parquet(arrivals)
    stream = spark.readStream.schema("created_at timestamp, final_decision string").parquet(arrivals)
    jobs.write_windows(jobs.decision_counts_stream(stream), path, _work(spark, "decision-progress")).awaitTermination()
    stored = spark.read.schema("window_start timestamp, final_decision string, n long").parquet(path)
    return stored.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "final_decision", "n")


def _label_arrivals(spark, sf_dir) -> str:
    """Label events as files, each event delivered twice, the newest first: every part is one trigger or more."""
    arrivals = _work(spark, "label-events")
    events = label_log(spark, sf_dir)
    newest = events.agg(F.max("updated_at")).scalar()
    old = F.col("updated_at") < newest - F.expr("INTERVAL 365 DAYS")
    for part in (events.where(~old), events.where(old), events):
        part.write.mode("append").json(arrivals)
    return arrivals


def _label_stream(spark, sf_dir) -> DataFrame:
    """Label events, out of order and with repeats, through the stream into a log."""
    path = _work(spark, "labels")
    labels = jobs.label_stream(jobs.read_labels(spark, _label_arrivals(spark, sf_dir)))
    jobs.write_labels(labels, path, _work(spark, "labels-progress")).awaitTermination()
    stored = spark.read.parquet(path)
    return stored.groupBy("true_label").agg(F.count("event_id").alias("n"), F.count_distinct("id").alias("clients"))


def _newest_label_stream(spark, sf_dir) -> DataFrame:
    """The label that the stream of newest labels gave each evaluation last, by the number of the batch alone."""
    path = _work(spark, "newer-labels")
    labels = jobs.newest_labels_stream(jobs.read_labels(spark, _label_arrivals(spark, sf_dir), files_per_trigger=8))
    jobs.write_newest_labels(labels, path, _work(spark, "newer-labels-progress")).awaitTermination()
    last = F.max_by(F.struct("true_label", "updated_at"), "batch").alias("l")
    latest = spark.read.parquet(path).groupBy("id").agg(last).select("id", "l.*")
    return latest.select("id", "true_label", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


def _application_sinks(spark, sf_dir) -> DataFrame:
    """Applications, some of which break rules, through the stream with an error table: days logged, reasons counted."""
    arrivals, path, errors = (_work(spark, n) for n in ("mixed-applications", "mixed-log", "mixed-errors"))
    at = loaded(spark, sf_dir)["evaluaciones"].select(KEY, F.col("fecha_evaluacion").cast("timestamp").alias("created_at"))
    _applications(spark, sf_dir).drop(TARGET).join(at, KEY).write.json(arrivals)
    jobs.write_scored(
        jobs.read_applications(spark, arrivals), lambda df: decisions.prediction(fixed_probability(df)),
        path, errors, _work(spark, "mixed-progress"),
    ).awaitTermination()
    logged = log.read_evaluations(spark, path).select(F.lit("logged").alias("outcome"))
    refused = spark.read.parquet(errors).select(F.explode("reject_reasons").alias("outcome"))
    return logged.unionByName(refused).groupBy("outcome").agg(F.count("*").alias("n"))


# --- preparation and models --------------------------------------------------------------------------------


def _training_frame(spark, sf_dir) -> DataFrame:
    """Cleaned, enriched profiles with their label, written once."""
    df = clean.engineer_features(clean.clean(snapshot(spark, sf_dir).where(F.col(TARGET).isNotNull())))
    return materialize(df.withColumn("label", F.col(TARGET).cast("int")), "labelled")


def _weights(spark, sf_dir) -> DataFrame:
    df = snapshot(spark, sf_dir).where(F.col(TARGET).isNotNull()).select(KEY, F.col(TARGET).alias("label"))
    return rounded(prep.balanced_weights(df), 9, "weight")


def _split(spark, sf_dir) -> DataFrame:
    train, test = prep.stratified_split(_training_frame(spark, sf_dir).select(KEY, "label"))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "label").agg(F.count("*").alias("n"))


def _random_split(spark, sf_dir) -> DataFrame:
    """Clients by how often the two parts of a random split hold them, and whether the same split comes again from rows
    dealt otherwise."""
    df = snapshot(spark, sf_dir).select(KEY)
    parts = None
    for seed_run, rows in enumerate((df, df.repartition(5))):
        for part, found in zip(("train", "test"), prep.random_split(rows)):
            found = found.select(KEY, F.lit(part).alias("part"), F.lit(seed_run).alias("run"))
            parts = found if parts is None else parts.unionByName(found)
    per_client = parts.groupBy(KEY).agg(F.count("*").alias("times"), F.count_distinct("part").alias("parts"))
    return per_client.select(KEY, "times", "parts")


def _folds(spark, sf_dir) -> DataFrame:
    folded = prep.stratified_folds(_training_frame(spark, sf_dir).select(KEY, "label"), 5)
    return folded.groupBy("fold", "label").agg(F.count("*").alias("n"))


def _smote(spark, sf_dir) -> DataFrame:
    df = prep.smote(_training_frame(spark, sf_dir), ["ingreso_mensual", "total_gastos", "capital_trabajo"])
    return df.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col(KEY) < 0).alias("synthetic"))


def _smote_counts(spark, sf_dir) -> DataFrame:
    return _smote(spark, sf_dir).select("label", "n")


def _power(spark, sf_dir) -> DataFrame:
    df = _training_frame(spark, sf_dir).select(KEY, "ingreso_mensual", "total_gastos", "capital_trabajo")
    columns = df.columns[1:]
    scaled = scaling.RobustScale.fit(df, columns).transform(df)
    return scaling.power_transform(scaled, scaling.fit_yeo_johnson(scaled, columns))


def _selected(spark, sf_dir) -> DataFrame:
    df = _training_frame(spark, sf_dir)
    names = clean.numeric_columns(df, exclude=(KEY, TARGET, "label"))
    chosen = prep.select_features(df, names)
    return spark.createDataFrame(list(enumerate(chosen)), "position int, feature string")


_TRAINED: dict[tuple[str, str], training.TrainingResult] = {}


def _trained(spark, sf_dir) -> training.TrainingResult:
    """The training shared by the queries that look at one: ten models with their grids, five folds, stacked."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = training.train_all(snapshot(spark, sf_dir))
    return _TRAINED[key]


def _boosted(spark, sf_dir) -> DataFrame:
    train, test, _ = training.prepare(snapshot(spark, sf_dir))
    model = supervised.specs()["AdaBoost"].fit(train)
    return model.transform(test).select(F.col("client").alias(KEY), "label", "p", "predicted")


def _gbt(spark, sf_dir) -> DataFrame:
    """Measures of the boosted presets and the network, all fitted at once."""
    train, test, _ = training.prepare(snapshot(spark, sf_dir))
    full = supervised.specs()
    names = ("XGBoost", "LightGBM", "CatBoost", "Gradient Boosting", "Neural Network")
    found = fits.fit_all(train, {n: full[n] for n in names})
    rows = None
    for name in names:
        scored = found[name, None].transform(test).select("label", "p", "predicted", F.lit(name).alias("model"))
        rows = scored if rows is None else rows.unionByName(scored)
    return metrics.evaluate_groups(materialize(rows, "held"), "model")


def _tuned(spark, sf_dir) -> DataFrame:
    """Every point of the three grids with its mean AUC over three folds."""
    train, _, _ = training.prepare(snapshot(spark, sf_dir))
    full = {n: s for n, s in supervised.specs().items() if isinstance(s, fits.TreeSpec) and s.grid}
    rows = [(name, p.trees, p.depth, p.least, p.step, score) for name, p, score in fits.grid_scores(train, full)]
    return spark.createDataFrame(rows, "model string, trees int, depth int, min_instances int, step double, roc_auc double")


def _knn_model(spark, sf_dir) -> DataFrame:
    train, test, _ = training.prepare(snapshot(spark, sf_dir))
    return supervised.KnnSpec(5).fit(train).transform(test).select(F.col("client").alias(KEY), "label", "p", "predicted")


def _shap(spark, sf_dir) -> DataFrame:
    result = _trained(spark, sf_dir)
    model = result.models["Random Forest"]
    return explain.shap_summary(explain.shapley_values(model, result.train, result.preprocessor.names))


def _stacked(spark, sf_dir) -> DataFrame:
    return _trained(spark, sf_dir).predictions[training.ENSEMBLE]


def _batch(spark, sf_dir) -> DataFrame:
    result = _trained(spark, sf_dir)
    return training.predict_records(snapshot(spark, sf_dir), result.preprocessor, result.best_model, result.best).select(
        KEY, "prediction_label", "probability", "confidence", "total_score", "classification", "final_decision", "risk_level"
    )


def _batch_rejects(spark, sf_dir) -> DataFrame:
    """What becomes of each of the applications, some of which break rules: predicted, or the error. Which model
    predicts is no part of the answer, so one is enough."""
    specs = {"Logistic Regression": supervised.specs()["Logistic Regression"]}
    result = training.train_all(snapshot(spark, sf_dir), specs=specs, cv_folds=0, stacking=False)
    rows = training.predict_records(_applications(spark, sf_dir), result.preprocessor, result.best_model, result.best)
    return rows.select(KEY, F.col("prediction").isNotNull().alias("predicted"), "error")


def _stored_model(spark, sf_dir) -> DataFrame:
    """Predictions of a model after a trip through the store."""
    result = _trained(spark, sf_dir)
    path = _work(spark, "model")
    save_model(spark, path, result.best, result.best_model, result.preprocessor)
    name, model, preprocessor = load_model(spark, path)
    return training.predict(snapshot(spark, sf_dir), preprocessor, model, name).select(KEY, "probability", "prediction_label")


def _retrained(spark, sf_dir) -> DataFrame:
    _, result = training.retrain_with_feedback(snapshot(spark, sf_dir), _live(spark, sf_dir))
    return result.metrics


def _targets(spark, sf_dir) -> DataFrame:
    """One training per outcome of the decision rules."""
    df = decided(snapshot(spark, sf_dir)).select(
        KEY,
        *FEATURES,
        F.col("core_rule").isin("approve", "conditions").cast("int").alias("resultado_aprobado"),
        (F.col("core_rule") == "reject").cast("int").alias("resultado_rechazado"),
        F.col("risk_level").isin("Moderado", "Alto").cast("int").alias("resultado_riesgo_medio"),
    )
    results = training.train_targets(materialize(df, "targets"))
    rows = None
    for target, result in results.items():
        row = result.metrics.withColumn("target", F.lit(target))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def _cv_frame(spark, sf_dir) -> DataFrame:
    return metrics.cv_summary(_trained(spark, sf_dir).cv)


QUERIES = {
    "confusion": lambda s, d: metrics.confusion_matrix(_predictions(s, d)),
    "class_metrics": lambda s, d: rounded(
        metrics.classification_metrics(_predictions(s, d)), 6, "accuracy", "precision", "recall", "f1_score"
    ),
    "roc_auc": lambda s, d: rounded(metrics.roc_auc(_predictions(s, d)), 9, "roc_auc"),
    "regression_metrics": _regression,
    "cv_summary": _cv_summary,
    "best_model": _best_model,
    "ols_coefficients": _ols,
    "ols_normal_equations": _ols_gaps,
    "ols_predict": lambda s, d: rounded(
        _STORED.predict(snapshot(s, d)).select(KEY, "predicted_score", "predicted_label"), 6, "predicted_score"
    ),
    "ols_top_coefficients": _ols_table,
    "linear_shap": lambda s, d: rounded(explain.linear_shap(snapshot(s, d), _STORED.coefficients), 6, "mean_abs_shap"),
    "predict_labels": _predict_labels,
    "balanced_weights": _weights,
    "split": _split,
    "folds": _folds,
    "random_split": _random_split,
    "smote": _smote_counts,
    "yeo_johnson": _power,
    "select_features": _selected,
    "evaluations_logged": _logged,
    "evaluations_recent": _recent,
    "evaluation_counts": lambda s, d: log.evaluation_counts(_live(s, d)),
    "labels_latest": _labels,
    "evaluations_compacted": _compacted,
    "evaluations_live": lambda s, d: _live(s, d).select("id", "true_label", "final_decision"),
    "union_feedback": _feedback,
    "stream_event_counts": _event_counts,
    "stream_decision_counts": _decision_stream,
    "stream_scored": _scored_stream,
    "stream_labels": _label_stream,
    "stream_labels_newest": _newest_label_stream,
    "stream_application_sinks": _application_sinks,
    "models_metrics": lambda s, d: _trained(s, d).metrics,
    "cross_validation": _cv_frame,
    "stacking": _stacked,
    "importance": lambda s, d: metrics.top_importance(_trained(s, d).importance),
    "model_registry": lambda s, d: model_registry(_trained(s, d)),
    "model_store": _stored_model,
    "predict_batch": _batch,
    "predict_batch_rejects": _batch_rejects,
    "shap": _shap,
    "boosted_models": _gbt,
    "adaboost": _boosted,
    "knn_model": _knn_model,
    "grid_search": _tuned,
    "train_targets": _targets,
    "retrain": _retrained,
}
