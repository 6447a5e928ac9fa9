"""ANSI SQL for the queries over predictions, the evaluations log and streams."""

from __future__ import annotations

from credilake.constants import FEATURES
from credilake.plans.oracle_core import APPLICATIONS, DECIDED, FEATURE_LIST, SCORED, with_profile

_P = """predicciones AS (
  SELECT id_cliente, viable AS label, CAST((id_cliente * 37) % 101 AS DOUBLE) / 100 AS p,
         CASE WHEN CAST((id_cliente * 37) % 101 AS DOUBLE) / 100 >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS predicted
  FROM perfil WHERE viable IS NOT NULL)"""


def _measures(source: str, by: str = "'fixed'") -> str:
    """Accuracy to AUC per ``by`` over label, p and predicted."""
    return f"""
  SELECT t.g, acc AS accuracy, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS precision, COALESCE(tp / NULLIF(tp + fn, 0), 0) AS recall,
         COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1_score, wins / (pos * neg) AS roc_auc
  FROM (SELECT {by} AS g, AVG(CAST(label = predicted AS INTEGER)) AS acc,
               CAST(SUM(CASE WHEN label = 1 AND predicted = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
               CAST(SUM(CASE WHEN label = 0 AND predicted = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
               CAST(SUM(CASE WHEN label = 1 AND predicted = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
               CAST(SUM(label) AS DOUBLE) AS pos, CAST(SUM(1 - label) AS DOUBLE) AS neg
        FROM {source} GROUP BY 1) t
  JOIN (SELECT a.g, SUM(a.pos * (b.neg * CASE WHEN b.p < a.p THEN 1 ELSE CAST(0.5 AS DOUBLE) END)) AS wins
        FROM (SELECT {by} AS g, p, SUM(label) AS pos FROM {source} GROUP BY 1, 2) a
        JOIN (SELECT {by} AS g, p, SUM(1 - label) AS neg FROM {source} GROUP BY 1, 2) b ON a.g = b.g AND b.p <= a.p
        GROUP BY 1) w ON w.g = t.g"""


_FIT = (
    "CAST(0.4 AS DOUBLE) + ingreso_mensual * CAST(1e-5 AS DOUBLE) + total_deudas * CAST(-5e-6 AS DOUBLE)"
    " + tem * CAST(-1.5 AS DOUBLE) + num_cuotas * CAST(0.01 AS DOUBLE)"
)
_COEFFICIENTS = {"ingreso_mensual": "1e-5", "total_deudas": "-5e-6", "tem": "-1.5", "num_cuotas": "0.01"}

_LABEL_EVENTS = """eventos_etiqueta AS (
  SELECT o_custkey AS id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 2 END AS true_label,
         o_orderdate AS updated_at, o_orderkey AS event_id FROM orders)"""
_LABELS = (
    _LABEL_EVENTS
    + """, etiquetas AS (
  SELECT id, true_label, updated_at FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY updated_at DESC, event_id DESC) AS rn
    FROM eventos_etiqueta WHERE true_label IN (0, 1)) WHERE rn = 1)"""
)
_LOG = """registro AS (
  SELECT d.*, e.fecha_evaluacion, a.action AS final_decision, GREATEST(p, 1 - p) AS confidence_frac
  FROM decidido d JOIN evaluaciones e ON e.id_cliente = d.id_cliente JOIN acciones a ON a.core_rule = d.core_rule AND a.pos = 0)"""
_LIVE = """vivas AS (
  SELECT r.*, l.true_label FROM registro r LEFT JOIN etiquetas l ON l.id = r.id_cliente
  WHERE r.id_cliente NOT IN (SELECT user_id FROM events WHERE event_type = 'error'))"""

_FILLED = (
    "perfil_lleno AS (SELECT id_cliente, "
    + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in FEATURE_LIST)
    + ", viable FROM perfil)"
)

LEARN = {
    "confusion": with_profile(
        """SELECT COUNT(CASE WHEN label = 0 AND predicted = 0 THEN 1 END) AS true_negative,
                  COUNT(CASE WHEN label = 0 AND predicted = 1 THEN 1 END) AS false_positive,
                  COUNT(CASE WHEN label = 1 AND predicted = 0 THEN 1 END) AS false_negative,
                  COUNT(CASE WHEN label = 1 AND predicted = 1 THEN 1 END) AS true_positive FROM predicciones""",
        _P,
    ),
    "class_metrics": with_profile(
        "SELECT ROUND(accuracy, 6) AS accuracy, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,"
        f" ROUND(f1_score, 6) AS f1_score FROM ({_measures('predicciones')})",
        _P,
    ),
    "roc_auc": with_profile(f"SELECT ROUND(roc_auc, 9) AS roc_auc FROM ({_measures('predicciones')})", _P),
    "regression_metrics": with_profile(
        f"""SELECT ROUND(AVG(e * e), 6) AS mse, ROUND(sqrt(AVG(e * e)), 6) AS rmse,
                   ROUND(1 - AVG(e * e) / VAR_POP(viable), 6) AS r2_score
            FROM (SELECT viable, viable - ({_FIT}) AS e FROM perfil)"""
    ),
    "cv_summary": with_profile(
        "SELECT 'fixed' AS model, "
        + ", ".join(
            f"ROUND(AVG({m}), 6) AS {m}_mean, ROUND(STDDEV_POP({m}), 6) AS {m}_std"
            for m in ("accuracy", "precision", "recall", "f1_score", "roc_auc")
        )
        + f" FROM ({_measures('predicciones', 'id_cliente % 3')})",
        _P,
    ),
    "best_model": with_profile(
        f"""SELECT g AS model, ROUND(f1_score, 6) AS f1_score, ROUND(roc_auc, 6) AS roc_auc FROM (
              SELECT * FROM ({_measures('predicciones')}) UNION ALL SELECT * FROM ({_measures('regla', "'rule'")}))
            ORDER BY f1_score * 0.5 + roc_auc * 0.5 DESC, model LIMIT 1""",
        _P,
        SCORED,
        """regla AS (SELECT viable AS label, CAST(base_score AS DOUBLE) / 1100 AS p,
                            CASE WHEN base_score >= 650 THEN 1 ELSE 0 END AS predicted FROM puntaje WHERE viable IS NOT NULL)""",
    ),
    "ols_coefficients": with_profile(
        """SELECT ROUND(regr_slope(viable, ingreso_mensual) * 1000000, 6) AS slope_ppm,
                  ROUND(regr_intercept(viable, ingreso_mensual), 8) AS intercept FROM perfil"""
    ),
    "ols_predict": with_profile(
        f"""SELECT id_cliente, ROUND(y, 6) AS predicted_score,
                   CASE WHEN y >= CAST(0.5 AS DOUBLE) THEN 'VIABLE' ELSE 'NO VIABLE' END AS predicted_label
            FROM (SELECT id_cliente, {_FIT} AS y FROM perfil)"""
    ),
    "linear_shap": with_profile(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, ROUND(AVG(ABS(({c} - (SELECT AVG({c}) FROM perfil)) * CAST({w} AS DOUBLE))), 6) AS mean_abs_shap FROM perfil"
            for c, w in _COEFFICIENTS.items()
        )
    ),
    "predict_labels": with_profile(
        """SELECT id_cliente, CASE WHEN p >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS prediction, p AS probability,
                  CASE WHEN p >= CAST(0.5 AS DOUBLE) THEN 'VIABLE' ELSE 'NO VIABLE' END AS prediction_label,
                  ROUND(GREATEST(p, 1 - p) * 100, 6) AS confidence
           FROM (SELECT id_cliente, CAST((id_cliente * 37) % 101 AS DOUBLE) / 100 AS p FROM perfil)"""
    ),
    "balanced_weights": with_profile(
        """SELECT id_cliente, viable AS label, ROUND(CAST(total AS DOUBLE) / (classes * n), 9) AS weight FROM (
             SELECT p.id_cliente, p.viable, c.n, (SELECT COUNT(*) FROM perfil WHERE viable IS NOT NULL) AS total,
                    (SELECT COUNT(DISTINCT viable) FROM perfil) AS classes
             FROM perfil p JOIN (SELECT viable, COUNT(*) AS n FROM perfil GROUP BY 1) c ON c.viable = p.viable)"""
    ),
    # exact shares per class and part; which rows fall where is the hash's business
    "split": with_profile(
        """SELECT part, label, CASE part WHEN 'test' THEN t ELSE n - t END AS n FROM (
             SELECT viable AS label, COUNT(*) AS n, CAST(ROUND(COUNT(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS t
             FROM perfil WHERE viable IS NOT NULL GROUP BY 1) CROSS JOIN (VALUES ('train'), ('test')) AS v(part)"""
    ),
    "random_split": with_profile("SELECT id_cliente, 2 AS times, 1 AS parts FROM perfil"),
    "ols_normal_equations": with_profile(
        "SELECT term, n, ROUND(m, 5) AS mean_fitted, CAST(0 AS DOUBLE) AS gap FROM"
        " (SELECT COUNT(*) AS n, AVG(COALESCE(viable, 0)) AS m FROM perfil) CROSS JOIN (VALUES ('intercept'), "
        + ", ".join(f"('{c}')" for c in FEATURES[:10])
        + ") AS v(term)"
    ),
    "folds": with_profile(
        """SELECT CAST(fold AS INTEGER) AS fold, label, (n - fold + 4) // 5 AS n FROM (
             SELECT viable AS label, COUNT(*) AS n FROM perfil WHERE viable IS NOT NULL GROUP BY 1)
           CROSS JOIN (SELECT range AS fold FROM range(0, 5))"""
    ),
    "smote": with_profile(
        """SELECT label, MAX(n) OVER () AS n FROM (
             SELECT viable AS label, COUNT(*) AS n FROM perfil WHERE viable IS NOT NULL GROUP BY 1)"""
    ),
    "evaluations_logged": with_profile(
        """SELECT strftime(fecha_evaluacion, '%Y-%m-%d') AS day, COUNT(*) AS n, CAST(SUM(total_score) AS BIGINT) AS score
           FROM registro GROUP BY 1""",
        SCORED,
        DECIDED,
        _LOG,
    ),
    "evaluations_recent": with_profile(
        """SELECT id_cliente AS id, strftime(fecha_evaluacion, '%Y-%m-%d') AS created_on, final_decision, total_score,
                  ROUND(confidence_frac, 6) AS confidence_frac
           FROM registro ORDER BY fecha_evaluacion DESC, id_cliente LIMIT 100""",
        SCORED,
        DECIDED,
        _LOG,
    ),
    "evaluation_counts": with_profile(
        "SELECT COUNT(*) AS total, COUNT(true_label) AS labelled FROM vivas", SCORED, DECIDED, _LOG, _LABELS, _LIVE
    ),
    "labels_latest": f"WITH {_LABELS} SELECT id, true_label, strftime(updated_at, '%Y-%m-%d') AS updated_on FROM etiquetas",
    "evaluations_compacted": with_profile(
        "SELECT id_cliente AS id, true_label, final_decision FROM vivas", SCORED, DECIDED, _LOG, _LABELS, _LIVE
    ),
    "evaluations_live": with_profile(
        "SELECT id_cliente AS id, true_label, final_decision FROM vivas", SCORED, DECIDED, _LOG, _LABELS, _LIVE
    ),
    "union_feedback": with_profile(
        "SELECT id_cliente, "
        + ", ".join(FEATURE_LIST)
        + ", viable FROM perfil UNION ALL SELECT CAST(NULL AS BIGINT), "
        + ", ".join(FEATURE_LIST)
        + ", true_label FROM vivas WHERE true_label IS NOT NULL",
        SCORED,
        DECIDED,
        _LOG,
        _LABELS,
        _LIVE,
    ),
    "stream_event_counts": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, COUNT(*) AS n,
       CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events
  WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""",
    "stream_decision_counts": with_profile(
        """SELECT strftime(e.fecha_evaluacion, '%Y-%m-%d') AS day, a.action AS final_decision, COUNT(*) AS n
           FROM decidido d JOIN acciones a ON a.core_rule = d.core_rule AND a.pos = 0
                JOIN evaluaciones e ON e.id_cliente = d.id_cliente
           WHERE e.fecha_evaluacion + INTERVAL 1 DAY <= (SELECT max(fecha_evaluacion) FROM evaluaciones) - INTERVAL 1 HOUR
           GROUP BY 1, 2""",
        SCORED,
        DECIDED,
    ),
    "predict_batch_rejects": with_profile(
        """
SELECT id_cliente, COUNT(reason) = 0 AS predicted, string_agg(reason, '; ' ORDER BY rule) AS error FROM (
  SELECT id_cliente, NULL AS reason, 0 AS rule FROM sol
  UNION ALL SELECT id_cliente, 'ingreso_mensual must be > 0', 1 FROM sol WHERE ingreso_mensual <= 0
  UNION ALL SELECT id_cliente, 'total_activos must be >= 0', 2 FROM sol WHERE total_activos < 0
  UNION ALL SELECT id_cliente, 'tem must be <= 1', 3 FROM sol WHERE tem > 1
  UNION ALL SELECT id_cliente, 'num_cuotas must be >= 1', 4 FROM sol WHERE num_cuotas < 1
  UNION ALL SELECT id_cliente, 'num_cuotas must be <= 120', 4 FROM sol WHERE num_cuotas > 120)
GROUP BY 1""",
        APPLICATIONS,
    ),
    "stream_scored": with_profile(
        """SELECT a.action AS final_decision, d.classification, COUNT(*) AS n, CAST(SUM(d.total_score) AS BIGINT) AS score
           FROM decidido d JOIN acciones a ON a.core_rule = d.core_rule AND a.pos = 0
                JOIN evaluaciones e ON e.id_cliente = d.id_cliente GROUP BY 1, 2""",
        _FILLED,
        SCORED.replace("FROM perfil", "FROM perfil_lleno"),
        DECIDED,
    ),
    "stream_labels": f"""WITH {_LABEL_EVENTS} SELECT true_label, COUNT(*) AS n, COUNT(DISTINCT id) AS clients
FROM eventos_etiqueta WHERE true_label IN (0, 1) GROUP BY 1""",
    "stream_application_sinks": with_profile(
        """
SELECT outcome, COUNT(*) AS n FROM (
  SELECT CASE WHEN a.ingreso_mensual > 0 AND a.total_activos >= 0 AND a.tem <= 1 AND a.num_cuotas BETWEEN 1 AND 120 THEN 'logged' END AS outcome
  FROM sol a JOIN evaluaciones e USING (id_cliente)
  UNION ALL SELECT 'ingreso_mensual must be > 0' FROM sol JOIN evaluaciones USING (id_cliente) WHERE ingreso_mensual <= 0
  UNION ALL SELECT 'total_activos must be >= 0' FROM sol JOIN evaluaciones USING (id_cliente) WHERE total_activos < 0
  UNION ALL SELECT 'tem must be <= 1' FROM sol JOIN evaluaciones USING (id_cliente) WHERE tem > 1
  UNION ALL SELECT 'num_cuotas must be >= 1' FROM sol JOIN evaluaciones USING (id_cliente) WHERE num_cuotas < 1
  UNION ALL SELECT 'num_cuotas must be <= 120' FROM sol JOIN evaluaciones USING (id_cliente) WHERE num_cuotas > 120)
WHERE outcome IS NOT NULL GROUP BY 1""",
        APPLICATIONS,
    ),
}
LEARN["stream_labels_newest"] = LEARN["labels_latest"]
