"""ANSI SQL for the core queries, over the same tables. Written apart from the Spark code on purpose."""

from __future__ import annotations

from credilake.constants import MULTI_TARGETS, REPORT_KPIS

SOURCES = """
ingresos AS (
  SELECT o_custkey AS id_cliente, CAST(date_trunc('month', o_orderdate) AS DATE) AS mes_referencia,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / 20 AS ingreso_mensual
  FROM orders GROUP BY 1, 2),
gastos AS (
  SELECT o_custkey AS id_cliente, CAST(date_trunc('month', o_orderdate) AS DATE) AS mes_referencia,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / 2 AS total_gastos,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) / 4 AS total_costos
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
deudas AS (
  SELECT o_custkey AS id_cliente, CAST(o_totalprice AS DECIMAL(14,2)) AS saldo_x20,
         CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 61 ELSE 0 END AS mora_diaria
  FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '1-URGENT'),
resumen_deudas AS (
  SELECT id_cliente, COUNT(*) AS num_deudas, MAX(mora_diaria) AS mora_diaria,
         CAST(SUM(saldo_x20) AS DOUBLE) / 20 AS owed
  FROM deudas GROUP BY 1),
patrimonio AS (
  SELECT id_cliente, total_activos, total_deudas, total_activos - total_deudas AS capital_trabajo,
         total_deudas / NULLIF(total_activos, 0) AS endeudamiento_patrimonial
  FROM (SELECT c_custkey AS id_cliente, CASE WHEN c_acctbal > 0 THEN c_acctbal * 20 ELSE 0 END AS total_activos,
               COALESCE(d.owed, 0) AS total_deudas
        FROM customer LEFT JOIN resumen_deudas d ON d.id_cliente = c_custkey)),
ultimo_pedido AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
                 FROM orders) WHERE rn = 1),
solicitudes AS (
  SELECT id_cliente, monto_solicitado, tem, num_cuotas, monto_solicitado * CAST(0.9 AS DOUBLE) AS monto_propuesto,
         ROUND(monto_solicitado * (tem * POW(1 + tem, num_cuotas)) / (POW(1 + tem, num_cuotas) - 1), 2) AS cuota_estimada
  FROM (SELECT o_custkey AS id_cliente, o_totalprice / 10 AS monto_solicitado,
               CAST(0.01 AS DOUBLE) + (o_custkey % 8) * CAST(0.01 AS DOUBLE) AS tem,
               CASE o_orderpriority WHEN '1-URGENT' THEN 6 WHEN '2-HIGH' THEN 12 WHEN '3-MEDIUM' THEN 18
                                    WHEN '4-NOT SPECIFIED' THEN 24 ELSE 36 END AS num_cuotas
        FROM ultimo_pedido)),
ultimo_ingreso AS (
  SELECT i.* FROM ingresos i
  WHERE i.mes_referencia = (SELECT MAX(m.mes_referencia) FROM ingresos m WHERE m.id_cliente = i.id_cliente)),
evaluaciones AS (
  SELECT i.id_cliente, o.o_orderdate AS fecha_evaluacion,
         CAST(((i.ingreso_mensual - g.total_gastos - g.total_costos > 0)
               AND p.total_deudas <= CAST(0.6 AS DOUBLE) * p.total_activos) <> (i.id_cliente % 10 = 0) AS INTEGER) AS viable
  FROM ultimo_ingreso i JOIN gastos g ON g.id_cliente = i.id_cliente AND g.mes_referencia = i.mes_referencia
       JOIN patrimonio p ON p.id_cliente = i.id_cliente JOIN ultimo_pedido o ON o.o_custkey = i.id_cliente)"""

_PROFILE_SELECT = """
  SELECT c.c_custkey AS id_cliente, i.ingreso_mensual, g.total_gastos, g.total_costos, p.total_activos, p.total_deudas,
         CAST(COALESCE(d.num_deudas, 0) AS INTEGER) AS num_deudas,
         i.ingreso_mensual - g.total_gastos - g.total_costos AS excedente,
         (i.ingreso_mensual - g.total_gastos - g.total_costos) / NULLIF(g.total_gastos + g.total_costos, 0) AS capacidad_pago,
         p.endeudamiento_patrimonial, p.capital_trabajo, s.monto_solicitado, s.tem, s.num_cuotas, s.cuota_estimada,
         s.monto_propuesto, CAST(COALESCE(d.mora_diaria, 0) AS DOUBLE) AS mora_diaria, e.viable
  FROM customer c JOIN ultimo_ingreso i ON i.id_cliente = c.c_custkey
       LEFT JOIN {gastos} g ON g.id_cliente = c.c_custkey
       LEFT JOIN patrimonio p ON p.id_cliente = c.c_custkey
       LEFT JOIN solicitudes s ON s.id_cliente = c.c_custkey
       LEFT JOIN evaluaciones e ON e.id_cliente = c.c_custkey
       LEFT JOIN resumen_deudas d ON d.id_cliente = c.c_custkey"""
JOINED = _PROFILE_SELECT.format(gastos="gastos")
_LATEST_EXPENSES = """(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id_cliente ORDER BY mes_referencia DESC) AS rn
                       FROM gastos) WHERE rn = 1)"""
SNAPSHOT = _PROFILE_SELECT.format(gastos=_LATEST_EXPENSES)

FEATURE_LIST = [
    "ingreso_mensual", "total_gastos", "total_costos", "total_activos", "total_deudas", "num_deudas", "excedente",
    "capacidad_pago", "endeudamiento_patrimonial", "capital_trabajo", "monto_solicitado", "tem", "num_cuotas",
    "cuota_estimada", "monto_propuesto", "mora_diaria",
]


def with_profile(body: str, *ctes: str) -> str:
    """``body`` with the sources, the snapshot profile ``perfil`` and further CTEs in scope."""
    parts = [SOURCES, f"perfil AS ({SNAPSHOT})", *ctes]
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body.strip()


# gaps to the exact column median; every feature becomes double
IMPUTED = (
    "medianas AS (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in FEATURE_LIST)
    + " FROM perfil), limpio AS (SELECT id_cliente, "
    + ", ".join(f"COALESCE(CAST({c} AS DOUBLE), CAST(m_{c} AS DOUBLE), 0) AS {c}" for c in FEATURE_LIST)
    + ", viable FROM perfil CROSS JOIN medianas)"
)
ZERO_FILLED = (
    "ceros AS (SELECT id_cliente, "
    + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in FEATURE_LIST)
    + ", viable FROM perfil)"
)

_E = "CAST(1e-8 AS DOUBLE)"
SUPERVISED_SELECT = f"""
  SELECT id_cliente,
    total_gastos / (ingreso_mensual + {_E}) AS ratio_gastos_ingresos,
    total_deudas / (ingreso_mensual + {_E}) AS ratio_deuda_ingreso,
    cuota_estimada / (ingreso_mensual + {_E}) AS ratio_cuota_ingreso,
    total_activos / (total_deudas + {_E}) AS liquidez,
    excedente / (total_gastos + {_E}) AS cobertura_gastos,
    total_deudas / (total_activos + {_E}) AS peso_deuda,
    excedente / (ingreso_mensual + {_E}) AS capacidad_ahorro,
    monto_solicitado / (ingreso_mensual * num_cuotas + {_E}) AS estres_financiero,
    (total_deudas + monto_solicitado) / (ingreso_mensual * 12 + {_E}) AS carga_financiera_total,
    excedente / (cuota_estimada + {_E}) AS cobertura_cuota,
    total_costos / (total_gastos + {_E}) AS eficiencia_operativa,
    total_deudas / (abs(capital_trabajo) + {_E}) AS apalancamiento,
    total_activos / (total_deudas + {_E}) AS solvencia,
    ingreso_mensual / (num_deudas + {_E}) AS ingreso_por_deuda,
    CAST(mora_diaria > 30 AS INTEGER) AS mora_riesgo,
    CAST(total_deudas / (ingreso_mensual + {_E}) > CAST(0.5 AS DOUBLE) AS INTEGER) AS deuda_alta,
    CAST(excedente > 0 AS INTEGER) AS ahorro_positivo,
    CAST(capacidad_pago < 1 AS INTEGER) AS capacidad_baja,
    ROUND(ln(1 + ingreso_mensual), 6) AS ingreso_log,
    ROUND(ln(1 + total_activos), 6) AS activos_log,
    ROUND(ln(1 + total_deudas), 6) AS deudas_log
  FROM limpio"""

_D = "CAST({} AS DOUBLE)".format


def _bands(value: str, bands: list[tuple[str, float, int]], rest: int) -> str:
    return "CASE " + " ".join(f"WHEN {value} {op} {_D(b)} THEN {p}" for op, b, p in bands) + f" ELSE {rest} END"


_SCORES = {
    "ingreso": _bands(
        "ingreso_mensual", [("<=", 0, 0), ("<", 5000, 30), ("<", 15000, 60), ("<", 30000, 100), ("<", 50000, 130)], 150
    ),
    "gastos": _bands(
        "(total_gastos / (ingreso_mensual + 1))", [("<=", 0.3, 100), ("<=", 0.5, 75), ("<=", 0.7, 50), ("<=", 0.9, 25)], 10
    ),
    "deuda": _bands(
        "(total_deudas / (total_activos + 1))", [("<=", 0.2, 150), ("<=", 0.4, 120), ("<=", 0.6, 80), ("<=", 0.8, 40)], 15
    ),
    "excedente": _bands("excedente", [("<=", 0, 0), ("<", 1000, 30), ("<", 3000, 60), ("<", 8000, 90)], 120),
    "capacidad": _bands("capacidad_pago", [("<=", 0, 0), ("<", 1, 25), ("<", 2, 50), ("<", 5, 75)], 100),
    "num_deudas": _bands("num_deudas", [("=", 0, 80), ("<=", 1, 70), ("<=", 2, 50), ("<=", 3, 30)], 10),
    "mora": _bands(
        "mora_diaria", [("<=", 0, 100), ("<", 5, 80), ("<", 15, 60), ("<", 30, 40), ("<", 50, 20)], 5
    ),
    "endeudamiento": _bands(
        "endeudamiento_patrimonial",
        [("<=", 0, 100), ("<", 0.3, 90), ("<", 0.5, 70), ("<", 0.7, 50), ("<", 1, 30)],
        10,
    ),
    "capital": _bands("capital_trabajo", [(">", 50000, 100), (">", 20000, 80), (">", 0, 60), (">", -20000, 30)], 10),
    "carga": _bands(
        "(monto_solicitado / (ingreso_mensual * 12 + 1))", [("<=", 0.5, 100), ("<=", 1, 80), ("<=", 2, 50), ("<=", 3, 25)], 5
    ),
}
_CLASS = """CASE WHEN {s} BETWEEN 800 AND 1000 THEN 'excelente' WHEN {s} BETWEEN 650 AND 799 THEN 'bueno'
            WHEN {s} BETWEEN 450 AND 649 THEN 'regular' WHEN {s} BETWEEN 250 AND 449 THEN 'riesgoso' ELSE 'critico' END"""


def scored(source: str, name: str) -> str:
    """CTE pair: points per dimension, then total and class."""
    points = ", ".join(f"{sql} AS score_{d}" for d, sql in _SCORES.items())
    total = " + ".join(f"score_{d}" for d in _SCORES)
    return (
        f"{name}_puntos AS (SELECT *, {points} FROM {source}), "
        f"{name}_total AS (SELECT *, {total} AS base_score FROM {name}_puntos), "
        f"{name} AS (SELECT *, {_CLASS.format(s='base_score')} AS base_class FROM {name}_total)"
    )


SCORED = scored("perfil", "puntaje")
# the fixed probability stands in for a model, so that decisions have one right answer
DECIDED = f"""
ajuste AS (
  SELECT *, CAST((id_cliente * 37) % 101 AS DOUBLE) / 100 AS p FROM puntaje),
ajustado AS (
  SELECT *, CASE WHEN p >= CAST(0.5 AS DOUBLE) THEN 'VIABLE' ELSE 'NO VIABLE' END AS etiqueta,
         CAST(trunc(GREATEST(LEAST(base_score + (p - CAST(0.5 AS DOUBLE)) * 200, 1000), 0)) AS INTEGER) AS total_score
  FROM ajuste),
clasificado AS (SELECT *, {_CLASS.format(s='total_score')} AS classification FROM ajustado),
decidido AS (
  SELECT *,
    CASE WHEN etiqueta = 'VIABLE' AND classification IN ('excelente', 'bueno') THEN 'approve'
         WHEN etiqueta = 'VIABLE' AND classification = 'regular' THEN 'conditions'
         WHEN etiqueta = 'NO VIABLE' AND classification IN ('excelente', 'bueno') THEN 'review'
         ELSE 'reject' END AS core_rule,
    CAST(1000 - total_score AS DOUBLE) / 1000 * CAST(0.6 AS DOUBLE) + (1 - p) * CAST(0.4 AS DOUBLE) AS riesgo
  FROM clasificado),
acciones AS (
  SELECT * FROM (VALUES
    ('approve', 0, 1, 'APROBAR CRÉDITO', 'success'), ('conditions', 0, 2, 'APROBAR CON CONDICIONES', 'warning'),
    ('conditions', 1, 3, 'REDUCIR MONTO', 'info'), ('review', 0, 2, 'REVISAR MANUALMENTE', 'warning'),
    ('reject', 0, 1, 'RECHAZAR CRÉDITO', 'danger'), ('reject', 1, 3, 'SOLICITAR GARANTÍA', 'info')
  ) AS t(core_rule, pos, priority, action, type)),
recomendado AS (
  SELECT d.id_cliente, a.pos, a.priority, a.action, a.type FROM decidido d JOIN acciones a ON a.core_rule = d.core_rule
  UNION ALL SELECT id_cliente, 2, 1, 'ALERTA DE MORA', 'danger' FROM decidido WHERE mora_diaria > 30
  UNION ALL SELECT id_cliente, 3, 2, 'ALERTA SOBRE-ENDEUDAMIENTO', 'danger' FROM decidido WHERE num_deudas >= 4
  UNION ALL SELECT id_cliente, 4, 1, 'DÉFICIT FINANCIERO', 'danger' FROM decidido WHERE excedente < 0
  UNION ALL SELECT id_cliente, 5, 2, 'BAJA CAPACIDAD DE PAGO', 'warning' FROM decidido WHERE capacidad_pago < 1
  UNION ALL SELECT id_cliente, 6, 4, 'REFINANCIAR DEUDAS', 'info' FROM decidido WHERE total_score < 450)"""

_DIMENSIONS = list(_SCORES)
_SHOWN = {
    "ingreso": (150, "15%"), "gastos": (100, "10%"), "deuda": (150, "15%"), "excedente": (120, "12%"),
    "capacidad": (100, "10%"), "num_deudas": (80, "8%"), "mora": (100, "10%"), "endeudamiento": (100, "10%"),
    "capital": (100, "10%"),
}
_STATS = [*FEATURE_LIST, "viable"]
_CUOTA = "(monto_solicitado * (tem * POW(1 + tem, {n})) / (POW(1 + tem, {n}) - 1))"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _r(expr: str, digits: int = 6) -> str:
    return f"ROUND({expr}, {digits})"


def _fixed(expr: str) -> str:
    """Two decimals as text, halves away from zero, as the decimal value reads."""
    number = f"ROUND(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)), 2)"
    return f"COALESCE(CASE WHEN {expr} < 0 AND {number} = 0 THEN '-' ELSE '' END || CAST(CAST({number} AS DECIMAL(20,2)) AS VARCHAR), 'nan')"


# dimension -> (text before the value, value, text after it, maximum)
_SENTENCES = {
    "ingreso": ("Ingreso mensual: S/", "ingreso_mensual", "", 150),
    "gastos": ("Ratio gastos/ingresos: ", "total_gastos / (ingreso_mensual + 1) * 100", "%", 100),
    "deuda": ("Ratio deuda/activos: ", "total_deudas / (total_activos + 1) * 100", "%", 150),
    "excedente": ("Excedente mensual: S/", "excedente", "", 120),
    "capacidad": ("Capacidad de pago: ", "capacidad_pago", "", 100),
    "num_deudas": ("Nro de deudas: ", "num_deudas", "", 80),
    "mora": ("Mora diaria: ", "mora_diaria", " días", 100),
    "endeudamiento": ("Endeudamiento patrimonial: ", "endeudamiento_patrimonial * 100", "%", 100),
    "capital": ("Capital de trabajo: S/", "capital_trabajo", "", 100),
    "carga": ("Carga financiera: ", "monto_solicitado / (ingreso_mensual * 12 + 1)", "x ingreso anual", 100),
}

# the applications, some of which break rules
APPLICATIONS = """sol AS (
  SELECT p.id_cliente, p.ingreso_mensual - 4000 AS ingreso_mensual, c.c_acctbal AS total_activos,
         p.tem * p.num_cuotas AS tem, p.num_cuotas * p.num_deudas AS num_cuotas
  FROM perfil p JOIN customer c ON c.c_custkey = p.id_cliente)"""

_LONG = (
    "largo AS (SELECT *, 6 + (id_cliente * 7) % 115 AS plazo FROM perfil), prestamo AS (SELECT *, "
    + _CUOTA.format(n="plazo")
    + " AS cuota FROM largo)"
)

CORE = {
    "nullify_non_finite": with_profile(
        "SELECT id_cliente, CASE WHEN num_deudas > 2 THEN capacidad_pago END AS capacidad_pago, excedente FROM perfil"
    ),
    "select_target": with_profile("SELECT id_cliente, CAST(viable AS DOUBLE) AS label FROM perfil"),
    "profiles_csv": f"WITH {SOURCES} {SNAPSHOT}",
    "multi_target_csv": with_profile(
        "SELECT perfil.*, "
        + ", ".join(f"CAST((id_cliente + {i}) % 2 AS INTEGER) AS {c}" for i, c in enumerate(MULTI_TARGETS))
        + " FROM perfil"
    ),
    "bom_stripped": with_profile("SELECT id_cliente, " + ", ".join(FEATURE_LIST) + " FROM perfil"),
    "applications_json": with_profile("SELECT id_cliente, " + ", ".join(FEATURE_LIST) + " FROM perfil"),
    "results_json": with_profile(
        """SELECT id_cliente, total_score, a.action AS final_decision
           FROM decidido JOIN acciones a USING (core_rule) WHERE a.pos = 0""",
        SCORED,
        DECIDED,
    ),
    "source_tables": f"""WITH {SOURCES}
SELECT 'clientes' AS table_name, COUNT(*) AS n FROM customer UNION ALL SELECT 'ingresos', COUNT(*) FROM ingresos
UNION ALL SELECT 'gastos', COUNT(*) FROM gastos UNION ALL SELECT 'patrimonio', COUNT(*) FROM patrimonio
UNION ALL SELECT 'deudas', COUNT(*) FROM deudas UNION ALL SELECT 'solicitudes_credito', COUNT(*) FROM solicitudes
UNION ALL SELECT 'evaluaciones', COUNT(*) FROM evaluaciones""",
    "score_explanations": with_profile(
        _union(
            f"SELECT id_cliente, {i} AS position, '{before}' || "
            + ("CAST(num_deudas AS VARCHAR)" if d == "num_deudas" else _fixed(value))
            + f" || '{after} -> ' || CAST(score_{d} AS VARCHAR) || '/{maximum} pts' AS sentence FROM puntaje"
            for i, (d, (before, value, after, maximum)) in enumerate(_SENTENCES.items())
        ),
        SCORED,
    ),
    "profile_joined": f"WITH {SOURCES} {JOINED}",
    "profile_snapshot": f"WITH {SOURCES} {SNAPSHOT}",
    "clean_impute": with_profile("SELECT * FROM limpio", IMPUTED),
    "serving_align": with_profile(
        "SELECT id_cliente, CAST(mora_diaria AS DOUBLE) AS mora_diaria, COALESCE(endeudamiento_patrimonial, 0) AS"
        " endeudamiento_patrimonial, COALESCE(capacidad_pago, 0) AS capacidad_pago, CAST(0 AS DOUBLE) AS no_such_feature,"
        " CAST(num_deudas AS DOUBLE) AS num_deudas FROM perfil"
    ),
    "validate_rejects": with_profile(
        """
SELECT id_cliente, reason FROM (
  SELECT id_cliente, 'ingreso_mensual must be > 0' AS reason FROM sol WHERE ingreso_mensual <= 0
  UNION ALL SELECT id_cliente, 'total_activos must be >= 0' FROM sol WHERE total_activos < 0
  UNION ALL SELECT id_cliente, 'tem must be <= 1' FROM sol WHERE tem > 1
  UNION ALL SELECT id_cliente, 'num_cuotas must be >= 1' FROM sol WHERE num_cuotas < 1
  UNION ALL SELECT id_cliente, 'num_cuotas must be <= 120' FROM sol WHERE num_cuotas > 120)""",
        APPLICATIONS,
    ),
    "derive_profile": with_profile(
        """
SELECT id_cliente, ROUND(tem, 6) AS tem, ROUND(cuota, 2) AS cuota_estimada,
       floor(total_gastos * CAST(0.65 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS total_costos,
       ingreso_mensual - total_gastos AS excedente,
       ROUND((ingreso_mensual - total_gastos) / GREATEST(cuota, 1), 4) AS capacidad_pago,
       CASE WHEN total_activos > 0 THEN ROUND(total_deudas / total_activos, 4) ELSE 0 END AS endeudamiento_patrimonial,
       total_activos - total_deudas AS capital_trabajo,
       floor(monto_solicitado * CAST(0.9 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS monto_propuesto, CAST(0 AS DOUBLE) AS mora_diaria
FROM formulario2""",
        """formulario AS (
  SELECT id_cliente, ingreso_mensual, total_gastos, total_activos, total_deudas, monto_solicitado, num_cuotas,
         GREATEST(LEAST(CAST(0.02 AS DOUBLE) + monto_solicitado / 50000 * CAST(0.03 AS DOUBLE), CAST(0.08 AS DOUBLE)), CAST(0.01 AS DOUBLE)) AS tem
  FROM perfil)""",
        "formulario2 AS (SELECT *, " + _CUOTA.format(n="num_cuotas") + " AS cuota FROM formulario)",
    ),
    "features_supervised": with_profile(SUPERVISED_SELECT, IMPUTED),
    "features_cluster": with_profile(
        """
SELECT id_cliente, total_gastos / (ingreso_mensual + 1) AS ratio_gastos_ingresos,
       total_deudas / (total_activos + 1) AS ratio_deuda_activos, excedente / (ingreso_mensual + 1) AS tasa_ahorro,
       total_deudas / (ingreso_mensual + 1) AS deuda_ingreso,
       monto_solicitado / (ingreso_mensual * num_cuotas + 1) AS estres_financiero
FROM ceros""",
        ZERO_FILLED,
    ),
    "score_details": with_profile(
        "SELECT id_cliente, " + ", ".join(f"score_{d}" for d in _DIMENSIONS) + " FROM puntaje", SCORED
    ),
    "score_total_class": with_profile(
        "SELECT id_cliente, base_score AS total_score, base_class AS classification, upper(base_class) AS category FROM puntaje",
        SCORED,
    ),
    "score_ml_adjust": with_profile(
        """SELECT id_cliente, total_score, classification, base_score AS total_score_original,
                  base_class AS classification_original, ROUND((p - CAST(0.5 AS DOUBLE)) * 200, 2) AS ml_adjustment,
                  ROUND(p, 4) AS ml_factor FROM clasificado""",
        SCORED,
        DECIDED,
    ),
    "score_breakdown": with_profile(
        _union(
            f"SELECT id_cliente, '{d}' AS dimension, score_{d} AS score, {m} AS max, '{w}' AS weight FROM puntaje"
            for d, (m, w) in _SHOWN.items()
        ),
        SCORED,
    ),
    "decision_core": with_profile(
        """SELECT id_cliente, core_rule, a.action AS final_decision, etiqueta = 'VIABLE' AS viable, total_score AS score,
                  classification FROM decidido JOIN acciones a USING (core_rule) WHERE a.pos = 0""",
        SCORED,
        DECIDED,
    ),
    "decision_alerts": with_profile(
        "SELECT action, COUNT(*) AS clientes FROM recomendado WHERE pos >= 2 GROUP BY 1", SCORED, DECIDED
    ),
    "decision_sorted": with_profile(
        """SELECT id_cliente, CAST(ROW_NUMBER() OVER (PARTITION BY id_cliente ORDER BY priority, pos) - 1 AS INTEGER) AS rank,
                  priority, action, type FROM recomendado""",
        SCORED,
        DECIDED,
    ),
    "decision_reasons": with_profile(
        """
SELECT id_cliente, kind, text FROM (
  SELECT id_cliente, 'reason' AS kind, CASE core_rule
           WHEN 'approve' THEN 'Alta capacidad de pago y buen historial crediticio.'
           WHEN 'conditions' THEN 'Perfil regular que requiere condiciones especiales.'
           WHEN 'review' THEN 'Posible inconsistencia en datos financieros reportados.'
           ELSE 'Alto nivel de endeudamiento y baja capacidad de pago.' END AS text FROM decidido
  UNION ALL SELECT id_cliente, 'observation', CASE core_rule
           WHEN 'approve' THEN 'Cliente con perfil de bajo riesgo recomendado para aprobación.'
           WHEN 'conditions' THEN 'Se recomienda ajustar cuotas para mejorar capacidad de pago.'
           WHEN 'review' THEN 'Verificar ingresos, deudas y documentación presentada.'
           ELSE 'Cliente con perfil de alto riesgo. Se recomienda rechazo.' END FROM decidido
  UNION ALL SELECT id_cliente, 'reason', 'Historial de morosidad elevado.' FROM decidido WHERE mora_diaria > 30
  UNION ALL SELECT id_cliente, 'reason', 'Múltiples obligaciones financieras activas.' FROM decidido WHERE num_deudas >= 4
  UNION ALL SELECT id_cliente, 'reason', 'Ingresos insuficientes para cubrir gastos mensuales.' FROM decidido WHERE excedente < 0)""",
        SCORED,
        DECIDED,
    ),
    "evaluation_report_kpis": with_profile(
        """
SELECT id_cliente, 'INF-20240101000000' AS report_id, v.position, v.label,
       CASE v.position WHEN 0 THEN CAST(total_score AS VARCHAR) WHEN 1 THEN upper(classification) WHEN 2 THEN etiqueta
            WHEN 3 THEN printf('%.1f%%', ROUND(GREATEST(p, 1 - p) * 100, 2))
            WHEN 4 THEN CASE WHEN riesgo < CAST(0.25 AS DOUBLE) THEN 'Bajo' WHEN riesgo < CAST(0.5 AS DOUBLE) THEN 'Moderado'
                             WHEN riesgo < CAST(0.75 AS DOUBLE) THEN 'Alto' ELSE 'Crítico' END
            ELSE a.action END AS value,
       CASE v.position WHEN 0 THEN 1000 END AS max
FROM decidido JOIN acciones a USING (core_rule)
     CROSS JOIN (VALUES """
        + ", ".join(f"({i}, '{label}')" for i, label in enumerate(REPORT_KPIS))
        + ") AS v(position, label) WHERE a.pos = 0",
        SCORED,
        DECIDED,
    ),
    "decision_risk": with_profile(
        """SELECT id_cliente, ROUND(riesgo, 6) AS risk_score, CASE WHEN riesgo < CAST(0.25 AS DOUBLE) THEN 'Bajo'
             WHEN riesgo < CAST(0.5 AS DOUBLE) THEN 'Moderado' WHEN riesgo < CAST(0.75 AS DOUBLE) THEN 'Alto'
             ELSE 'Crítico' END AS risk_level FROM decidido""",
        SCORED,
        DECIDED,
    ),
    "kpis": with_profile(
        """
SELECT total_clientes, viables, total_clientes - viables AS no_viables, tasa AS tasa_aprobacion,
       ROUND(100 - tasa, 2) AS riesgo_promedio, morosidad
FROM (SELECT COUNT(*) AS total_clientes, CAST(SUM(viable) AS BIGINT) AS viables,
             ROUND(CAST(SUM(viable) AS DOUBLE) / COUNT(*) * 100, 2) AS tasa,
             CASE WHEN AVG(mora_diaria) > 15 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS morosidad FROM perfil)"""
    ),
    "mean_profile_score": with_profile(
        "SELECT base_score AS score_promedio, base_class AS classification FROM medio",
        "promedio AS (SELECT " + ", ".join(f"AVG({c}) AS {c}" for c in FEATURE_LIST) + " FROM perfil)",
        scored("promedio", "medio"),
    ),
    "score_distribution": with_profile(
        """SELECT c.classification, COUNT(p.id_cliente) AS clientes
           FROM (VALUES ('excelente'), ('bueno'), ('regular'), ('riesgoso'), ('critico')) AS c(classification)
           LEFT JOIN puntaje p ON p.base_class = c.classification GROUP BY 1""",
        SCORED,
    ),
    "means_by_result": with_profile(
        """SELECT viable, ROUND(AVG(ingreso_mensual), 4) AS avg_income, ROUND(AVG(total_deudas), 4) AS avg_debt
           FROM perfil WHERE viable IS NOT NULL GROUP BY 1"""
    ),
    "target_distribution": with_profile(
        "SELECT viable, COUNT(*) AS n FROM perfil WHERE viable IS NOT NULL GROUP BY 1"
    ),
    "describe": with_profile(
        _union(
            f"SELECT '{c}' AS column_name, COUNT({c}) AS n, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std,"
            f" CAST(MIN({c}) AS DOUBLE) AS min, ROUND(quantile_cont({c}, 0.25), 7) AS q25,"
            f" ROUND(quantile_cont({c}, 0.5), 7) AS q50, ROUND(quantile_cont({c}, 0.75), 7) AS q75,"
            f" CAST(MAX({c}) AS DOUBLE) AS max FROM perfil"
            for c in _STATS
        )
    ),
    "correlations": with_profile(
        _union(f"SELECT '{c}' AS column_name, ROUND(corr({c}, viable), 6) AS correlation FROM perfil" for c in _STATS)
    ),
    "monthly_trend": with_profile(
        """SELECT CAST(date_trunc('month', fecha_evaluacion) AS DATE) AS month, COUNT(*) AS evaluations,
                  COUNT(CASE WHEN viable = 1 THEN 1 END) AS approvals FROM evaluaciones GROUP BY 1"""
    ),
    "risk_by_category": with_profile(
        """SELECT CASE WHEN riesgo < CAST(0.25 AS DOUBLE) THEN 'Bajo' WHEN riesgo < CAST(0.5 AS DOUBLE) THEN 'Moderado'
                       WHEN riesgo < CAST(0.75 AS DOUBLE) THEN 'Alto' ELSE 'Crítico' END AS risk_level,
                  COUNT(*) AS clientes FROM decidido GROUP BY 1""",
        SCORED,
        DECIDED,
    ),
    "loan_schedule": with_profile(
        """
SELECT id_cliente, CAST(k AS INTEGER) AS numero, ROUND(saldo, 5) AS saldo_inicial, ROUND(cuota - saldo * tem, 5) AS amortizacion,
       ROUND(saldo * tem, 5) AS interes, ROUND(cuota, 5) AS cuota_total,
       ROUND(GREATEST(saldo - (cuota - saldo * tem), 0), 5) AS saldo_final
FROM (SELECT *, monto_solicitado * POW(1 + tem, k - 1) - cuota * (POW(1 + tem, k - 1) - 1) / tem AS saldo
      FROM prestamo JOIN (SELECT range AS k FROM range(1, 61)) ON k <= num_cuotas)""",
        "prestamo AS (SELECT *, " + _CUOTA.format(n="num_cuotas") + " AS cuota FROM perfil)",
    ),
    "loan_cumulative": with_profile(
        """
SELECT id_cliente, ROUND(SUM(saldo * tem), 4) AS interes_acumulado, ROUND(SUM(cuota - saldo * tem), 4) AS amortizacion_acumulada
FROM (SELECT *, monto_solicitado * POW(1 + tem, k - 1) - cuota * (POW(1 + tem, k - 1) - 1) / tem AS saldo
      FROM prestamo JOIN (SELECT range AS k FROM range(1, 61)) ON k <= num_cuotas)
GROUP BY 1""",
        "prestamo AS (SELECT *, " + _CUOTA.format(n="num_cuotas") + " AS cuota FROM perfil)",
    ),
    "loan_schedule_long": with_profile(
        """
SELECT id_cliente, CAST(floor((k - 1) / 12) AS INTEGER) AS year, COUNT(*) AS n, ROUND(MAX(saldo), 3) AS first_balance,
       ROUND(MIN(GREATEST(saldo - (cuota - saldo * tem), 0)), 3) AS last_balance, ROUND(SUM(saldo * tem), 3) AS interest
FROM (SELECT *, monto_solicitado * POW(1 + tem, k - 1) - cuota * (POW(1 + tem, k - 1) - 1) / tem AS saldo
      FROM prestamo JOIN (SELECT range AS k FROM range(1, 121)) ON k <= plazo)
GROUP BY 1, 2""",
        _LONG,
    ),
    "loan_cumulative_long": with_profile(
        """
SELECT id_cliente, CAST(MAX(k) AS INTEGER) AS n, ROUND(SUM(saldo * tem), 3) AS interes_acumulado,
       ROUND(SUM(cuota - saldo * tem), 3) AS amortizacion_acumulada
FROM (SELECT *, monto_solicitado * POW(1 + tem, k - 1) - cuota * (POW(1 + tem, k - 1) - 1) / tem AS saldo
      FROM prestamo JOIN (SELECT range AS k FROM range(1, 121)) ON k <= plazo)
GROUP BY 1""",
        _LONG,
    ),
    "loan_defaults": with_profile(
        """SELECT id_cliente, CASE WHEN num_cuotas > 12 THEN CAST(monto_solicitado AS DOUBLE) ELSE 10000 END AS monto_solicitado,
                  CASE WHEN num_deudas > 0 THEN tem ELSE CAST(0.03 AS DOUBLE) END AS tem,
                  CASE WHEN num_cuotas > 24 THEN num_cuotas ELSE 12 END AS num_cuotas, CAST(500 AS DOUBLE) AS cuota_estimada
           FROM perfil"""
    ),
    "loan_summary": with_profile(
        """
SELECT id_cliente, monto_solicitado, tem, ROUND((POW(1 + tem, 12) - 1) * 100, 6) AS tea, num_cuotas,
       ROUND(cuota, 4) AS cuota_mensual, ROUND(cuota * num_cuotas - monto_solicitado, 4) AS total_intereses,
       ROUND(cuota * num_cuotas, 4) AS total_a_pagar,
       ROUND((cuota * num_cuotas - monto_solicitado) * 100 / monto_solicitado, 6) AS costo_total_credito
FROM prestamo""",
        "prestamo AS (SELECT *, " + _CUOTA.format(n="num_cuotas") + " AS cuota FROM perfil)",
    ),
    "loan_scenarios": with_profile(
        """
SELECT id_cliente, scenario, ingreso_mensual * up AS ingreso_estimado, total_gastos * down AS gastos_estimados,
       (ingreso_mensual * up - total_gastos * down) / (total_deudas * CAST(0.05 AS DOUBLE) + 1) AS capacidad_pago_estimada
FROM perfil CROSS JOIN (VALUES ('optimista', CAST(1.15 AS DOUBLE), CAST(0.95 AS DOUBLE)),
  ('realista', CAST(1.05 AS DOUBLE), CAST(1.03 AS DOUBLE)), ('pesimista', CAST(0.85 AS DOUBLE), CAST(1.15 AS DOUBLE))) AS s(scenario, up, down)"""
    ),
    "loan_arrears": with_profile(
        """
SELECT id_cliente, CAST(mes AS INTEGER) AS mes, dias_mora, ROUND(interes, 6) AS interes_mora, ROUND(penal, 6) AS penalidad,
       ROUND(interes + penal, 6) AS total_mora, ROUND(cuota_estimada + interes + penal, 6) AS deuda_total
FROM (SELECT *, cuota_estimada * (tem / 30) * dias_mora AS interes,
             CASE WHEN dias_mora > 30 THEN cuota_estimada * CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS penal
      FROM (SELECT *, mora_diaria + 30 * mes AS dias_mora FROM perfil CROSS JOIN (SELECT range AS mes FROM range(1, 13))))"""
    ),
    "loan_arrears_summary": with_profile(
        """
SELECT id_cliente, ROUND(AVG(dias_mora), 4) AS mora_promedio, ROUND(SUM(interes + penal), 4) AS costo_total_mora,
       ROUND(SUM(cuota_estimada + interes + penal), 4) AS deuda_total_acumulada
FROM (SELECT *, cuota_estimada * (tem / 30) * dias_mora AS interes,
             CASE WHEN dias_mora > 30 THEN cuota_estimada * CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS penal
      FROM (SELECT *, mora_diaria + 30 * mes AS dias_mora FROM perfil CROSS JOIN (SELECT range AS mes FROM range(1, 13))))
GROUP BY 1"""
    ),
    "loan_terms": with_profile(
        """
SELECT id_cliente, plazo, ROUND(cuota, 4) AS cuota_mensual, ROUND(cuota * plazo, 4) AS total_pagar,
       ROUND(cuota * plazo - monto_solicitado, 4) AS intereses,
       ROW_NUMBER() OVER (PARTITION BY id_cliente
         ORDER BY cuota + (cuota * plazo - monto_solicitado) * CAST(0.3 AS DOUBLE), plazo) = 1 AS recomendado
FROM (SELECT *, """
        + _CUOTA.format(n="plazo")
        + """ AS cuota FROM perfil CROSS JOIN (VALUES (6), (12), (18), (24), (36), (48)) AS t(plazo))"""
    ),
}
