"""Names, bounds, points and texts that results depend on.

Everything in this module is a fixed value. Change one and scores, labels or
texts change with it.
"""

# Base features of a client profile, in column order.
FEATURES = [
    "ingreso_mensual",
    "total_gastos",
    "total_costos",
    "total_activos",
    "total_deudas",
    "num_deudas",
    "excedente",
    "capacidad_pago",
    "endeudamiento_patrimonial",
    "capital_trabajo",
    "monto_solicitado",
    "tem",
    "num_cuotas",
    "cuota_estimada",
    "monto_propuesto",
    "mora_diaria",
]
KEY = "id_cliente"
TARGET = "viable"
MULTI_TARGETS = ["resultado_aprobado", "resultado_rechazado", "resultado_riesgo_medio"]

# Score bands per dimension: (comparison, bound, points) tried in order, then the points left over.
SCORE_BANDS = {
    "ingreso": ([("<=", 0, 0), ("<", 5000, 30), ("<", 15000, 60), ("<", 30000, 100), ("<", 50000, 130)], 150),
    "gastos": ([("<=", 0.3, 100), ("<=", 0.5, 75), ("<=", 0.7, 50), ("<=", 0.9, 25)], 10),
    "deuda": ([("<=", 0.2, 150), ("<=", 0.4, 120), ("<=", 0.6, 80), ("<=", 0.8, 40)], 15),
    "excedente": ([("<=", 0, 0), ("<", 1000, 30), ("<", 3000, 60), ("<", 8000, 90)], 120),
    "capacidad": ([("<=", 0, 0), ("<", 1, 25), ("<", 2, 50), ("<", 5, 75)], 100),
    "num_deudas": ([("==", 0, 80), ("<=", 1, 70), ("<=", 2, 50), ("<=", 3, 30)], 10),
    "mora": ([("<=", 0, 100), ("<", 5, 80), ("<", 15, 60), ("<", 30, 40), ("<", 50, 20)], 5),
    "endeudamiento": ([("<=", 0, 100), ("<", 0.3, 90), ("<", 0.5, 70), ("<", 0.7, 50), ("<", 1.0, 30)], 10),
    "capital": ([(">", 50000, 100), (">", 20000, 80), (">", 0, 60), (">", -20000, 30)], 10),
    "carga": ([("<=", 0.5, 100), ("<=", 1.0, 80), ("<=", 2.0, 50), ("<=", 3.0, 25)], 5),
}

# Dimensions shown in the breakdown with their maximum and weight ("carga" is scored, not shown).
BREAKDOWN = {
    "ingreso": (150, "15%"),
    "gastos": (100, "10%"),
    "deuda": (150, "15%"),
    "excedente": (120, "12%"),
    "capacidad": (100, "10%"),
    "num_deudas": (80, "8%"),
    "mora": (100, "10%"),
    "endeudamiento": (100, "10%"),
    "capital": (100, "10%"),
}
MAX_SCORE = 1000

# Class label -> inclusive score range; scores outside every range are "critico".
CLASS_RANGES = {
    "excelente": (800, 1000),
    "bueno": (650, 799),
    "regular": (450, 649),
    "riesgoso": (250, 449),
    "critico": (0, 249),
}

# Risk level -> upper bound (exclusive) of the combined risk; beyond the last: RISK_TOP.
RISK_LEVELS = [("Bajo", 0.25), ("Moderado", 0.5), ("Alto", 0.75)]
RISK_TOP = "Crítico"

# Recommendations: key -> (priority, action, type, description).
ACTIONS = {
    "approve": (1, "APROBAR CRÉDITO", "success", "El cliente cumple con todos los requisitos financieros."),
    "conditions": (
        2,
        "APROBAR CON CONDICIONES",
        "warning",
        "Aprobar con monto reducido o garantía adicional.",
    ),
    "reduce": (3, "REDUCIR MONTO", "info", "Sugerir un monto menor al solicitado para mitigar riesgo."),
    "review": (
        2,
        "REVISAR MANUALMENTE",
        "warning",
        "Discrepancia entre score y predicción IA. Revisar manualmente.",
    ),
    "reject": (
        1,
        "RECHAZAR CRÉDITO",
        "danger",
        "El cliente no cumple con los requisitos mínimos de riesgo.",
    ),
    "guarantee": (
        3,
        "SOLICITAR GARANTÍA",
        "info",
        "Si se considera aprobar, requerir garantía real o aval solidario.",
    ),
    "arrears": (
        1,
        "ALERTA DE MORA",
        "danger",
        "Cliente presenta %.0f días de mora. Alto riesgo de incumplimiento.",
    ),
    "overdebt": (
        2,
        "ALERTA SOBRE-ENDEUDAMIENTO",
        "danger",
        "Cliente tiene %s deudas activas. Riesgo de sobreendeudamiento.",
    ),
    "deficit": (
        1,
        "DÉFICIT FINANCIERO",
        "danger",
        "Cliente tiene déficit mensual. No recomendable para crédito.",
    ),
    "low_capacity": (
        2,
        "BAJA CAPACIDAD DE PAGO",
        "warning",
        "Capacidad de pago de %.2f. Umbral mínimo es 1.0.",
    ),
    "refinance": (
        4,
        "REFINANCIAR DEUDAS",
        "info",
        "Sugerir refinanciamiento de deudas existentes antes de nuevo crédito.",
    ),
}
REASONS = {
    "approve": "Alta capacidad de pago y buen historial crediticio.",
    "conditions": "Perfil regular que requiere condiciones especiales.",
    "review": "Posible inconsistencia en datos financieros reportados.",
    "reject": "Alto nivel de endeudamiento y baja capacidad de pago.",
    "arrears": "Historial de morosidad elevado.",
    "overdebt": "Múltiples obligaciones financieras activas.",
    "deficit": "Ingresos insuficientes para cubrir gastos mensuales.",
}
OBSERVATIONS = {
    "approve": "Cliente con perfil de bajo riesgo recomendado para aprobación.",
    "conditions": "Se recomienda ajustar cuotas para mejorar capacidad de pago.",
    "review": "Verificar ingresos, deudas y documentación presentada.",
    "reject": "Cliente con perfil de alto riesgo. Se recomienda rechazo.",
}

# Stress scenarios: name -> (income factor, expense factor, description).
SCENARIOS = {
    "optimista": (1.15, 0.95, "Crecimiento de ingresos del 15% y reducción de gastos del 5%"),
    "realista": (1.05, 1.03, "Crecimiento de ingresos del 5% e incremento de gastos del 3%"),
    "pesimista": (0.85, 1.15, "Reducción de ingresos del 15% e incremento de gastos del 15%"),
}
TERMS = [6, 12, 18, 24, 36, 48]
ARREARS_MONTHS = 12

# Loan request defaults.
LOAN_DEFAULTS = {
    "monto_solicitado": 10000.0,
    "tem": 0.03,
    "num_cuotas": 12,
    "cuota_estimada": 500.0,
    "ingreso_mensual": 5000.0,
    "total_gastos": 3000.0,
    "total_deudas": 10000.0,
    "mora_diaria": 0.0,
}

# Title and labels of an evaluation report.
REPORT_TITLE = "Informe de Evaluación Crediticia"
REPORT_KPIS = ["Score Financiero", "Clasificación", "Predicción IA", "Confianza", "Riesgo", "Decisión Final"]
