"""Explicit schemas, so that no reader has to infer one."""

from pyspark.sql import types as T

from credilake.constants import FEATURES, KEY, LOAN_DEFAULTS, MULTI_TARGETS, TARGET

_INT_FEATURES = {"num_deudas", "num_cuotas"}


def _feature_fields() -> list[T.StructField]:
    return [T.StructField(c, T.IntegerType() if c in _INT_FEATURES else T.DoubleType()) for c in FEATURES]


APPLICATION_SCHEMA = T.StructType([T.StructField(KEY, T.LongType()), *_feature_fields()])
PROFILE_SCHEMA = T.StructType([*APPLICATION_SCHEMA.fields, T.StructField(TARGET, T.IntegerType())])
MULTI_TARGET_SCHEMA = T.StructType(
    [*PROFILE_SCHEMA.fields, *[T.StructField(c, T.IntegerType()) for c in MULTI_TARGETS]]
)
LOAN_SCHEMA = T.StructType(
    [
        T.StructField(KEY, T.LongType()),
        *[
            T.StructField(c, T.IntegerType() if c in _INT_FEATURES else T.DoubleType())
            for c in LOAN_DEFAULTS
        ],
    ]
)
FORM_SCHEMA = T.StructType(
    [
        T.StructField(KEY, T.LongType()),
        T.StructField("ingreso_mensual", T.DoubleType()),
        T.StructField("total_gastos", T.DoubleType()),
        T.StructField("total_activos", T.DoubleType()),
        T.StructField("total_deudas", T.DoubleType()),
        T.StructField("num_deudas", T.IntegerType()),
        T.StructField("monto_solicitado", T.DoubleType()),
        T.StructField("num_cuotas", T.IntegerType()),
    ]
)
EVALUATION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *_feature_fields(),
        T.StructField("prediction_label", T.StringType()),
        T.StructField("confidence_frac", T.DoubleType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("total_score", T.IntegerType()),
        T.StructField("classification", T.StringType()),
        T.StructField("final_decision", T.StringType()),
        T.StructField("true_label", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
LABEL_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("true_label", T.IntegerType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("event_id", T.LongType()),
    ]
)

_MONEY = T.DecimalType(12, 2)
_WIDE_MONEY = T.DecimalType(14, 2)

SOURCE_SCHEMAS = {
    "clientes": T.StructType(
        [
            T.StructField("id_cliente", T.LongType(), False),
            T.StructField("nombre", T.StringType()),
            T.StructField("documento_identidad", T.StringType()),
            T.StructField("fecha_registro", T.TimestampNTZType()),
        ]
    ),
    "ingresos": T.StructType(
        [
            T.StructField("id_ingreso", T.LongType()),
            T.StructField("id_cliente", T.LongType(), False),
            T.StructField("ingreso_mensual", _MONEY),
            T.StructField("mes_referencia", T.DateType()),
        ]
    ),
    "gastos": T.StructType(
        [
            T.StructField("id_gasto", T.LongType()),
            T.StructField("id_cliente", T.LongType(), False),
            T.StructField("total_gastos", _MONEY),
            T.StructField("total_costos", _MONEY),
            T.StructField("mes_referencia", T.DateType()),
        ]
    ),
    "patrimonio": T.StructType(
        [
            T.StructField("id_patrimonio", T.LongType()),
            T.StructField("id_cliente", T.LongType(), False),
            T.StructField("total_activos", _WIDE_MONEY),
            T.StructField("total_deudas", _WIDE_MONEY),
            T.StructField("capital_trabajo", _WIDE_MONEY),
            T.StructField("endeudamiento_patrimonial", T.DecimalType(18, 2)),  # debts over a cent of assets
            T.StructField("fecha_consulta", T.DateType()),
        ]
    ),
    "deudas": T.StructType(
        [
            T.StructField("id_deuda", T.LongType()),
            T.StructField("id_cliente", T.LongType(), False),
            T.StructField("entidad", T.StringType()),
            T.StructField("monto", _MONEY),
            T.StructField("saldo_pendiente", _MONEY),
            T.StructField("mora_diaria", T.IntegerType()),
            T.StructField("fecha_inicio", T.DateType()),
        ]
    ),
    "solicitudes_credito": T.StructType(
        [
            T.StructField("id_solicitud", T.LongType()),
            T.StructField("id_cliente", T.LongType(), False),
            T.StructField("monto_solicitado", _MONEY),
            T.StructField("tem", T.DecimalType(6, 4)),
            T.StructField("num_cuotas", T.IntegerType()),
            T.StructField("cuota_estimada", T.DecimalType(10, 2)),
            T.StructField("monto_propuesto", _MONEY),
            T.StructField("fecha_solicitud", T.TimestampNTZType()),
        ]
    ),
    "evaluaciones": T.StructType(
        [
            T.StructField("id_evaluacion", T.LongType()),
            T.StructField("id_cliente", T.LongType(), False),
            T.StructField("viable", T.BooleanType()),
            T.StructField("score_total", T.IntegerType()),
            T.StructField("clasificacion", T.StringType()),
            T.StructField("probabilidad_ia", T.DecimalType(6, 4)),
            T.StructField("modelo_utilizado", T.StringType()),
            T.StructField("fecha_evaluacion", T.TimestampNTZType()),
        ]
    ),
}
