"""Small hand-made inputs shared by the tests."""

from credilake.constants import FEATURES
from credilake.schemas import APPLICATION_SCHEMA, PROFILE_SCHEMA

# Their scores are 910 and 690.
SAMPLE = dict(zip(FEATURES, (15000, 5000, 2000, 100000, 20000, 2, 3000, 3.5, 0.2, 30000, 15000, 0.03, 12, 1500, 15000, 0)))
NEAR_ZERO = dict.fromkeys(FEATURES, 0) | {"ingreso_mensual": 0.01, "num_cuotas": 1}
def _typed(values: dict, schema) -> tuple:
    return tuple(
        None if values[f.name] is None else (int if f.dataType.typeName() in ("integer", "long") else float)(values[f.name])
        for f in schema.fields
    )


def applications(spark, *rows: dict):
    """Application rows; keys count from 1 unless given."""
    typed = [_typed({"id_cliente": i, **r}, APPLICATION_SCHEMA) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(typed, APPLICATION_SCHEMA)


def training_rows(spark, n: int = 10):
    """Made from the row number: viable clients earn more than they spend."""
    rows = []
    for i in range(1, n + 1):
        viable = int(i % 5 not in (0, 2))
        income, costs = 3000 + 700 * i, (3000 + 700 * i) * (2 + i % 3) // (10 if viable else 4)
        values = dict(zip(FEATURES, (income, costs, costs // 3, 9000 * i, 2500 * (11 - i), i % 4, income - costs)))
        values |= {c: round((k * i % 17 + 1) / (k + 2), 3) for k, c in enumerate(FEATURES[7:])}
        values |= {"num_cuotas": 6 + 2 * i, "tem": round(0.01 + i / 300, 4)}
        rows.append(_typed({"id_cliente": i, **values, "viable": viable}, PROFILE_SCHEMA))
    return spark.createDataFrame(rows, PROFILE_SCHEMA)
