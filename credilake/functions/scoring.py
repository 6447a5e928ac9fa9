"""Rule scoring as projections: every band is a CASE, so a whole portfolio is one codegen stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credilake.constants import BREAKDOWN, CLASS_RANGES, MAX_SCORE, SCORE_BANDS
from credilake.functions.arithmetic import clamp, num

_COMPARE = {
    "<=": lambda c, b: c <= b,
    "<": lambda c, b: c < b,
    "==": lambda c, b: c == b,
    ">": lambda c, b: c > b,
}


def dimension_values() -> dict[str, Column]:
    """The measured value behind each scored dimension."""
    income = F.col("ingreso_mensual")
    return {
        "ingreso": income,
        "gastos": F.try_divide(F.col("total_gastos"), income + num(1)),
        "deuda": F.try_divide(F.col("total_deudas"), F.col("total_activos") + num(1)),
        "excedente": F.col("excedente"),
        "capacidad": F.col("capacidad_pago"),
        "num_deudas": F.col("num_deudas"),
        "mora": F.col("mora_diaria"),
        "endeudamiento": F.col("endeudamiento_patrimonial"),
        "capital": F.col("capital_trabajo"),
        "carga": F.try_divide(F.col("monto_solicitado"), income * num(12) + num(1)),
    }


def band_points(dimension: str, value: Column) -> Column:
    """Points of ``value``; NULL fails every comparison and so takes the points left over."""
    bands, rest = SCORE_BANDS[dimension]
    chain = None
    for op, bound, points in bands:
        test = _COMPARE[op](value, num(bound))
        chain = F.when(test, points) if chain is None else chain.when(test, points)
    return chain.otherwise(rest)


def score_dimensions(df: DataFrame) -> DataFrame:
    """Adds one ``score_<dimension>`` column per dimension."""
    return df.withColumns({f"score_{d}": band_points(d, v) for d, v in dimension_values().items()})


def total_score() -> Column:
    """Sum of the ten dimensions. It can reach 1100 although the scale is called 1000."""
    total = F.lit(0)
    for d in SCORE_BANDS:
        total = total + F.col(f"score_{d}")
    return total.cast("int")


def classify(score: Column, strict_ranges: bool = True) -> Column:
    """Class label. Under ``strict_ranges`` a score outside every range, even above 1000, is "critico"."""
    if not strict_ranges:
        score = F.least(F.greatest(score, F.lit(0)), F.lit(MAX_SCORE))
    chain = None
    for label, (low, high) in CLASS_RANGES.items():
        test = score.between(low, high)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise("critico")


def score(df: DataFrame, strict_ranges: bool = True) -> DataFrame:
    """Adds the dimension scores, ``total_score``, ``classification`` and ``category``."""
    return (
        score_dimensions(df)
        .withColumn("total_score", total_score())
        .withColumn("classification", classify(F.col("total_score"), strict_ranges))
        .withColumn("category", F.upper("classification"))
    )


def adjust_with_probability(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Moves the total by (p - 0.5) * 200 within 0..1000, keeping the originals; adjustment and factor are rounded to 2 and 4
    decimals for display, the total is not.

    ``category`` keeps the class from before the adjustment.
    """
    p = F.col(probability)
    factor = (p - num(0.5)) * num(200)
    adjusted = clamp(F.col("total_score") + factor, 0, MAX_SCORE).cast("int")
    return (
        df.withColumns(
            {
                "total_score_original": F.col("total_score"),
                "classification_original": F.col("classification"),
                "ml_adjustment": F.round(factor, 2),
                "ml_factor": F.round(p, 4),
                "total_score": adjusted,
            }
        ).withColumn("classification", classify(F.col("total_score")))
    )


def breakdown() -> Column:
    """Map dimension -> (score, max, weight) over the nine dimensions that are shown."""
    entries = []
    for d, (maximum, weight) in BREAKDOWN.items():
        entries += [
            F.lit(d),
            F.struct(
                F.col(f"score_{d}").alias("score"), F.lit(maximum).alias("max"), F.lit(weight).alias("weight")
            ),
        ]
    return F.create_map(*entries)


# Fixed sentences: dimension -> (text before the value, number format, text after it, maximum).
_SENTENCES = {
    "ingreso": ("Ingreso mensual: S/", "%.2f", "", 150),
    "gastos": ("Ratio gastos/ingresos: ", "%.2f", "%", 100),
    "deuda": ("Ratio deuda/activos: ", "%.2f", "%", 150),
    "excedente": ("Excedente mensual: S/", "%.2f", "", 120),
    "capacidad": ("Capacidad de pago: ", "%.2f", "", 100),
    "num_deudas": ("Nro de deudas: ", "%.0f", "", 80),
    "mora": ("Mora diaria: ", "%.2f", " días", 100),
    "endeudamiento": ("Endeudamiento patrimonial: ", "%.2f", "%", 100),
    "capital": ("Capital de trabajo: S/", "%.2f", "", 100),
    "carga": ("Carga financiera: ", "%.2f", "x ingreso anual", 100),
}


def explanations() -> Column:
    """The ten sentences that explain a score; a missing value reads "nan".

    Kept out of ``score`` as it is costly to generate.
    """
    sentences = []
    for d, value in dimension_values().items():
        before, number, after, maximum = _SENTENCES[d]
        shown = value.cast("double") * num(100) if after == "%" else value.cast("double")
        text = F.when(shown.isNull(), "nan").otherwise(F.format_string(number, shown))
        points = F.col(f"score_{d}").cast("string")
        sentences.append(F.concat(F.lit(before), text, F.lit(f"{after} -> "), points, F.lit(f"/{maximum} pts")))
    return F.array(*sentences)
