"""File readers and result writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credilake.functions.scoring import breakdown
from credilake.schemas import APPLICATION_SCHEMA, MULTI_TARGET_SCHEMA, PROFILE_SCHEMA

CORRUPT = "_corrupt_record"


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # enforceSchema=False matches fields by header, so a file without some column or in another order still
    # reads right; the header itself may start with a byte-order mark
    header = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = {c.replace("\ufeff", ""): c for c in header.columns}
    return header.select(
        *[F.col(f"`{names[f.name]}`").try_cast(f.dataType).alias(f.name) for f in schema.fields if f.name in names]
    )


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Client profiles from Parquet, or from CSV with a header (a UTF-8 byte-order mark is tolerated)."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return _read_csv(spark, path, PROFILE_SCHEMA)


def read_multi_target(spark: SparkSession, path: str) -> DataFrame:
    """Profiles with the three ``resultado_*`` targets."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return _read_csv(spark, path, MULTI_TARGET_SCHEMA)


def read_applications_json(spark: SparkSession, path: str) -> DataFrame:
    """Application records, one JSON object per line; a malformed line survives in ``_corrupt_record``."""
    schema = T.StructType([*APPLICATION_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def result_json(df: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """One JSON text per client: prediction, scoring and recommendations nested as the service answers."""
    stamp = F.current_timestamp() if generated_at is None else generated_at
    return df.select(
        "id_cliente",
        F.to_json(
            F.struct(
                F.col("id_cliente").alias("client_id"),
                F.struct(
                    "prediction",
                    "probability",
                    F.col("prediction_label").alias("label"),
                    "confidence",
                    "model_used",
                ).alias("prediction"),
                F.struct(
                    "total_score",
                    F.lit(1000).alias("max_score"),
                    "classification",
                    "category",
                    "total_score_original",
                    "classification_original",
                    "ml_adjustment",
                    "ml_factor",
                    breakdown().alias("breakdown"),
                ).alias("scoring"),
                F.struct(
                    F.transform(
                        "recommendations", lambda r: r.dropFields("position")
                    ).alias("recommendations"),
                    "decision_summary",
                    "reasons",
                    "observations",
                    "risk_level",
                    "final_decision",
                ).alias("recommendations"),
                stamp.alias("timestamp"),
            )
        ).alias("value"),
    )


def write_results_json(df: DataFrame, path: str, generated_at: Column | None = None) -> None:
    """Writes one JSON line per client."""
    result_json(df, generated_at).select("value").write.text(path)
