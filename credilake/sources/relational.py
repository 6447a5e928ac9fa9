"""The seven relational source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credilake.schemas import SOURCE_SCHEMAS


def read_source_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """One Parquet folder per table, read with its declared schema."""
    return {
        name: spark.read.schema(schema).parquet(f"{directory.rstrip('/')}/{name}")
        for name, schema in SOURCE_SCHEMAS.items()
    }


def write_source_tables(tables: dict[str, DataFrame], directory: str) -> None:
    """Writes the tables with their declared column types."""
    for name, schema in SOURCE_SCHEMAS.items():
        df = tables[name]
        columns = [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
        df.select(*columns).write.mode("errorifexists").parquet(f"{directory.rstrip('/')}/{name}")


def register_views(tables: dict[str, DataFrame]) -> None:
    """Makes the tables available to ``spark.sql`` under their own names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
