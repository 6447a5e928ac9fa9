"""Pointers to what is current: small numbered records, each written after the data it names."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORD = "number long, version string, content string"


def history(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path``, none if there is no such folder."""
    try:
        return spark.read.schema(_RECORD).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _RECORD)


def latest(spark: SparkSession, path: str) -> tuple[int, str, dict] | None:
    """(number, version, content) of the newest record."""
    return _newest(history(spark, path))


def numbered(spark: SparkSession, path: str, number: int) -> tuple[int, str, dict] | None:
    """The record of that number."""
    return _newest(history(spark, path).where(F.col("number") == number))


def _newest(records: DataFrame) -> tuple[int, str, dict] | None:
    row = records.orderBy(F.desc("number"), F.desc("version")).first()
    return (row["number"], row["version"], json.loads(row["content"])) if row else None


def publish(spark: SparkSession, path: str, content: dict, version: str | None = None) -> int:
    """Appends a record and returns its number. One writer at a time; readers see the record before or this one."""
    newest = latest(spark, path)
    number = newest[0] + 1 if newest else 1
    row = (number, version or new_version(), json.dumps(content, sort_keys=True))
    spark.createDataFrame([row], _RECORD).coalesce(1).write.mode("append").parquet(path)
    return number


def new_version() -> str:
    return uuid.uuid4().hex
