"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credilake.constants import KEY
from credilake.plans import catalog_core, catalog_learn, catalog_space, oracle_core, oracle_learn, oracle_space

QUERIES = {**catalog_core.QUERIES, **catalog_space.QUERIES, **catalog_learn.QUERIES}
ORACLE = {**oracle_core.CORE, **oracle_space.SPACE, **oracle_learn.LEARN}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan -> profile -> score -> adjust -> recommend, as one lazy plan."""
    return catalog_core.decided(catalog_core.lazy_snapshot(spark, sf_dir)).select(
        KEY, "total_score", "classification", "risk_level", "final_decision"
    )
