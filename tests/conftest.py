import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from credilake.session import build_session

    session = build_session(
        "tests", "local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="8g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def profile(spark):
    from credilake.plans.catalog_core import snapshot

    return snapshot(spark, DATA)


@pytest.fixture(scope="session")
def tables(spark):
    from credilake.plans.catalog_core import loaded

    return loaded(spark, DATA)
