"""What the plans must look like, whatever the data."""

import re
from pathlib import Path

import pytest
from conftest import DATA, ROOT

from credilake.plans import catalog_core
from credilake.sources import order_tables

SOURCES = sorted((ROOT / "credilake").rglob("*.py"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalog_core.QUERIES])
def test_core_queries_stay_in_the_jvm(spark, name):
    plan = _plan(catalog_core.QUERIES[name](spark, DATA))
    assert not re.search(r"Python|ArrowEval|CartesianProduct", plan)


def test_scoring_adds_no_shuffle(spark, profile):
    plan = _plan(catalog_core.decided(profile))
    assert "Exchange" not in plan and "Join" not in plan


def test_terms_and_schedules_add_no_shuffle(spark):
    for name in ("loan_schedule", "loan_terms", "loan_scenarios", "loan_arrears"):
        assert "Exchange" not in _plan(catalog_core.QUERIES[name](spark, DATA))


def test_scans_read_only_what_is_used(spark):
    plan = _plan(catalog_core.QUERIES["kpis"](spark, DATA))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"mora_diaria", "viable"}


def test_filters_reach_the_scan(spark, profile):
    assert re.search(r"PushedFilters: \[[^\]]*num_deudas", _plan(profile.where("num_deudas > 3")))


def test_lines_are_summed_before_they_travel(spark):
    plan = _plan(catalog_core.lazy_snapshot(spark, DATA))
    assert "partial_sum" in plan and "CartesianProduct" not in plan


def test_sums_travel_as_whole_numbers(spark):
    plan = _plan(order_tables.monthly_totals(spark, DATA))
    partial = [part for line in plan.split("\n") if "partial_sum" in line for part in line.split("partial_sum(")[1:]]
    assert len(partial) == 5 and "isEmpty" not in plan  # what a sum of wide decimals adds to each of its values


def test_months_and_assets_are_written_once(tables):
    months = {f for name in ("ingresos", "gastos") for f in tables[name].inputFiles()}
    assert months == set(tables["ingresos"].inputFiles())


@pytest.mark.parametrize("path", SOURCES, ids=lambda p: str(Path(p).relative_to(ROOT)))
def test_banned_calls(path):
    text = path.read_text(encoding="utf-8")
    assert not re.search(r"localCheckpoint|toPandas\(|crossJoin|\.rdd\b|F\.udf\(", text)
    # what is sent to every task has a bound that is stated next to it
    lines = text.replace("sparkContext.broadcast(", "").split("\n")
    for at, line in enumerate(lines):
        if "broadcast(" in line:
            assert re.search(r"(one|a) row per|at most|one number per|<= SENT_", "\n".join(lines[max(0, at - 15) : at + 1])), line
