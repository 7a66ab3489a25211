import pytest
from oracle import duck, same

from tidemark.plans import registry

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_duckdb(spark, name):
    same(registry.QUERIES[name](spark, ROOT).toPandas(), duck(ROOT).sql(registry.ORACLES[name]).df())


def test_entry_and_registries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).take(1)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["region_revenue"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" in plan[plan.index("PushedFilters") :]
    assert "l_tax" not in plan and "l_quantity" not in plan and "l_extendedprice" in plan


def test_range_operators_sweep_and_do_not_join(spark):
    for name in ("clipped", "trimmed", "snapped", "last_click"):
        plan = registry.QUERIES[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "Join" not in plan, name
