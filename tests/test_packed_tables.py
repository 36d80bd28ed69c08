"""Tables that are small in files and large in rows are not built on the driver."""

import pytest

from gridloom import catalog
from gridloom.plans import fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["radius_count", "shape_features"])
def test_no_broadcast_by_file_size(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line and "p_partkey" not in line]
    assert joins and any("strategy=merge" in line for line in joins)


def test_lookup_of_many_rows_is_not_broadcast(spark, monkeypatch):
    plan = lambda: fixtures.fixture(spark, SF, "px")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(fixtures, "LOOKUP_ROWS", 10)
    assert "Broadcast" not in plan()


def test_features_are_joined_by_key(spark):
    plan = catalog.queries()["candidate_features"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins)
