"""Every registered query against its DuckDB equivalent; those without one must give rows."""

import pytest

from forecourt.plans import registry
from tests.oracle import assert_equal

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    found = registry.QUERIES[name](spark, FOLDER)
    if name in registry.ORACLES:
        assert_equal(found, registry.ORACLES[name], FOLDER)
    else:
        assert found.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.ORACLES) <= set(entry.oracle_sql()) and set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["car_model", "score", "text_snippet"]


def test_top_k_needs_no_shuffle_and_prunes_columns(spark):
    plan = registry.QUERIES["vector_topk_filtered"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(label)" in plan and "Exchange" not in plan
