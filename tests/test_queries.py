"""Every bound query against its SQL on the shared tables."""

import pytest
from oracle import compare, connect

from daymart.bindings import all_bindings


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(all_bindings()))
def test_query_equals_sql(spark, duck, folder, name):
    rows, message = compare(spark, duck, name, all_bindings()[name], folder)
    assert message == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["inc_day", "order_count", "customer_count", "gmv", "avg_order_amount"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
