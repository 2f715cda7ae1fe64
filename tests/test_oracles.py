"""Every registered query against DuckDB, and those without SQL for their rows."""

import pytest
from tests.conftest import SF, same_rows

from loomtext.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    found = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        same_rows(found, duck.sql(registry.ORACLES[name]))
    else:
        assert found.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
