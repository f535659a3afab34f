import pytest

from tapeloom.plans.catalog import CATALOG
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, sf, name):
    run, sql = CATALOG[name]
    if sql:
        compare(spark, sf, run, sql)
    else:
        assert run(spark, sf).count() > 0


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
