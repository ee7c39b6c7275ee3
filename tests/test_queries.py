"""Every registered query of the library against its SQL; those without SQL must run and give rows."""

import pytest

from sonolith import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf, duck, same):
    df = plans.QUERIES[name](spark, sf)
    if name in plans.SQL:
        same(df, duck, plans.SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
