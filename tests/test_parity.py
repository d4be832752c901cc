"""Every query of the engine against its SQL, on the same tables."""

import pytest
from conftest import rows_of

from rfrank import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0 and "rank" in frame.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
