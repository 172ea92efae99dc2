"""Every query of the catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from compare import rows_of
from oathmill.plans import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = duck.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
