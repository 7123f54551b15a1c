"""Every query of the core that has SQL gives the rows of that SQL."""

from __future__ import annotations

import pytest

from corpusloom.plans import catalogue
from tests.compare import DATA, connection, rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLES:
        want = connection().execute(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
