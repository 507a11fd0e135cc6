"""Every query of the core runs; those with SQL give the same rows as DuckDB."""

import pytest
from compare import rows_of, sql_rows

from loamgraph.plans import registry

QUERIES, SQL = registry.collect("QUERIES"), registry.collect("SQL")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = rows_of(QUERIES[name](spark, data))
    if name in SQL:
        assert got == sql_rows(data, SQL[name])


def test_entry_names_all():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
