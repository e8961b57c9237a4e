"""Registered queries of the numbered operators against their SQL on the smallest tables."""

import pytest

from peeratlas.llm import queries

from ..test_queries import DIR, plain, pytestmark, tables  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):  # noqa: F811
    found = queries.QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    result = tables.execute(queries.ORACLE_SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    expected = [tuple(row[order.index(c)] for c in columns) for row in result.fetchall()]
    assert plain(tuple(r) for r in found.select(*columns).collect()) == plain(expected) and expected
