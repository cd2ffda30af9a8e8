"""Every registered core query against its SQL; those without SQL must give rows of the same kind every time."""

import pytest

from grovework.plans import all_queries, all_sql

NAMES = sorted(all_queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(name, same, spark, sf):
    sql = all_sql().get(name)
    if sql:
        same(all_queries()[name], sql)
    else:
        one, two = (sorted(map(str, all_queries()[name](spark, sf).collect())) for _ in range(2))
        assert one and one == two


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())
