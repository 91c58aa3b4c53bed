import os

import pytest

from quarry.oracles import ORACLE_SQL
from quarry.queries import QUERIES

from .against_sql import DATA, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qname", "kind", "pkg_path", "file", "line", "tier"]
    assert set(e.oracle_sql()) <= set(e.queries())
