import os

import pytest

from quarry.llm.queries import ORACLE_SQL, QUERIES

from ..against_sql import DATA, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query_gives_the_rows_of_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL and not n.startswith("op9")])
def test_other_queries_cover_their_table(spark, name):
    table = "pages" if name.startswith("op4") else "documents"
    assert QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
