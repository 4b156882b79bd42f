"""Training-data queries that SQL can express, against their SQL."""

import pytest

from harrow.llm import queries

from .. import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = oracle.connect(oracle.DATA)
    assert not oracle.difference(queries.QUERIES[name](spark, str(oracle.DATA)), db, queries.ORACLE_SQL[name])
