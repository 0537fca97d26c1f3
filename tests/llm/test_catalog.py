"""The registered queries against their SQL."""

from collections import Counter

import duckdb
import pytest

from quarry.llm.catalog import QUERIES
from quarry.llm.oracle import ORACLE_SQL
from tests.conftest import SF001


def test_thirteen_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF001)
    assert set(got.columns) == set(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
