"""Driver contract and the SQL oracle at sf0.001 for every query that has one."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, type_diffs

from conftest import SF_SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"purchase_probability", "intervene", "confidence"} <= set(df.columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck_small, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    rel = duck_small.sql(SQL[name])
    assert not type_diffs(sdf.schema, rel), f"{name}: {type_diffs(sdf.schema, rel)}"
    status, msg = compare(sdf.toPandas(), rel.fetchdf())
    assert status in ("exact", "close"), f"{name}: {status} {msg}"
