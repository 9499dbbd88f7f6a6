"""Every query with SQL gives the rows of its SQL on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ringwatch.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    return f"{float(value):.4f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    result = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    expected = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[c]) for c in columns) for r in expected)


def test_queries_without_sql_are_few():
    """tie_sessions is held to a plain fold in test_sessions."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"tie_sessions"} and set(ORACLE_SQL) <= set(QUERIES)


def same_as_sql(spark, name, folder, views):
    """A query over tables of its own gives the rows of its SQL."""
    own = duckdb.connect()
    for t in views:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = own.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    got = sorted(tuple(plain(r[c]) for c in names) for r in QUERIES[name](spark, str(folder)).collect())
    assert got == sorted(tuple(map(plain, r)) for r in result.fetchall())
    return got


def test_long_value_lists_are_whole(spark, tmp_path):
    """6,000 rows of one node and table: the SQL knows no limit."""
    duckdb.sql(f"""COPY (SELECT range AS event_id, TIMESTAMP '2024-01-01' + to_seconds(range) AS ts, 8::BIGINT AS user_id, 'click' AS event_type, 1.0 AS value, '{{"k": ' || range % 700 || '}}' AS props FROM range(6000)) TO '{tmp_path}/events.parquet'""")
    got = same_as_sql(spark, "value_lists", tmp_path, ["events"])
    assert len(got) == 1 and len(got[0][3].split(",")) == 700


def test_token_zero_of_a_wide_ring(spark, tmp_path):
    """The customer whose token is 0: eighteen more digits don't make it another number."""
    zero = 500_000 * pow(4_000_037, -1, 1_000_003) % 1_000_003
    duckdb.sql(f"COPY (SELECT unnest([1, 2, 3, {zero}])::BIGINT AS c_custkey, 1 AS c_nationkey) TO '{tmp_path}/customer.parquet'")
    duckdb.sql(f"COPY (SELECT range AS o_orderkey FROM range(300)) TO '{tmp_path}/orders.parquet'")
    assert any(r[0] == "0.0000" or r[0] == "0" for r in same_as_sql(spark, "wide_token_slots", tmp_path, ["customer"]))
    assert len(same_as_sql(spark, "wide_tokens_containing", tmp_path, ["customer", "orders"])) == 300
