"""Each query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os
from collections import Counter

import pytest

from kinetrace.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert cols == sorted(rel.columns)
    want = Counter(tuple(map(plain, r)) for r in rel.select(*(f'"{c}"' for c in cols)).fetchall())
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == want


SLOW = {"forest_leave_user_out", "boosted_trees", "shadow_selection", "sparse_stability"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_rolling_rises_of_repeated_values(spark, tmp_path):
    """Windows that hold the same values in another order differ by rounding only; the SQL counts such a rise or not."""
    import duckdb

    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i) AS ts, i % 40 AS user_id, 'view' AS event_type, (hash(i * 7919) % 7) / 100.0 + 0.01 AS value, '{{}}' AS props FROM range(8000) t(i)) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    want = dict(con.sql(f"SELECT user_id, rises FROM ({ORACLES['rolling_cv_drift']})").fetchall())
    assert {r.user_id: r.rises for r in QUERIES["rolling_cv_drift"](spark, str(tmp_path)).collect()} == want
