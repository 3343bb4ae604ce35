"""Sketches held against exact figures on tables where a sketch has no answer, little to go by or nulls."""

import duckdb
import pytest

from evenkeel.plans.registry import ORACLES, QUERIES

ODD = {
    "no user is frequent": "SELECT 'view' AS event_type, i AS user_id, i % 977 / 8.0 AS value FROM range(60000) t(i)",
    "one user is": "SELECT 'view' AS event_type, CASE WHEN i % 3 = 0 THEN -1 ELSE i END AS user_id, i / 8.0 AS value FROM range(60000) t(i)",
    "few rows": "SELECT 'view' || n AS event_type, i % 2 AS user_id, 10.0 * i * i AS value FROM range(1, 6) s(n), range(n) t(i)",
    "nulls": "SELECT CASE WHEN i % 3 > 0 THEN 'view' || i % 3 END AS event_type, CASE WHEN i % 3 < 2 AND i % 5 > 0 THEN i % 40 END AS user_id, CASE WHEN i % 3 > 0 AND i % 7 > 0 THEN CAST(i AS DOUBLE) END AS value FROM range(3000) t(i)",
    "no numbers": "SELECT 'view' AS event_type, i % 40 AS user_id, CASE i % 4 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN -0.0 ELSE 0.0 END AS value FROM range(3000) t(i)",
}


@pytest.mark.parametrize("name", ODD)
def test_approximate(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_type, CAST(user_id AS BIGINT) AS user_id, CAST(value AS DOUBLE) AS value FROM ({ODD[name]})) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(ORACLES["agg_approximate"])
    got = QUERIES["agg_approximate"](spark, str(tmp_path)).select(*want.columns).collect()
    assert len(got) > 0 and sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
