"""Paths whose second and third rows fall into one second."""

import datetime as dt
import math

import duckdb
import pytest
from oracle import compare

from plumeflux.plans import QUERIES


@pytest.fixture
def at_once(tmp_path):
    start = dt.datetime(2024, 1, 1)
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    for user, seconds in ((0, [0, 60, 60.4, 120]), (1, [0, 60, 120, 180]), (2, [0, 60])):
        for n, s in enumerate(seconds):
            event = [100 * user + n, start + dt.timedelta(seconds=s), user, "view", 1.0, None]
            con.execute("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", event)
    # a leg that stays where it is: event 200 * k moves by nothing
    con.execute("INSERT INTO events SELECT 10000 + 100 * n, TIMESTAMP '2024-01-01' + to_seconds([0, 60, 60, 90][n + 1]), 3, 'view', 1.0, NULL FROM range(4) r(n)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["e04_forward_wind", "e04_forward_wind_repeat_last"])
def test_no_time_between_rows_divides_as_sql_does(spark, at_once, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at_once}/events.parquet'")
    ok, note = compare(spark, at_once, name, con)
    assert ok, note
    speeds = {(r.facility_id, r.step_id): r.wso for r in QUERIES[name](spark, at_once).collect()}
    assert speeds[0, 0] == math.inf and math.isnan(speeds[3, 0]) and speeds[2, 0] is None
    assert 0 < speeds[1, 0] < math.inf
