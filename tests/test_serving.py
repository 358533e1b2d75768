"""Served lists of series that have neither a fresh nor a stored forecast."""
import datetime as dt

import duckdb

import __spark_entry__ as E
from tests.test_queries import _canon


def test_a_series_without_any_list_is_served_empty(spark, tmp_path):
    """Sensor 1: fresh; 2: stored; 3: neither, its only reading is newer than the stored run and not the last hour."""
    rows = [(1, dt.datetime(2024, 1, 30, 23, 10)), (2, dt.datetime(2024, 1, 20, 3, 0)), (3, dt.datetime(2024, 1, 29, 5, 30))]
    ev = [(i, ts, user, "view", 50.5, "{}") for i, (user, ts) in enumerate(rows)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", ev)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("fresh_or_stored", "fresh_or_stored_rows"):
        got = _canon(E.queries()[name](spark, str(tmp_path)).toPandas())
        assert got == _canon(con.sql(E.oracle_sql()[name]).df())
    served = {r.sensor_id: (r.source, r.n_points, r.first_ts) for r in E.queries()["fresh_or_stored"](spark, str(tmp_path)).collect()}
    assert served[3] == ("empty", 0, None) and served[1][0] == "fresh" and served[2][0] == "stored"
