"""The walk back through the index changes reads the whole log."""
import datetime as dt

import duckdb

from equispan.plans.catalog import QUERIES
from oracles.catalog import SQL


def test_walkback_reaches_the_last_day(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, day, 7, "signup", 1.0), (2, day + dt.timedelta(days=30), 8, "error", 1.0), (3, day + dt.timedelta(days=30), 8, "signup", 1.0),
            (4, day + dt.timedelta(days=29), 9, "error", 1.0), (5, day + dt.timedelta(days=30), 9, "error", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.ticker, r.date, r.row_no, r.kind) for r in QUERIES["walkback_anomalies"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == set(con.sql("SELECT ticker, date, row_no, kind FROM (" + SQL["walkback_anomalies"] + ")").fetchall())
    assert ("9", "2024-01-30", 4, "remove") in got
