"""Registered queries run at the smallest sample; a quick set is compared with its SQL there."""
import importlib
import sys
from pathlib import Path

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
check = importlib.import_module("check")
D = "/root/testdata/sf0.001"
QUICK = ["annual_pick", "ttm_stitch", "current_shares", "ticker_to_cik", "mcap_crosscheck", "revenue_cagr", "membership_walkback",
         "session_asof", "run_collapse", "ranked_board", "series_asof", "fx_to_usd", "delisted_name_resolve", "weekly_gate", "price_matrix",
         "quarter_calendar", "calibration_verdict", "decile_spread", "sorted_screen", "screen_csv", "name_search", "screen_filter",
         "peer_percentile", "price_ranges", "price_upsert", "company_inputs"]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(check.norm(r[c]) for c in cols) for r in df.collect()), key=str)
    res = con.execute(entry.oracle_sql()[name])
    ix = [[c[0] for c in res.description].index(c) for c in cols]
    want = sorted((tuple(check.norm(r[i]) for i in ix) for r in res.fetchall()), key=str)
    assert got == want
