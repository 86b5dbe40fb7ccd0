"""Known values, stated as rows."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from equispan.functions import engines as en
from equispan.functions.exprs import with_exprs
from equispan.operators import (backtest as bt, calibration as cal, crosssection as x, entities, fundamentals as f, ledger as lg, metrics as m, membership as mb,
                                prices as px, screen as sc, snapshots as sn, valuation as v)
from equispan.sources import facts as src, sinks


def one(df):
    return df.collect()[0]


def test_present_value_is_a_growing_perpetuity(spark):
    df = spark.sql("SELECT 100D AS f, 0.10D AS w, 0.02D AS tg, 0.02D AS g")
    assert one(with_exprs(df, pv=en.pv_fcf_sql("f", "w", "tg", "g"))).pv == pytest.approx(1275.0)


def test_implied_growth_inverts_the_dcf(spark):
    df = spark.sql("SELECT id, 1e9D AS f, 0.09D AS w, 0.025D AS tg, -0.1D + id * 0.05D AS g, 5e8D AS nd, "
                   "if(id % 2 = 0, 2e9D, NULL) AS n, if(id % 2 = 0, 0.25D, NULL) AS r FROM range(8)")
    df = with_exprs(df, price=f"({en.ev_sql('f', 'w', 'tg', 'g', 'n', 'r')}) - nd")
    out = df.withColumn("s", en.implied_growth("f", "w", "tg", "nd", "price", "n", "r")).collect()
    for r in out:
        assert r.s.op == "=" and r.s.g == pytest.approx(r.g, abs=1e-9)


def test_implied_growth_bounds_and_refusals(spark):
    df = spark.createDataFrame([(1e9, 0.09, 0.025, 0.0, 1.0, None, None), (1e9, 0.09, 0.025, 0.0, 1e15, None, None),
                                (1e9, 0.03, 0.025, 0.0, 1e10, None, None), (1e9, 0.09, 0.025, 0.0, 1e10, 1e9, 0.05),
                                (-1.0, 0.09, 0.025, 0.0, 1e10, None, None)],
                               "f double, w double, tg double, nd double, p double, n double, r double")
    got = [(r.s.g, r.s.op) for r in df.select(en.implied_growth("f", "w", "tg", "nd", "p", "n", "r").alias("s")).collect()]
    assert got == [(-0.3, "<"), (0.8, ">"), (None, None), (None, None), (None, None)]


def test_wacc(spark):
    df = spark.sql("SELECT 80D AS mcap, 20D AS debt, 0.10D AS re, 0.05D AS rd, 0.21D AS tax_r")
    assert one(with_exprs(df, w=m.wacc_sql())).w == pytest.approx(0.0879)


TTM = [
    ([("2025-01-01", "2025-12-31", 1000.0), ("2025-01-01", "2025-06-30", 500.0), ("2026-01-01", "2026-06-30", 550.0)], (1050, "2026-06-30", "ttm")),
    ([("2025-01-01", "2025-12-31", 1000.0), ("2025-01-01", "2025-03-31", 250.0), ("2025-04-01", "2025-06-30", 280.0),
      ("2026-01-01", "2026-03-31", 260.0), ("2026-04-01", "2026-06-30", 290.0)], (1020, "2026-06-30", "ttm")),
    ([("2025-01-01", "2025-12-31", 1000.0), ("2025-01-01", "2025-06-30", 500.0), ("2026-01-01", "2026-06-30", 550.0),
      ("2026-04-01", "2026-06-30", 290.0)], (1050, "2026-06-30", "ttm")),
    ([("2025-01-01", "2025-12-31", 1000.0), ("2026-01-01", "2026-06-30", 550.0)], (1000, "2025-12-31", "fy")),
    ([("2025-01-01", "2025-12-31", 1000.0)], (1000, "2025-12-31", "fy")),
    ([("2025-02-01", "2026-01-31", 2000.0), ("2025-02-02", "2025-05-03", 480.0), ("2026-02-01", "2026-05-02", 520.0)], (2040, "2026-05-02", "ttm")),
    ([("2026-01-01", "2026-03-31", 250.0)], None),
]


def test_ttm(spark):
    rows = [(str(i), "us-gaap", "revenue", dt.date.fromisoformat(s), dt.date.fromisoformat(e), val)
            for i, (pts, _) in enumerate(TTM) for s, e, val in pts]
    df = spark.createDataFrame(rows, "cik string, ns string, concept string, start date, end date, value double")
    got = {r.cik: (r.value, str(r.thru), r.basis) for r in f.ttm(df).collect()}
    assert got == {str(i): want for i, (_, want) in enumerate(TTM) if want}


def test_annual_pick_rejects_a_quarter_labelled_as_a_year(spark):
    d = dt.date.fromisoformat
    rows = [("c", "us-gaap", "revenue", 0, 0, d("2025-01-01"), d("2025-12-31"), 2960.0, d("2026-02-15"), "10-K", "FY"),
            ("c", "us-gaap", "revenue", 0, 1, d("2025-10-01"), d("2025-12-31"), 640.0, d("2026-02-15"), "10-K", "FY"),
            ("c", "us-gaap", "assets", 0, 2, None, d("2025-12-31"), 500.0, d("2026-02-15"), "10-K", "FY")]
    df = spark.createDataFrame(rows, "cik string, ns string, concept string, tag_rank int, pos int, start date, end date, val double, "
                                     "filed date, form string, fp string")
    assert {(r.concept, r.fiscal_year, r.value) for r in f.annual_series(df).collect()} == {("revenue", 2025, 2960.0), ("assets", 2025, 500.0)}


def test_no_look_ahead(spark):
    d = dt.date.fromisoformat
    rows = [("t", "revenue", 2020, d("2021-02-01"), d("2020-12-31"), 10.0), ("t", "revenue", 2020, d("2021-08-01"), d("2020-12-31"), 12.0)]
    later = [("t", "revenue", 2020, d("2022-06-01"), d("2020-12-31"), 99.0)]
    schema = "ticker string, concept string, fy int, filed date, end_date date, value double"
    dates = spark.createDataFrame([(d("2021-03-31"),), (d("2021-06-30"),), (d("2021-12-31"),)], "qdate date")
    a = sorted(f.series_asof(spark.createDataFrame(rows, schema), dates).collect())
    b = sorted(f.series_asof(spark.createDataFrame(rows + later, schema), dates).collect())
    assert a == b and [r.value for r in a] == [10.0, 10.0, 12.0]


def test_names(spark):
    names = {"SVB Financial Group /DE/": "SVB FINANCIAL", "Kohl's Corp": "KOHLS", "V. F. Corporation": "V F",
             "Under Armour (Class A)": "UNDER ARMOUR", "Alphabet Inc. Class C": "ALPHABET"}
    df = entities.with_norm_name(spark.createDataFrame([(n,) for n in names], "name string"))
    assert {r.name: r.norm_name for r in df.collect()} == names


def test_name_resolution(spark):
    fil = spark.createDataFrame([("1", ["SIRIUS XM", "CD RADIO"]), ("2", ["V F", "V F NC"]), ("3", ["ACME STEEL"]), ("4", ["ACME IRON"])],
                                "cik string, norm_names array<string>")
    q = spark.createDataFrame([("a", "CD Radio Inc"), ("b", "VF"), ("c", "Acme"), ("d", "Steel Corp"), ("e", "Nobody"), ("f", "RAD")], "ticker string, name string")
    got = {r.ticker: r.cik for r in entities.resolve_names(q, fil).collect()}
    assert got == {"a": "1", "b": None, "c": None, "d": "3", "e": None, "f": "1"}
    pairs = spark.createDataFrame([("1", "SiriusXM"), ("2", "VF Corporation"), ("3", "Pepco Holdings"), ("9", "Anything")], "cik string, name string")
    assert {r.name: r.matches for r in entities.name_consistent(pairs, fil).collect()} == {
        "SiriusXM": True, "VF Corporation": True, "Pepco Holdings": False, "Anything": False}


@pytest.mark.parametrize("multiples,want", [((10.0, 12.0, 14.0), 117.0), ((50.0, 55.0, 60.0), 277.0)])
def test_warranted_anchor_and_cap(spark, multiples, want):
    rows = [("u", "TECH", y, 0.05, 0.20, 0.15) for y in multiples]
    df = spark.createDataFrame(rows, "universe string, wbucket string, ev_ebit double, fit_g double, fit_m double, fit_r double")
    anchors, coefs = v.warranted_fit(df, ["universe"])
    q = spark.sql("SELECT 'u' AS universe, explode(array('TECH', 'OTHER')) AS wbucket, 0D AS ev_ebit, 0.05D AS fit_g, 0.20D AS fit_m, 0.15D AS fit_r, "
                  "100D AS ebit_now, 20D AS cash, 50D AS debt, 10D AS shares")
    assert [r.warr_ps for r in v.with_warranted(q, anchors, coefs, ["universe"]).collect()] == pytest.approx([want, want])


def test_triangulate(spark):
    rows = [(100.0, None, 100.0, 10.0, 80.0), (100.0, 105.0, 95.0, None, 90.0), (100.0, 200.0, None, None, 100.0), (None, None, None, 50.0, 100.0),
            (-5.0, None, None, None, 100.0)]
    df = spark.createDataFrame(rows, "dcf_ps double, rim_ps double, warr_ps double, epv_ps double, price double")
    df = v.triangulate(with_exprs(df, ffo="cast(NULL AS double)", ddm_ps="cast(NULL AS double)"))
    got = [(r.low, r.mid, r.conf) for r in df.collect()]
    assert got[0] == (10.0, pytest.approx(100.0), 5)
    assert got[1][2] == 5
    assert got[2] == (100.0, pytest.approx((100 * 0.10 + 200 * 0.35) / 0.45), 2)
    assert got[3] == (50.0, 50.0, 2)
    assert got[4][1] is None


def test_spearman(spark):
    df = spark.createDataFrame([("a", float(i), float(j)) for i, j in zip([1, 2, 3, 4, 5], [5, 6, 7, 8, 7])]
                               + [("b", 1.0, 2.0), ("b", 2.0, 3.0)] + [("c", 1.0, float(i)) for i in range(5)], "g string, x double, y double")
    assert {r.g: r.ic for r in x.rank_ic(df, "x", "y", ["g"]).collect()} == {"a": 0.8208, "b": None, "c": None}


def test_ledger(spark):
    t = dt.datetime.fromisoformat
    rows = [(t("2026-01-01T10:00:00"), "U", "v2", f"T{i}", float(50 - i)) for i in range(50)]
    snap = spark.createDataFrame(rows, "run_date timestamp_ntz, universe string, model string, ticker string, score double")
    px = spark.createDataFrame([(f"T{i}", dt.date(2026, 1, 1), 10.0) for i in range(50)]
                               + [(f"T{i}", dt.date(2026, 4, 1), 12.0 if i < 10 else 10.0) for i in range(50)], "ticker string, date date, adjclose double")
    sess = px.select(F.col("date").alias("session")).distinct()
    r = one(lg.ledger(snap, px, sess))
    assert (r.k, r.age_days, r.trading_days, r.basket_ret, r.bench_ret, r.excess) == (10, 90, 1, 0.2, 0.04, 0.16)


def test_walkback_same_day_row_order(spark):
    ch = spark.createDataFrame([(dt.date(2024, 1, 10), 1, "A", None), (dt.date(2024, 1, 10), 2, None, "A")], "date date, row_no int, added string, removed string")
    cur = spark.createDataFrame([("B",)], "ticker string")
    assert {r.ticker for r in mb.membership_asof(cur, ch, ["2024-01-01"]).collect()} == {"A", "B"}


def test_upsert_and_weekly_gate(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "k string, m int, v double")
    new = spark.createDataFrame([("b", 1, 9.0), ("c", 1, 3.0)], "k string, m int, v double")
    assert {(r.k, r.v) for r in sinks.upsert(old, new, ["k", "m"]).collect()} == {("a", 1.0), ("b", 9.0), ("c", 3.0)}
    t = dt.datetime.fromisoformat
    s = "run_date timestamp_ntz, universe string, model string, ticker string"
    base = spark.createDataFrame([(t("2024-12-30T09:00:00"), "u", "m", "x")], s)
    same_week = spark.createDataFrame([(t("2025-01-03T09:00:00"), "u", "m", "x")], s)
    next_week = spark.createDataFrame([(t("2025-01-06T09:00:00"), "u", "m", "x")], s)
    assert sn.append_snapshots(base, same_week).count() == 1
    assert sn.append_snapshots(base, next_week).count() == 2


def test_json_sources(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.json").write_text(
        '{"cik": 7, "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2025-12-31", "val": 5, "filed": "2026-02-01", "form": "10-K", "fp": "FY"}]}}}}}')
    for name, text in (("b", '{"cik": 8, "facts": {"us-gaap": {"Assets"'), ("c", " \n"), ("d", '{"facts": {}}'), ("e", '{"cik": 9}')):
        (tmp_path / "f" / f"{name}.json").write_text(text)
    rows, broken = src.read_facts(spark, str(tmp_path / "f"))
    assert sorted((r.source[-6:], r.reason) for r in broken.collect()) == [
        ("b.json", "not JSON of this form"), ("c.json", "empty"), ("d.json", "no cik"), ("e.json", "no facts")]
    r = one(rows)
    assert (r.cik, r.tag, r.unit, r.val, r.start) == ("0000000007", "Assets", "USD", 5.0, None)
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text('{"cik": "8", "name": "Acme Corp", "sic": "", "tickers": ["ACM"], "exchanges": ["NYSE"], '
                                           '"formerNames": [{"name": "Old Acme"}], "filings": {"recent": [1]}}')
    r = one(src.read_filers(spark, str(tmp_path / "h")))
    assert (r.cik, r.tickers, r.norm_names) == ("0000000008", ["ACM"], ["ACME", "OLD ACME"])


def test_zero_share_count_is_not_the_newest(spark):
    rows = [("1", "us-gaap", "CommonStockSharesOutstanding", dt.date(2023, 12, 31), 100.0, dt.date(2024, 2, 1), 0),
            ("1", "us-gaap", "CommonStockSharesOutstanding", dt.date(2024, 12, 31), 0.0, dt.date(2025, 2, 1), 1)]
    facts = spark.createDataFrame(rows, "cik string, ns string, tag string, end date, val double, filed date, pos long")
    assert one(f.current_shares(facts)).shares_out == 100.0


def test_present_names_of_members(spark):
    current = spark.createDataFrame([("GOOG",), ("BRK.B",), ("FB",), ("AAPL",)], "ticker string")
    changes = spark.createDataFrame([(dt.date(2024, 3, 1), 1, "BRK.B", None), (dt.date(2030, 1, 1), 2, "AAPL", None)],
                                    "date date, row_no int, added string, removed string")
    got = {r.ticker for r in mb.membership_asof(current, changes.where("row_no = 1"), ["2024-01-31"]).collect()}
    assert got == {"META", "AAPL"}
    late = spark.createDataFrame([(dt.date(2030, 1, 1), 1, "NEWCO", None)], changes.schema)
    assert mb.walkback_anomalies(current, late).count() == 1
    assert mb.walkback_anomalies(current, late, today="2026-01-01").count() == 0


def test_pool_that_is_the_index_has_no_gap(spark):
    quarters = [dt.date(2000 + k // 4, 3 * (k % 4) + 3, 31 if k % 4 in (0, 3) else 30) for k in range(13)]
    growth = [0.01 * (k % 9 + 1) for k in range(12)]
    level, levels = 1.0, [1.0]
    for g in growth:
        level *= 1 + g
        levels.append(level)
    curve = spark.createDataFrame(list(zip(quarters[:-1], levels[1:], strict=True)), "qdate date, bv double")
    proxy = spark.createDataFrame([(q.replace(day=1), 50 * x) for q, x in zip(quarters, levels, strict=True)], "month date, adjclose double")
    cap = proxy.withColumn("adjclose", F.col("adjclose") * F.expr("if(month >= DATE'2003-01-01', 2, 1)"))
    windows = [("all", "2000-01-01", "2010-01-01")]
    out = one(bt.survivorship_gap(curve, proxy, windows, cap))
    assert out.gap_pp == pytest.approx(0, abs=1e-9) and out.covered > 0.1
    assert out.index_cap == pytest.approx((1 + out.covered) * 2 ** (1 / 3) - 1)
    out = one(bt.survivorship_gap(curve, proxy, windows, cap.where("month > DATE'2000-03-01'")))
    assert out.index_cap is None and out.covered > 0.1


def test_beta_of_a_month_without_market(spark):
    months = [dt.date(2000 + k // 12, k % 12 + 1, 1) for k in range(40)]
    path = [100.0]
    for k in range(39):
        path.append(path[-1] * (1.05 if k % 3 else 0.93))
    prices = spark.createDataFrame([("A", d, p * p) for d, p in zip(months, path, strict=True)], "ticker string, month date, adjclose double")
    market = spark.createDataFrame([(d, p) for d, p in zip(months[:-1], path, strict=False)], "month date, adjclose double")
    beta = {r.month: r.beta for r in px.rolling_betas(prices, market).collect()}
    assert len(beta) == 40 and beta[months[-1]] == beta[months[-2]] != 1.0


def test_upsert_keeps_one_new_row_for_a_key(spark):
    old = spark.createDataFrame([("A", 1, 1.0, 1), ("B", 1, 2.0, 1)], "k string, d int, v double, seq int")
    new = spark.createDataFrame([("A", 1, 9.0, 2), ("A", 1, 8.0, 3), ("C", 1, 5.0, 1)], old.schema)
    got = sorted(tuple(r) for r in sinks.upsert(old, new, ["k", "d"], order="seq").collect())
    assert got == [("A", 1, 8.0, 3), ("B", 1, 2.0, 1), ("C", 1, 5.0, 1)]


def test_no_verdict_on_few_windows(spark):
    ic = spark.createDataFrame([("U", "m", "upside", 0.1)], "universe string, model string, measure string, mean_ic double")
    dec = spark.createDataFrame([("U", "m", 1, 0.01, 1.0), ("U", "m", 10, 0.03, 1.0)], "universe string, model string, decile int, mean_fwd double, mean_beta double")
    few, many = (spark.createDataFrame([("U", "m", n)], "universe string, model string, independent int") for n in (11, 12))
    assert one(cal.verdict(ic, dec, few)).verdict == "not readable: 11 of 12 independent windows"
    assert one(cal.verdict(ic, dec, many)).verdict == ("upside predicts (IC 0.1000); sector-neutral not measurable; beta-neutral not measurable; "
                                                       "top-bottom spread 0.0200")


def test_bands_compare_what_the_board_shows(spark):
    df = spark.sql("SELECT 9.96e9D AS mcap, 50 AS quality, 3 AS conf, 0.1D AS upside, array() AS flags, 'E' AS sector")
    assert sc.screen(df, cap="large").count() == 1 and sc.screen(df, cap="mid").count() == 0


def test_upsert_writes_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "prices")
    old = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0), ("A", 2, 3.0)], "k string, month int, v double")
    old.write.partitionBy("month").parquet(path)
    kept = sorted(p.name for p in (tmp_path / "prices" / "month=2").iterdir())
    sinks.write_upsert(path, spark.createDataFrame([("A", 1, 9.0), ("C", 3, 5.0)], old.schema), ["k", "month"], "month")
    got = sorted((r.k, r.month, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("A", 1, 9.0), ("A", 2, 3.0), ("B", 1, 2.0), ("C", 3, 5.0)]
    assert sorted(p.name for p in (tmp_path / "prices" / "month=2").iterdir()) == kept


def test_snapshots_replace_their_own_day(spark, tmp_path):
    path = str(tmp_path / "snaps")

    def rows(*at):
        return spark.createDataFrame([("U", "m", dt.datetime(2024, 1, d, h), t) for d, h, t in at], "universe string, model string, run_date timestamp, ticker string")

    rows((2, 9, "A"), (9, 9, "A"), (9, 9, "B")).withColumn("_day", F.to_date("run_date")).write.partitionBy("universe", "model", "_day").parquet(path)
    sn.write_snapshots(path, rows((9, 15, "C")))   # the same day again: replaced
    sn.write_snapshots(path, rows((10, 9, "D")))   # the same week: refused
    sn.write_snapshots(path, rows((16, 9, "E")))   # a new week: added
    got = sorted((r.run_date.day, r.run_date.hour, r.ticker) for r in spark.read.parquet(path).collect())
    assert got == [(2, 9, "A"), (9, 15, "C"), (16, 9, "E")]


def test_run_record_of_each_universe(spark):
    rows = [("u", "a", None), ("u", "b", "ADR: share count unverified"), ("u", "c", "ADR: something else"), ("v", "d", "no revenue"), ("w", "e", None)]
    valued = spark.createDataFrame(rows, "universe string, ticker string, why string")
    universes = spark.createDataFrame([("u", "You"), ("v", "Vee")], "universe string, name string")
    changes = spark.createDataFrame([("u", "in", 2, "z", "new"), ("u", "in", 1, "y", "new")], "universe string, kind string, place int, ticker string, detail string")
    out = {r.universe: r for r in sinks.run_records(valued, universes, 0.01, "2024-01-05", changes).collect()}
    assert {k: (r.name, r.covered, r.n_excluded, [tuple(x) for x in r.excluded]) for k, r in out.items()} == {
        "u": ("You", 1, 2, [("ADR", 2)]), "v": ("Vee", 0, 1, [("no revenue", 1)]), "w": (None, 1, 0, [])}
    assert [x.ticker for x in out["u"].changes] == ["y", "z"] and out["v"].changes is None
    assert out["u"].terminal_g == 0.01 and out["u"].weights["rim"] == 0.35
