"""Calendars and windows come from the tables; histories are spread over members' dates only."""
import datetime as dt
import re

from equispan.operators import backtest as bt, fundamentals as fd

D = dt.date


def test_windows_cover_the_span_without_overlap():
    for a, z in ((D(1995, 3, 31), D(2001, 9, 30)), (D(2020, 1, 1), D(2020, 1, 9)), (D(2000, 1, 1), D(2000, 1, 1))):
        (full, *parts) = bt.split_windows(a, z)
        assert full == ("full", a, z) and [p[0] for p in parts] == ["pre", "fit", "holdout"]
        assert parts[0][1] == a and parts[-1][2] == z
        for x, y in zip(parts, parts[1:]):
            assert y[1] == x[2] + dt.timedelta(days=1)


def test_quarters_of_short_spans(spark):
    def ends(a, z):
        return [str(r.qdate) for r in bt.quarter_ends(spark, a, z).collect()]
    assert ends("2000-01-01", "2000-03-30") == []
    assert ends("2000-03-31", "2000-03-31") == ["2000-03-31"]
    assert ends("2000-02-29", "2000-12-31") == ["2000-03-31", "2000-06-30", "2000-09-30", "2000-12-31"]


def made(spark):
    dates = [D(2000 + k // 4, 3 * (k % 4) + 3, (31, 30, 30, 31)[k % 4]) for k in range(9)]
    pit = [(t, c, fy, D(fy, 1, 15) + dt.timedelta(days=50 * n), D(fy, 12, 31), 100.0 * fy + n)
           for t in "abc" for c in ("revenue", "shares_wab") for fy in (1999, 2000, 2001) for n in range(3)]
    members = [(q, t) for k, q in enumerate(dates) for t in "ab" if (k + ord(t)) % 3]
    return (spark.createDataFrame(pit, "ticker string, concept string, fy int, filed date, end_date date, value double"),
            spark.createDataFrame([(q,) for q in dates], "qdate date"), spark.createDataFrame(members, "qdate date, ticker string"),
            spark.createDataFrame([("a", D(2001, 5, 1), 2.0)], "ticker string, sdate date, factor double"))


def test_members_first_gives_members_rows(spark):
    pit, dates, members, splits = made(spark)
    asked = {tuple(r) for r in members.collect()}
    for whole, some in ((fd.series_asof(pit, dates), fd.series_asof(pit, dates, members)),
                        (fd.shares_asof(pit, splits, dates), fd.shares_asof(pit, splits, dates, members))):
        want = sorted(tuple(r) for r in whole.collect() if (r.qdate, r.ticker) in asked)
        assert want and sorted(tuple(r) for r in some.collect()) == want


def test_plan_prunes_filings_before_they_are_spread(spark):
    """Filings of no member go before the first aggregation, and only asked dates are made."""
    pit, dates, members, _ = made(spark)
    plan = fd.series_asof(pit, dates, members)._jdf.queryExecution().optimizedPlan().toString()
    spread = [k for k, line in enumerate(plan.splitlines()) if "Generate explode(filter(_asked" in line]
    semi = [k for k, line in enumerate(plan.splitlines()) if "LeftSemi" in line]
    assert len(spread) == 1 and semi and min(semi) > spread[0]
    assert not re.search(r"Generate explode\(sequence\(cast\(pos", plan)
