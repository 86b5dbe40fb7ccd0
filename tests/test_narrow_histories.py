"""Histories become plain columns where they are made: no exchange or sort of the signals carries their arrays."""
import datetime as dt
import re

from test_calendar import made
from test_group_joins import settings

from equispan.functions.staging import stage
from equispan.operators import backtest as bt, fundamentals as fd, metrics as m


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def nodes(text, kind):
    """The details of each node of a kind in a formatted plan."""
    return re.findall(rf"^\(\d+\) {kind}\n(?:.+\n)+", text, re.M)


def test_joins_carry_no_histories(spark):
    pit, dates, members, splits = made(spark)
    prices = spark.createDataFrame([(t, dt.date(1999 + k // 12, k % 12 + 1, 1), 10.0 + k, 9.0 + k) for t in "ab" for k in range(40)],
                                   "ticker string, month date, close double, adjclose double")
    rf = spark.createDataFrame([(dt.date(2000, 1, 1), 0.03)], "month date, rate double")
    sectors = spark.createDataFrame([("a", "Energy")], "ticker string, sector string")
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        out = bt.pit_signals(stage(members), stage(pit), stage(prices), stage(splits), rf, stage(sectors), prices.groupBy("month").avg("adjclose")
                             .withColumnRenamed("avg(adjclose)", "adjclose"))
        text = formatted(out)
    moved = nodes(text, "Exchange") + nodes(text, "Sort")
    assert len(moved) > 10 and not [x for x in moved if re.search(r"\b(series|win|om_win|roe_win)#\d+", x)]


def test_histories_are_spread_where_their_ticker_is(spark):
    pit, dates, members, _ = made(spark)
    pit = stage(pit)
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        known = fd.series_asof(pit, dates, members).withColumnRenamed("fy", "fiscal_year")
        dealt, plain = (m.company_series(known, ("qdate", "ticker"), **kw) for kw in ({"dealt": ("ticker",)}, {}))
        moved = [x for x in nodes(formatted(dealt), "Exchange") if re.search(r"\bvalue#\d+", x)]
        assert len(moved) == 1 and "hashpartitioning(ticker#" in moved[0]
        key = ("qdate", "ticker")
        assert sorted(map(str, dealt.orderBy(*key).collect())) == sorted(map(str, plain.orderBy(*key).collect()))
