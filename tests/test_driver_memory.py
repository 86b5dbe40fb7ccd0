"""Members, a row per ticker and quarter exploded from a small file of tickers, are not gathered on the driver."""
import datetime as dt
import re

from test_calendar import made
from test_group_joins import settings
from test_narrow_histories import formatted, nodes

from equispan.functions.staging import stage
from equispan.operators import backtest as bt


def test_members_are_not_broadcast(spark):
    pit, dates, _, splits = made(spark)
    days = ", ".join(f"DATE'{r.qdate}'" for r in dates.collect())
    tickers = stage(spark.createDataFrame([("a",), ("b",)], "ticker string"))
    members = tickers.selectExpr(f"explode(array({days})) AS qdate", "ticker")
    prices = stage(spark.createDataFrame([(t, dt.date(1999 + k // 12, k % 12 + 1, 1), 10.0 + k, 9.0 + k) for t in "ab" for k in range(40)],
                                         "ticker string, month date, close double, adjclose double"))
    rf = spark.createDataFrame([(dt.date(2000, 1, 1), 0.03)], "month date, rate double")
    sectors = stage(spark.createDataFrame([("a", "Energy")], "ticker string, sector string"))
    market = prices.groupBy("month").agg({"adjclose": "avg"}).withColumnRenamed("avg(adjclose)", "adjclose")
    with settings(spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "10MB"}):
        out = formatted(bt.pit_signals(members, stage(pit), prices, stage(splits), rf, sectors, market))
    sent = nodes(out, "BroadcastExchange")
    assert sent and not [x for x in sent if re.search(r"Input \[2\]: \[qdate#\d+, ticker#\d+\]", x)]
