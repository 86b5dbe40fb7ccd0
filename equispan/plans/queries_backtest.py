"""Queries over prices, membership and the backtest."""
import datetime

from pyspark.sql import functions as F

from . import bindings as b
from .registry import query, tidy
from ..functions.exprs import with_exprs
from ..functions.staging import keep, new_folder, stage
from ..operators import backtest as bt, membership as mb, prices as px
from ..sources import sinks


def windows(spark, d):
    """Four windows over the quarters that the line items' dates span."""
    a, z = bt.quarter_ends(spark, *b.date_span(spark, d)).agg(F.min("qdate"), F.max("qdate")).first()
    return bt.split_windows(a, z)


def month_windows(spark, d):
    a, z = b.date_span(spark, d)
    return bt.split_windows(a.replace(day=1), z.replace(day=1))


def monthly(spark, d):
    return keep(spark, d, "monthly_prices", lambda: b.monthly_prices(spark, d))


def market(spark, d):
    return b.market_prices(monthly(spark, d))


@query
def price_bars(spark, d):
    """S3: a bar document per ticker and month, packed and read back."""
    raw = b.daily_prices(spark, d).groupBy("ticker", F.weekofyear("date").alias("w")).agg(
        F.array_sort(F.collect_list(F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("t"), "close"))).alias("a"))
    raw = raw.select("ticker", F.expr("transform(a, x -> x.t)").alias("timestamp"),
                     F.expr("transform(a, (x, i) -> if(x.t DIV 86400 % 5 = 0, NULL, x.close))").alias("close"),
                     F.expr("transform(a, (x, i) -> if(x.t DIV 86400 % 3 = 0, NULL, x.close * 0.9D))").alias("adjclose"))
    return tidy(px.read_bars(raw), ["ticker", "date"], close=5, adjclose=5)


@query
def split_events(spark, d):
    raw = b.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("ticker"), F.expr(
            "map('a', named_struct('date', 86400L * p_partkey, 'numerator', cast(p_size % 4 AS double), 'denominator', cast(p_size % 3 AS double)))").alias("events"))
    return tidy(px.split_factors(raw), ["ticker", "sdate"], factor=6)


@query
def monthly_risk_free(spark, d):
    raw = b.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.max("o_orderkey").alias("k")).select(
        "date", F.expr("CASE k % 5 WHEN 0 THEN '.' WHEN 1 THEN '' ELSE cast((k % 700) / 100D AS string) END").alias("value"))
    return tidy(px.monthly_rf(raw), ["month"], rate=6)


@query
def blume_beta(spark, d):
    return tidy(px.betas(monthly(spark, d), market(spark, d)), ["ticker", "months"], beta_raw=5, beta=5)


@query
def rolling_beta(spark, d):
    return tidy(px.rolling_betas(monthly(spark, d), market(spark, d)), ["ticker", "month"], beta=5)


@query
def momentum_12_1(spark, d):
    return tidy(px.momentum_12_1(monthly(spark, d)), ["ticker", "month"], mom=6)


@query
def live_momentum(spark, d):
    members = b.supplier_sectors(spark, d).select(F.col("sector").alias("universe"), "ticker")
    return tidy(px.live_momentum(monthly(spark, d), members), ["universe", "ticker", "mom_pct"], mom=6)


def forward(spark, d):
    return px.forward_returns(monthly(spark, d), bt.quarter_ends(spark, *b.date_span(spark, d)))


@query
def forward_returns(spark, d):
    return tidy(forward(spark, d), ["qdate", "ticker"], fwd=6)


@query
def risk_free_locf(spark, d):
    months = b.table(spark, d, "lineitem").select(F.trunc("l_shipdate", "month").alias("month"))
    return tidy(px.rf_locf(b.risk_free(spark, d), months), ["month"], rate=6)


@query
def price_ranges(spark, d):
    daily, mon = b.daily_prices(spark, d), monthly(spark, d)
    out = None
    for rng, (df, date) in ((r, x) for r in ("1M", "6M", "YTD", "1Y", "5Y", "MAX") for x in ((daily, "date"), (mon, "month"))):
        part = px.price_range(df, rng, date).withColumn("rng", F.lit(f"{rng} {date}"))
        out = part if out is None else out.unionByName(part)
    return tidy(out, ["rng", "ticker", "points"], first=6, last=6, change=5)


@query
def quarter_calendar(spark, d):
    """Quarter ends that fall inside the span of the order dates."""
    a, z = b.table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first()
    return tidy(bt.quarter_ends(spark, a, z), ["qdate"])


@query
def membership_walkback(spark, d):
    """Each seventh day of the change log, from its first."""
    a, z = b.index_changes(spark, d).agg(F.min("date"), F.max("date")).first()
    weeks = [str(a + datetime.timedelta(days=k)) for k in range(6, (z - a).days + 1, 7)]
    return tidy(mb.membership_asof(b.index_current(spark, d), b.index_changes(spark, d), weeks), ["qdate", "ticker"])


@query
def walkback_anomalies(spark, d):
    """The whole change log, to its last day."""
    return tidy(mb.walkback_anomalies(b.index_current(spark, d), b.index_changes(spark, d)), ["ticker", "date", "row_no", "kind"])


def members(spark, d):
    return b.quarter_members(spark, d, *b.date_span(spark, d))


@query
def members_by_month(spark, d):
    months = monthly(spark, d).select("month").distinct()
    return mb.members_asof(members(spark, d), months).groupBy(F.col("month").cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ticker").alias("first_ticker"))


def signals(spark, d):
    def make():
        prices = monthly(spark, d)
        return bt.pit_signals(members(spark, d), stage(b.pit_vintages(spark, d)), prices, b.splits(spark, d), b.risk_free(spark, d),
                              b.supplier_sectors(spark, d), b.market_prices(prices))
    return keep(spark, d, "signals", make)


def cross(spark, d):
    return keep(spark, d, "cross", lambda: bt.quarter_cross_section(signals(spark, d)))


def scored(spark, d):
    return keep(spark, d, "scored", lambda: bt.score_variants(cross(spark, d)))


def picked(spark, d):
    return keep(spark, d, "picked", lambda: bt.top_quintile(scored(spark, d).select("variant", "qdate", "ticker", "score"), forward(spark, d)))


@query
def pit_signal(spark, d):
    return tidy(signals(spark, d), ["qdate", "ticker", "flags"], g_tr=5, om=5, roe=5, fcf_margin=5, wacc=6, dcf=3, epv=3, rim=3, ddm=3, impl=5, mom=5, beta=5)


@query
def quarter_warranted(spark, d):
    return tidy(cross(spark, d), ["qdate", "ticker"], warr=3)


@query
def score_variants(spark, d):
    return tidy(scored(spark, d), ["qdate", "variant", "ticker"], score=5, upside=5, q=4, rev_gap=5)


@query
def top_quintile(spark, d):
    return tidy(bt.quintile_returns(picked(spark, d)), ["variant", "qdate", "n"], strat=6, bench=6)


@query
def method_reliability(spark, d):
    return tidy(bt.method_reliability(scored(spark, d).where("variant = 'v2rd'"), forward(spark, d)), ["method", "quarters"], hit_rate=4, avg_excess=6)


@query
def basket_turnover(spark, d):
    return tidy(bt.turnover(picked(spark, d)), ["variant", "qdate"], turnover=5)


def returns(spark, d):
    return keep(spark, d, "returns", lambda: bt.quintile_returns(picked(spark, d)))


@query
def equity_curve(spark, d):
    return tidy(bt.equity_curve(returns(spark, d)), ["variant", "qdate"], sv=4, bv=4, sv_dd=4)


@query
def curve_stats(spark, d):
    out = bt.curve_stats(returns(spark, d), bt.turnover(picked(spark, d)))
    return tidy(out, ["variant", "periods"], hit_rate=3, strat_cagr=4, bench_cagr=4, strat_sharpe=2, bench_sharpe=2, strat_dd=3, bench_dd=3, turnover=3, names=1)


@query
def split_validation(spark, d):
    out = bt.split_validation(picked(spark, d), windows(spark, d), members(spark, d))
    return tidy(out, ["variant", "label", "periods"], excess=4, hit_rate=3)


@query
def signal_coverage(spark, d):
    out = bt.coverage(members(spark, d), signals(spark, d), early=windows(spark, d)[2][1])
    return tidy(out.withColumn("early", F.col("early").cast("int")), ["qdate", "members", "signals", "early"], share=4)


@query
def coverage_means(spark, d):
    out = bt.coverage(members(spark, d), signals(spark, d), early=windows(spark, d)[2][1])
    return tidy(bt.coverage_means(out), ["quarters"], mean_share=6, early_share=6)


@query
def survivorship_gap(spark, d):
    curve = bt.equity_curve(returns(spark, d).where("variant = 'v2rd'"))
    return tidy(bt.survivorship_gap(
        curve.select("qdate", "bv"), market(spark, d), windows(spark, d), b.cap_weighted_prices(monthly(spark, d))),
        ["label"], covered=4, index_ew=4, gap_pp=1, index_cap=4)


@query
def momentum_study(spark, d):
    out = bt.momentum_study(monthly(spark, d), members(spark, d), market(spark, d), month_windows(spark, d))
    return tidy(out, ["variant", "label", "periods"], excess=4, hit_rate=3, strat_cagr=4, strat_sharpe=2, strat_dd=3, turnover=3)


def redelivered(spark, d):
    """Prices, and the last months of them again a tenth higher, with one extra ticker."""
    old = monthly(spark, d).select("ticker", "month", "adjclose")
    new = old.where(F.col("month") >= F.add_months(F.lit(b.date_span(spark, d)[1]), -6)).withColumn("adjclose", F.col("adjclose") * 1.1).unionByName(
        old.where("ticker = '3'").withColumn("ticker", F.lit("NEW")))
    return old, new


def upserted(out):
    return tidy(out.withColumn("adjclose", F.col("adjclose") * 1.000123), ["ticker", "month"], adjclose=6)  # clear of exact halves


@query
def price_upsert(spark, d):
    """K2 on frames."""
    return upserted(sinks.upsert(*redelivered(spark, d), ["ticker", "month"]))


@query
def price_upsert_table(spark, d):
    """K2 into a table partitioned by month, read back."""
    old, new = redelivered(spark, d)
    path = new_folder(spark)
    old.repartition("month").write.partitionBy("month").parquet(path)
    sinks.write_upsert(path, new, ["ticker", "month"], "month")
    return upserted(spark.read.parquet(path).withColumn("month", F.col("month").cast("date")))


@query
def price_matrix(spark, d):
    """K5: both matrices, flattened to their filled cells and gap counts."""
    daily = b.daily_prices(spark, d).withColumn("adjclose", F.col("adjclose") + 0.00031)  # clear of half cents
    mon = daily.groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.min_by("adjclose", "date").alias("adjclose"))
    mem = daily.select("ticker").distinct().select(F.explode(F.expr("if(cast(ticker AS bigint) % 2 = 0, array('a', 'b'), array('a'))")).alias("universe"), "ticker")
    dm, mm = sinks.price_matrix(daily, mon, mem)
    out = None
    for label, df in (("daily", dm), ("monthly", mm)):
        part = df.select(F.lit(label).alias("block"), "universe", "ticker", F.size("axis").alias("axis_len"),
                         F.expr("size(filter(series, s -> s IS NULL))").alias("gaps"),
                         F.expr("aggregate(filter(series, s -> s IS NOT NULL), 0D, (a, s) -> a + s)").alias("total"))
        out = part if out is None else out.unionByName(part)
    return tidy(out, ["block", "universe", "ticker", "axis_len", "gaps"], total=4)
