"""Prices, returns, betas, momentum."""
from pyspark.sql import DataFrame, Window, functions as F

from ..assumptions import CFG
from ..functions.exprs import with_exprs
from .crosssection import with_pct_rank

BLUME = "greatest({0}D, least({1}D, 0.67D * {2} + 0.33D))"


def _blume(raw):
    return BLUME.format(CFG["beta_floor"], CFG["beta_cap"], raw)


def monthly_rf(daily: DataFrame) -> DataFrame:
    """(date, text value) rows; dots and blanks drop, the month's last observation wins."""
    ok = daily.withColumn("v", F.expr("try_cast(trim(value) AS double)")).where("v IS NOT NULL")
    return (ok.groupBy(F.trunc("date", "month").alias("month")).agg(F.max_by("v", "date").alias("v"))
            .select("month", (F.col("v") / 100).alias("rate")))


def read_bars(raw: DataFrame, freq="daily") -> DataFrame:
    """S3: bar documents (ticker, timestamp[], close[], adjclose[]) to rows; no close, no row."""
    bars = raw.select("ticker", F.explode(F.arrays_zip("timestamp", "close", F.coalesce("adjclose", "close"))).alias("p"))
    fields = bars.schema["p"].dataType.fieldNames()
    rows = bars.select("ticker", F.to_date(F.timestamp_seconds(F.col("p")[fields[0]])).alias("date"),
                       F.col("p")[fields[1]].alias("close"), F.coalesce(F.col("p")[fields[2]], F.col("p")[fields[1]]).alias("adjclose"))
    rows = rows.where("close IS NOT NULL")
    if freq == "monthly":
        rows = rows.withColumn("month", F.trunc("date", "month")).drop("date")
    return rows


def split_factors(raw: DataFrame) -> DataFrame:
    """(ticker, events map) to factors; both sides of the ratio are needed."""
    ev = raw.select("ticker", F.explode(F.map_values("events")).alias("e"))
    return (ev.where("e.numerator <> 0 AND e.denominator <> 0")
            .select("ticker", F.to_date(F.timestamp_seconds("e.date")).alias("sdate"),
                    (F.col("e.numerator") / F.col("e.denominator")).alias("factor")))


def _returns(prices: DataFrame, market: DataFrame) -> DataFrame:
    """Returns over consecutive months both series have.  A ticker's months are calendar-bounded,
    and the market is one row per month."""
    mk = F.broadcast(market.select("month", F.col("adjclose").alias("mp")))
    w = Window.partitionBy("ticker").orderBy("month")
    rows = prices.where("adjclose IS NOT NULL").select("ticker", "month", "adjclose").join(mk, "month")
    rows = rows.select("ticker", "month", "adjclose", "mp", F.lag("adjclose").over(w).alias("p0"), F.lag("mp").over(w).alias("m0"))
    ok = "p0 <> 0 AND m0 <> 0"
    return with_exprs(rows, r=f"if({ok}, adjclose / p0 - 1, NULL)", rm=f"if({ok}, mp / m0 - 1, NULL)")


def betas(prices: DataFrame, market: DataFrame, min_months=24) -> DataFrame:
    """Regression beta shrunk toward one."""
    s = (_returns(prices, market).where("r IS NOT NULL").groupBy("ticker")
         .agg(F.count("r").alias("months"), F.covar_pop("r", "rm").alias("c"), F.var_pop("rm").alias("v")))
    s = s.where(f"months >= {min_months} AND v > 0").withColumn("beta_raw", F.col("c") / F.col("v"))
    return with_exprs(s, beta=_blume("beta_raw")).select("ticker", "beta_raw", "beta", "months")


def rolling_betas(prices: DataFrame, market: DataFrame, n=60) -> DataFrame:
    """Beta over the last n returns at each month; too little history gives the default, and a month
    that the market lacks has the beta of the newest month before it."""
    w = Window.partitionBy("ticker").orderBy("month").rowsBetween(-(n - 1), 0)
    span = Window.partitionBy("ticker").orderBy("month").rowsBetween(-n, 0)
    r = _returns(prices, market).withColumns({
        "k": F.count("r").over(w), "c": F.covar_pop("r", "rm").over(w), "v": F.var_pop("rm").over(w),
        "months": F.count(F.lit(1)).over(span)})
    r = with_exprs(r, beta=f"if(months >= 25 AND k >= 24 AND v > 0, {_blume('c / v')}, {CFG['beta_default']}D)")
    known = prices.select("ticker", "month").join(r.select("ticker", "month", "beta"), ["ticker", "month"], "left")
    upto = Window.partitionBy("ticker").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return known.select("ticker", "month", F.coalesce(F.last("beta", True).over(upto), F.lit(CFG["beta_default"] * 1.0)).alias("beta"))


def momentum_12_1(prices: DataFrame) -> DataFrame:
    """T4: return from twelve months ago to one month ago, by the calendar: a gap gives null."""
    p = with_exprs(prices.select("ticker", "month", "adjclose"), ix="year(month) * 12 + month(month)")
    w = Window.partitionBy("ticker").orderBy("ix")
    p = p.withColumns({"p1": F.first("adjclose").over(w.rangeBetween(-1, -1)),
                       "p12": F.first("adjclose").over(w.rangeBetween(-12, -12))})
    return with_exprs(p, mom="if(p12 > 0 AND p1 <> 0, p1 / p12 - 1, NULL)").select("ticker", "month", "adjclose", "mom")


def live_momentum(prices: DataFrame, members: DataFrame) -> DataFrame:
    """T5: momentum at the newest month of any member, ranked within the universe.  Only the two months that a universe
    reads are joined with its members; universes are few."""
    p = prices.where("adjclose <> 0")
    top = F.broadcast(p.groupBy("ticker").agg(F.max("month").alias("_last")).join(members, "ticker").groupBy("universe").agg(F.max("_last").alias("top")))
    months = top.select(F.explode(F.expr("array(add_months(top, -1), add_months(top, -12))")).alias("month")).distinct()
    held = p.join(F.broadcast(months), "month").join(members, "ticker")
    near = held.join(top, "universe").where("month IN (add_months(top, -1), add_months(top, -12))")
    mom = near.groupBy("universe", "ticker").agg(
        F.expr("max(if(month = add_months(top, -1), adjclose, NULL))").alias("p1"),
        F.expr("max(if(month = add_months(top, -12), adjclose, NULL))").alias("p12"))
    mom = with_exprs(mom, mom="if(p12 > 0, p1 / p12 - 1, NULL)").where("mom IS NOT NULL").select("universe", "ticker", "mom")
    return with_exprs(with_pct_rank(mom, "mom", ["universe"], "pr"), mom_pct="cast(bround(round(100 * pr, 9)) AS int)").drop("pr")


def forward_returns(prices: DataFrame, periods: DataFrame) -> DataFrame:
    """Return from each period end to the next; both prices are needed."""
    nxt = periods.select("qdate", F.lead("qdate").over(Window.orderBy("qdate")).alias("qnext"))
    cal = F.broadcast(nxt.where("qnext IS NOT NULL"))
    p = prices.where("adjclose <> 0").select("ticker", "month", "adjclose")
    a = p.join(cal, F.expr("month = trunc(qdate, 'month')")).select("qdate", "ticker", F.col("adjclose").alias("p0"))
    b = p.join(cal, F.expr("month = trunc(qnext, 'month')")).select("qdate", "ticker", F.col("adjclose").alias("p1"))
    return a.join(b, ["qdate", "ticker"]).select("qdate", "ticker", (F.col("p1") / F.col("p0") - 1).alias("fwd"))


def rf_locf(rf: DataFrame, months: DataFrame, proxy: DataFrame | None = None, default=0.025) -> DataFrame:
    """The month's rate, else the last one before, else the proxy yield, else a default.
    One row per month: calendar-sized."""
    m = months.select("month").distinct().withColumn("want", F.lit(True))
    spine = rf.join(m, "month", "full")
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    out = spine.withColumn("last", F.last("rate", ignorenulls=True).over(w)).where("want")
    if proxy is not None:
        out = out.join(proxy.select("month", "raw"), "month", "left")
    else:
        out = out.withColumn("raw", F.lit(None).cast("double"))
    return out.select("month", F.expr(f"coalesce(last, if(raw > 20, raw / 1000, nullif(raw, 0D) / 100), {default}D)").alias("rate"))


RANGE_DAYS = {"1M": 30, "6M": 182, "1Y": 365, "5Y": 1826}  # fixed values


def price_range(prices: DataFrame, rng: str, date="date") -> DataFrame:
    """First and last price of each ticker's own trailing range, and the change."""
    p = prices.where("adjclose IS NOT NULL").select("ticker", F.col(date).alias("d"), "adjclose")
    if rng != "MAX":
        if date == "month" and rng == "5Y":
            w = Window.partitionBy("ticker").orderBy(F.desc("d"))
            p = p.withColumn("_r", F.row_number().over(w)).where("_r <= 60").drop("_r")
        else:
            top = p.groupBy("ticker").agg(F.max("d").alias("top"))
            cut = "trunc(top, 'year')" if rng == "YTD" else f"date_sub(top, {RANGE_DAYS[rng]})"
            cut = f"trunc({cut}, 'month')" if date == "month" else cut
            p = p.join(top, "ticker").where(f"d >= {cut}").drop("top")
    out = p.groupBy("ticker").agg(F.count(F.lit(1)).alias("points"), F.min_by("adjclose", "d").alias("first"), F.max_by("adjclose", "d").alias("last"))
    return with_exprs(out, change="try_divide(last, first) - 1")
