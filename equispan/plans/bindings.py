"""Adapters: the library's input tables, derived from the sample star schema.

Money is summed as whole numbers (cents times percent), so sums are exact in any order.
"""
from pyspark.sql import Window, functions as F

from ..functions.staging import keep
from ..operators.backtest import quarter_list_sql

SECTORS = {  # fixed values: one sector per market segment / region
    "AUTOMOBILE": "Industrials", "BUILDING": "Real Estate", "FURNITURE": "Energy",
    "HOUSEHOLD": "Financials", "MACHINERY": "Information Technology",
    "AFRICA": "Financials", "AMERICA": "Information Technology", "ASIA": "Industrials",
    "EUROPE": "Real Estate", "MIDDLE EAST": "Energy",
}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _map_case(col, mapping):
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(F.col(col) == k, v).otherwise(out)
    return out


BASE_SUMS = dict(
    ext="sum(_c)", net="sum(_c * (100 - _d))", tax="sum(_c * _t)", disc="sum(_c * _d)",
    ext_o="sum(if(l_linestatus = 'O', _c, 0L))", ext_n="sum(if(l_returnflag = 'N', _c, 0L))")
BASE_COLS = list(BASE_SUMS)


def _cents(li):
    return (li.withColumn("_c", F.expr("cast(round(l_extendedprice * 100) as bigint)"))
            .withColumn("_d", F.expr("cast(round(l_discount * 100) as bigint)"))
            .withColumn("_t", F.expr("cast(round(l_tax * 100) as bigint)")))


def base_sums(li, keys, **extra):
    """Exact money sums of line items per key."""
    sums = {**BASE_SUMS, **extra}
    return _cents(li).groupBy(*keys).agg(*[F.expr(v).alias(k) for k, v in sums.items()])


# concept formulas over the base sums; `k` is the numeric key of the ticker
CONCEPT_SQL = {
    "revenue": "net",
    "ebit": "(CASE WHEN k % 25 = 0 THEN 0.03D WHEN k % 5 = 0 THEN 0.10D ELSE 0.30D END) * net - tax",
    "cfo": "0.28D * net", "capex": "0.5D * tax", "sbc": "0.1D * disc", "dep_amort": "0.04D * net",
    "equity": "0.5D * ext", "assets": "1.2D * ext", "long_debt": "0.3D * ext_o", "cash": "0.1D * ext_n",
    "gross_profit": "0.45D * net",
    "gain_sale": "CASE WHEN fiscal_year % 2 = 0 THEN 0.02D * net END",
    "re_impair": "CASE WHEN fiscal_year % 3 = 0 THEN 0.01D * net END",
}
CONCEPT_SQL2 = {  # built on the first set
    "net_income": "0.8D * ebit", "liabilities": "assets - equity", "assets_current": "0.5D * assets",
    "liab_current": "0.3D * assets", "retained": "0.2D * assets", "tax_exp": "0.2D * ebit",
    "pretax": "ebit", "short_debt": "0.1D * long_debt", "interest_exp": "0.05D * long_debt",
    "op_leases": "0.05D * assets",
    "dividends": "CASE WHEN ebit > 0 THEN 0.3D * 0.8D * ebit END",
}


def _concepts(df, keep):
    """Wide concept columns from base sums; `ext` sums are cents, scaled to the money unit."""
    for c in ("ext", "ext_o", "ext_n"):
        df = df.withColumn(c, F.col(c) * F.lit(100.0))
    for c in ("net", "tax", "disc"):
        df = df.withColumn(c, F.col(c).cast("double"))
    df = df.select(*keep, "k", "fiscal_year", *BASE_COLS,
                   *[F.expr(v).alias(c) for c, v in CONCEPT_SQL.items()])
    return df.select(*keep, "k", "fiscal_year", *CONCEPT_SQL,
                     *[F.expr(v).alias(c) for c, v in CONCEPT_SQL2.items()])


WIDE_CONCEPTS = [*CONCEPT_SQL, *CONCEPT_SQL2]


def _shares(k):
    return f"1e7D * (1 + {k} % 97)"


def financials_wide(spark, sf_dir):
    """A: one row per (ticker, fiscal_year).  Line items are folded per order before the join."""
    li = base_sums(table(spark, sf_dir, "lineitem"), ["l_orderkey"])
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("fiscal_year"))
    sums = (li.join(orders, li.l_orderkey == orders.o_orderkey).groupBy("k", "fiscal_year")
            .agg(*[F.sum(c).alias(c) for c in BASE_COLS]))
    wide = _concepts(sums, [])
    return wide.withColumn("shares", F.expr(f"{_shares('k')} * (1 + 0.01D * ((k + fiscal_year) % 3 - 1))")) \
        .select(F.col("k").cast("string").alias("ticker"), "k", "fiscal_year", *WIDE_CONCEPTS, "shares")


def to_long(wide, ids, concepts):
    return (wide.unpivot(ids, concepts, "concept", "value").where("value IS NOT NULL"))


def financials_long(wide):
    """The long form of financials_wide, or of a staged copy of it."""
    return to_long(wide, ["ticker", "fiscal_year"], [*WIDE_CONCEPTS, "shares"])


def financials(spark, sf_dir):
    """A, long form: (ticker, fiscal_year, concept, value)."""
    return financials_long(financials_wide(spark, sf_dir))


NOW_CONCEPTS = ["revenue", "ebit", "net_income", "cfo", "capex", "sbc", "cash", "equity", "assets"]


def financials_now(spark, sf_dir, fin=None):
    """Fresh values for every third company: latest annual value moved 4%, dated by its last order."""
    fin = fin or financials(spark, sf_dir)
    last = (table(spark, sf_dir, "orders").where("o_custkey % 3 = 0")
            .groupBy(F.col("o_custkey").cast("string").alias("ticker"))
            .agg(F.max(F.to_date("o_orderdate")).alias("thru")))
    newest = (fin.where(F.col("concept").isin(NOW_CONCEPTS)).where("cast(ticker AS bigint) % 3 = 0")
              .groupBy("ticker", "concept").agg(F.max_by("value", "fiscal_year").alias("v")))
    return newest.join(last, "ticker").select(
        "ticker", "concept", (F.col("v") * 1.04).alias("value"), "thru",
        F.expr("if(concept IN ('cash', 'equity', 'assets'), 'instant', 'ttm')").alias("basis"))


NAME_SQL = ("concat({n}, CASE {k} % 4 WHEN 0 THEN ' INC' WHEN 1 THEN ' CORP /DE/' "
            "WHEN 2 THEN ' CLASS A' ELSE '' END)")


def companies(spark, sf_dir, fin=None):
    """B: one row per customer."""
    fin = fin or financials(spark, sf_dir)
    rev = (fin.where("concept = 'revenue'").groupBy("ticker")
           .agg(F.max_by("value", "fiscal_year").alias("rev")))
    cust = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    return (cust.withColumn("ticker", F.col("k").cast("string")).join(rev, "ticker", "left").select(
        "ticker", F.expr(NAME_SQL.format(n="c_name", k="k")).alias("name"),
        F.lpad("ticker", 10, "0").alias("cik"), _map_case("c_mktsegment", SECTORS).alias("sector"),
        F.expr(f"(0.5D + (k % 13) / 4D) * rev / ({_shares('k')})").alias("price"),
        F.expr(f"if(c_acctbal < 0, NULL, {_shares('k')})").alias("shares_out"),
        F.lit("USD").alias("fin_currency"),
        F.lpad((F.col("c_nationkey") * 97 + 1000).cast("string"), 4, "0").alias("sic"),
        F.expr("if(k % 11 = 0, '20-F', '10-K')").alias("form")))


def company_betas(spark, sf_dir):
    return (table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0")
            .select(F.col("c_custkey").cast("string").alias("ticker"),
                    F.expr("0.5D + (c_custkey % 16) / 10D").alias("beta")))


def universe_members(spark, sf_dir):
    """Every company is in `sp1500`; the even ones are in `sp500` as well."""
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return cust.select(
        F.explode(F.expr("if(k % 2 = 0, array('sp1500', 'sp500'), array('sp1500'))")).alias("universe"),
        F.col("k").cast("string").alias("ticker"))


def external_mcap(spark, sf_dir, comp):
    """Market caps from a second source, off by -20%..+20% and missing for every ninth company."""
    return comp.where("cast(ticker AS bigint) % 9 <> 0").select(
        "ticker", F.expr(f"price * ({_shares('cast(ticker AS bigint)')}) * "
                         "(0.8D + (cast(ticker AS bigint) % 9) * 0.05D)").alias("ext_mcap"))


# ---- D, E: monthly prices per supplier, splits, risk-free, FX ----
def monthly_prices(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return (_cents(li).groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month"))
            .agg((F.sum("_c") / 100 / F.sum(F.col("l_quantity").cast("long"))).alias("close"))
            .select(F.col("l_suppkey").cast("string").alias("ticker"), "month", "close",
                    F.expr("close * (0.7D + ((year(month) - 1995) * 12 + month(month)) / 400D)").alias("adjclose")))


def date_span(spark, sf_dir):
    """First and last day of the line items: the calendar that quarters, membership and windows are taken from."""
    return tuple(keep(spark, sf_dir, "date_span", lambda: table(spark, sf_dir, "lineitem").agg(
        F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("z"))).first())


def market_prices(prices):
    return prices.groupBy("month").agg(F.avg("adjclose").alias("adjclose"))


def company_prices(spark, sf_dir, prices):
    """The monthly prices of each company: the series of the supplier that its number falls on."""
    last = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] or 1
    tied = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("_company"), F.expr(f"cast(1 + (c_custkey - 1) % {last} AS string)").alias("ticker"))
    return prices.join(tied, "ticker").select(F.col("_company").alias("ticker"), "month", "adjclose")


def cap_weighted_prices(prices):
    """A second proxy, weighted by share counts; months that fall on a multiple of seven since 1970 have no price."""
    shares = F.col("ticker").cast("long") % 5 + 1
    return (prices.where("floor(months_between(month, DATE'1970-01-01')) % 7 <> 0").groupBy("month")
            .agg((F.sum(F.col("adjclose") * shares) / F.sum(shares)).alias("adjclose")))


def supplier_sectors(spark, sf_dir):
    sup, nat, reg = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (sup.join(nat, sup.s_nationkey == nat.n_nationkey).join(reg, nat.n_regionkey == reg.r_regionkey)
            .select(F.col("s_suppkey").cast("string").alias("ticker"),
                    _map_case("r_name", SECTORS).alias("sector")))


def splits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    part = table(spark, sf_dir, "part").where("p_size % 10 = 0").select("p_partkey")
    return (li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("l_suppkey").cast("string").alias("ticker"))
            .agg(F.trunc(F.min("l_shipdate"), "month").alias("sdate")).withColumn("factor", F.lit(2.0)))


def risk_free(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(
        F.sum(F.expr("cast(round(o_totalprice * 100) as bigint)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return (o.where("(year(month) * 12 + month(month)) % 7 <> 0")
            .select("month", F.expr("0.02D + ((s DIV n) % 3000000) / 1e8D").alias("rate")))


def fx_rates(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("ccy"),
        (1 + F.col("n_nationkey") / 100).alias("rate"))


# ---- C: point-in-time vintages per supplier-year, one per month of news ----
PIT_CONCEPTS = ["revenue", "ebit", "net_income", "cfo", "capex", "sbc", "equity", "long_debt", "cash",
                "dividends", "shares_wab"]


def pit_vintages(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    monthly = base_sums(li, ["l_suppkey", "month"]).withColumn("fiscal_year", F.year("month"))
    run = (Window.partitionBy("l_suppkey", "fiscal_year").orderBy("month")
           .rowsBetween(Window.unboundedPreceding, 0))
    cum = monthly.select(F.col("l_suppkey").alias("k"), "fiscal_year",
                         F.date_add(F.last_day("month"), 40).alias("filed"),
                         *[F.sum(c).over(run).alias(c) for c in BASE_COLS])
    wide = _concepts(cum, ["filed"]).withColumn("shares_wab", F.expr("1.5e7D * (1 + k % 5)"))
    wide = wide.withColumn("ticker", F.col("k").cast("string"))
    return to_long(wide, ["ticker", "fiscal_year", "filed"], PIT_CONCEPTS).select(
        "ticker", "concept", F.col("fiscal_year").alias("fy"), "filed",
        F.expr("make_date(fiscal_year, 12, 31)").alias("end_date"), "value")


def quarter_members(spark, sf_dir, start, end):
    """Nine suppliers in ten, a different tenth left out each quarter from the first to the last date."""
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return (sup.withColumn("qdate", F.explode(F.expr(quarter_list_sql(start, end))))
            .where("(k + year(qdate) * 4 + quarter(qdate)) % 10 <> 0")
            .select("qdate", F.col("k").cast("string").alias("ticker")))


# ---- F, G, H: index changes, daily prices, snapshots from the event stream ----
def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("ticker"),
        "user_id", "event_type", F.expr("cast(round(value * 100) as bigint)").alias("v"))


def index_changes(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type IN ('signup', 'error')").select(
        F.col("day").alias("date"), F.col("event_id").alias("row_no"),
        F.expr("if(event_type = 'signup', ticker, NULL)").alias("added"),
        F.expr("if(event_type = 'error', ticker, NULL)").alias("removed"))


def index_current(spark, sf_dir):
    return (_events(spark, sf_dir).where("event_type IN ('signup', 'error')")
            .groupBy("ticker").agg(F.max_by("event_type", F.struct("day", "event_id")).alias("last"))
            .where("last = 'signup'").select("ticker"))


def daily_prices(spark, sf_dir):
    return (_events(spark, sf_dir).groupBy("ticker", F.col("day").alias("date"))
            .agg((1 + F.sum("v") / 100 / F.count(F.lit(1))).alias("adjclose"))
            .withColumn("close", F.col("adjclose")))


def sessions(spark, sf_dir):
    return (_events(spark, sf_dir).select(F.col("day").alias("session")).distinct()
            .where("weekday(session) < 5"))


def session_prices(daily):
    return daily.where("weekday(date) < 5")


def snapshots(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("half", F.expr("if(hour(ts) < 12, 0, 1)"))
    runs = ev.groupBy("day", "half").agg(F.max("ts").alias("run_date"))
    rows = ev.groupBy("day", "half", "ticker", "user_id").agg(
        F.sum("v").alias("sv"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set("event_type")).alias("flags"))
    tot = rows.groupBy("day", "half").agg(F.sum("sv").alias("tv"), F.count(F.lit(1)).alias("tn"))
    return (rows.join(runs, ["day", "half"]).join(tot, ["day", "half"]).select(
        "run_date", F.lit("U").alias("universe"), F.expr("if(day(day) <= 15, 'm1', 'm2')").alias("model"),
        "ticker", F.expr("1 + sv / 100 / n").alias("price"), F.expr("sv / 100D").alias("score"),
        F.expr("(sv * tn) / tv - 1").alias("upside"), F.expr("cast(2 + user_id % 4 AS int)").alias("conf"),
        F.expr("cast(user_id % 101 AS int)").alias("quality"), "flags"))


def user_attrs(spark, sf_dir):
    """Sector and beta per event user, for the calibration panel."""
    names = list(dict.fromkeys(SECTORS.values()))
    arr = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    return (_events(spark, sf_dir).select("ticker", "user_id").distinct().select(
        "ticker", F.expr(f"get({arr}, cast(user_id % 5 AS int))").alias("sector"),
        F.expr("if(user_id % 10 = 0, NULL, 0.5D + (user_id % 16) / 10D)").alias("beta")))


# ---- I: facts rows ----
PRIORITY_TAGS = ("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'EntityCommonStockSharesOutstanding' "
                 "WHEN '2' THEN 'CommonStockSharesOutstanding' WHEN '3' THEN 'CommonStockSharesIssued' "
                 "ELSE 'WeightedAverageNumberOfSharesOutstandingBasic' END")


def facts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("end", F.last_day("o_orderdate"))
    return o.select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"),
        F.expr("if(o_custkey % 5 = 0, 'ifrs-full', 'us-gaap')").alias("ns"),
        F.expr("concat('Tag_', o_orderstatus)").alias("tag"),
        F.expr("if(o_custkey % 7 = 0 AND o_orderkey % 4 <> 0, 'EUR', 'USD')").alias("unit"),
        F.expr("if(month(end) = 12, add_months(end, -12), trunc(end, 'year'))").alias("start"), "end",
        F.col("o_totalprice").alias("val"), F.expr("date_add(end, cast(o_orderkey % 90 AS int))").alias("filed"),
        F.expr("if(month(end) = 12, '10-K', '10-Q')").alias("form"),
        F.expr("if(month(end) = 12, 'FY', 'Q')").alias("fp"), F.col("o_orderkey").alias("pos"))


FACT_TAGS = [("us-gaap", "revenue", "Tag_F", 0), ("us-gaap", "revenue", "Tag_O", 1),
             ("us-gaap", "net_income", "Tag_P", 0), ("us-gaap", "cash", "Tag_P", 0),
             ("us-gaap", "cash", "Tag_F", 1), ("ifrs-full", "revenue", "Tag_O", 0),
             ("ifrs-full", "net_income", "Tag_P", 0), ("ifrs-full", "cash", "Tag_F", 0)]


def fact_tagmap(spark):
    return spark.createDataFrame(FACT_TAGS, "ns string, concept string, tag string, tag_rank int")


def share_facts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"),
        F.expr("if(substr(o_orderpriority, 1, 1) = '1', 'dei', 'us-gaap')").alias("ns"),
        F.expr(PRIORITY_TAGS).alias("tag"), F.lit("shares").alias("unit"),
        F.to_date("o_orderdate").alias("end"), F.expr("if(o_orderkey % 6 = 0, 0D, o_totalprice)").alias("val"),
        F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 90 AS int))").alias("filed"),
        F.expr("if(o_custkey % 13 = 0, '6-K', if(o_custkey % 11 = 0, '20-F', '10-K/A'))").alias("form"),
        F.col("o_orderkey").alias("pos"))


# ---- J: filers and names ----
def filers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    return c.select(
        F.lpad(F.col("k").cast("string"), 10, "0").alias("cik"),
        F.expr(NAME_SQL.format(n="c_name", k="k")).alias("name"),
        F.expr("if(k % 8 = 0, '', lpad(cast(c_nationkey * 97 + 1000 AS string), 4, '0'))").alias("sic"),
        F.expr("if(k % 6 = 0, array(), array(concat('T', cast(if(k % 5 = 0, k DIV 2, k) AS string))))")
        .cast("array<string>").alias("tickers"),
        F.expr("if(k % 3 = 0, array('NYSE'), array('Nasdaq'))").alias("exchanges"),
        F.expr("if(k % 7 = 0, array(concat('Old ', c_name, ' Holdings, Inc.')), array())")
        .cast("array<string>").alias("former_names"))
