"""Point-in-time backtest and momentum study."""
import datetime

from pyspark.sql import DataFrame, Window, functions as F

from ..assumptions import CFG, CYCLICAL_VOL, WEIGHTS
from ..functions import engines as en, ranks
from ..functions.exprs import last_n, latest, overlap, with_exprs
from ..functions.staging import stage
from . import crosssection as x, fundamentals as fd, metrics as m, prices as px, valuation as v

TAX, ERP = 0.21, 0.05


def quarter_list_sql(start, end):
    """The quarter ends in [start, end] as SQL for an array; none where the span holds none."""
    months = f"sequence(add_months(trunc(DATE'{start}', 'quarter'), 2), greatest(DATE'{end}', add_months(trunc(DATE'{start}', 'quarter'), 2)), INTERVAL 3 MONTHS)"
    return f"filter(transform({months}, m -> last_day(m)), q -> q BETWEEN DATE'{start}' AND DATE'{end}')"


def quarter_ends(spark, start, end):
    """B1: the quarter ends in [start, end]."""
    return spark.sql(f"SELECT explode({quarter_list_sql(start, end)}) AS qdate")


#: Windows of a validation: all dates, those before the fit, the fit's, and those held out, in thirds of the span.
WINDOW_THIRDS = {"full": (0, 3), "pre": (0, 1), "fit": (1, 2), "holdout": (2, 3)}


def split_windows(start, end):
    """(label, first day, last day) of each window over the dates from start to end, both included."""
    days = (end - start).days
    cuts = [start + datetime.timedelta(days=days * k // 3) for k in range(4)]
    return [(n, cuts[a] + datetime.timedelta(days=a > 0), cuts[b]) for n, (a, b) in WINDOW_THIRDS.items()]


def _mean_all(arr, value, where):
    """Sum over usable years divided by all years in the window, usable or not."""
    total = f"aggregate(transform(filter({arr}, x -> {where}), x -> {value}), 0D, (a, v) -> a + v)"
    return f"try_divide({total}, size({arr}))"


def _read_histories(hist):
    """What a signal takes from its history, as plain columns; histories too short or too old go.  No array is left, so
    that the joins which follow sort narrow rows."""
    rev = overlap("revenue")
    df = with_exprs(hist, rev_years=f"size({rev})", last_fy=f"get({rev}, size({rev}) - 1).fy", rev_vol=m.revenue_volatility_sql())
    df = df.where(f"rev_years >= 3 AND last_fy >= year(qdate) - 2 AND size({overlap('cfo')}) > 0 AND size({overlap('capex')}) > 0")
    df = with_exprs(df, cyc=f"coalesce(rev_vol > {CYCLICAL_VOL}, false)")
    df = with_exprs(df, nyrs="if(cyc, 10, 5)")
    df = with_exprs(df, win=last_n(overlap("revenue", "cfo", "capex"), "nyrs"), om_win=last_n(overlap("ebit", "revenue"), "nyrs"),
                    roe_win=last_n(overlap("net_income", "equity"), 5), rev_now=latest("revenue"), ebit_now=latest("ebit"),
                    ni_now=latest("net_income"), cfo_now=latest("cfo"), eq_now=latest("equity"), div_now=latest("dividends"),
                    debt=f"coalesce({latest('long_debt')}, 0D)", cash=f"coalesce({latest('cash')}, 0D)", g_tr=m.cagr_sql(),
                    drop3=f"coalesce(get({rev}, size({rev}) - 1).revenue < get({rev}, size({rev}) - 4).revenue, false)").where("size(win) > 0")
    df = with_exprs(df, fcf_margin=m.mean_of("win", f"({m.FCF}) / x.revenue", "x.revenue <> 0"),
                    om=_mean_all("om_win", "x.ebit / x.revenue", "x.revenue <> 0"),
                    roe=_mean_all("roe_win", "x.net_income / x.equity", "x.equity > 0"))
    return df.drop("series", "win", "om_win", "roe_win", "rev_years", "last_fy", "rev_vol", "nyrs")


def pit_signals(members, pit, prices, splits, rf, sectors, market) -> DataFrame:
    """One row per (quarter, member) with everything knowable on that date.  Value is set against the
    close; returns, beta and momentum use the adjusted close.  Histories are spread over members' quarters only."""
    dates = members.select("qdate").distinct()
    known = fd.series_asof(pit.where("concept <> 'shares_wab'"), dates, members).withColumnRenamed("fy", "fiscal_year")
    hist = _read_histories(m.company_series(known, ("qdate", "ticker"), dealt=("ticker",)))
    months = dates.select(F.trunc("qdate", "month").alias("month")).distinct()

    def asked(df):
        return df.join(F.broadcast(months), "month", "left_semi")

    mom = asked(px.momentum_12_1(prices)).join(asked(prices.select("ticker", "month", "close")), ["ticker", "month"])
    px_m = mom.join(asked(px.rolling_betas(prices, market)), ["ticker", "month"], "left")
    rates = px.rf_locf(rf, months)
    # Histories are the widest rows, so they are joined last.  Members may be exploded from a small file of tickers, whose size
    # the optimizer takes for theirs; unhinted, it would broadcast a row per ticker and quarter through the driver.
    df = (members.hint("merge").join(fd.shares_asof(pit, splits, dates, members), ["qdate", "ticker"])
          .withColumn("month", F.trunc("qdate", "month")).join(px_m, ["ticker", "month"])
          .join(F.broadcast(rates), "month").join(sectors, "ticker", "left")
          .withColumnRenamed("close", "price").where("price IS NOT NULL AND shares <> 0").join(hist, ["qdate", "ticker"]))
    df = with_exprs(df, mcap="price * shares", beta="coalesce(beta, 1D)")
    df = with_exprs(df, re=f"rate + beta * {ERP} + {m.size_premium_sql()}",
                    term_g=f"if(rate > 0.005, least({CFG['terminal_growth']}D, rate), 0.005D)",
                    g1=f"least({CFG['initial_growth_cap']}D, greatest(0D, coalesce(g_tr, 0D)))", inv_cap="coalesce(eq_now, 0D) + debt - cash")
    df = with_exprs(df, fcf_norm="fcf_margin * rev_now", wacc=m.wacc_sql(rd="(rate + 0.01)", tax=f"{TAX}D"),
                    nopat_norm=f"if(rev_now <> 0, om * rev_now * {1 - TAX}D, NULL)", lev="if(ebit_now > 0, -(debt - cash) / ebit_now, NULL)",
                    book_ps="if(eq_now > 0, eq_now / shares, NULL)")
    df = with_exprs(df, roic_dcf="if(inv_cap > 0, nopat_norm / inv_cap, NULL)")
    df = v.with_implied_growth(with_exprs(
        df, dcf=en.dcf_sql(f0="fcf_norm"), epv=en.epv_sql("(coalesce(om, 0D) * rev_now)", f"{TAX}D", dna=None),
        rim=f"if(book_ps IS NOT NULL AND roe <= 0.40 AND book_ps / price >= 0.15, {en.rim_sql(roe='roe')}, NULL)",
        _d="div_now / shares", _g="least(0.08D, g1)"), base="fcf_norm")
    paid = "div_now <> 0 AND _d / price >= 0.01 AND (sector = 'Real Estate' OR (ni_now > 0 AND div_now <= ni_now * 1.5)) AND _d > 0 AND re - term_g >= 0.005"
    df = with_exprs(df, ddm=f"if({paid}, {en.pv_fcf_sql('_d', 're', 'term_g', '_g')}, NULL)", flags="""cast(drop3 AS int)
      + cast(coalesce(fcf_norm, 0D) <= 0 AS int) + cast(coalesce(ebit_now > 0 AND (debt - cash) / ebit_now > 3.5, false) AS int)
      + cast(coalesce(ni_now <> 0 AND cfo_now <> 0 AND ni_now > cfo_now * 1.2, false) AS int)""", impl="implied_g")
    return df.select("qdate", "ticker", "sector", "price", "shares", "mcap", "g1", "g_tr", "om", "roe", "lev", "fcf_margin", "roic_dcf",
                     "ebit_now", "debt", "cash", "dcf", "epv", "rim", "ddm", "impl", "flags", "cyc", "mom", "beta", "wacc", "rate")


def quarter_cross_section(signals: DataFrame, least=20) -> DataFrame:
    """Quarters with enough signals, each with its own warranted fit."""
    n = signals.groupBy("qdate").agg(F.count(F.lit(1)).alias("n_sig")).where(f"n_sig >= {least}")
    df = with_exprs(signals.join(F.broadcast(n), "qdate"), bucket="coalesce(sector, 'UNKNOWN')",
                    ev_ebit="if(ebit_now > 0, (mcap + debt - cash) / ebit_now, NULL)", fit_g="g1", fit_m="coalesce(om, 0D)",
                    fit_r="coalesce(roic_dcf, 0D)")
    anchors, coefs = v.warranted_fit(df.where("ev_ebit > 0"), ["qdate"], bucket="bucket")
    return v.with_warranted(df, anchors, coefs, ["qdate"], bucket="bucket", out="warr").drop("bucket", "ev_ebit", "fit_g", "fit_m", "fit_r")


_OLD = dict(DCF=0.25, RIM=0.20, Warranted=0.25, DDM=0.10)
_NEW = dict(DCF=WEIGHTS["DCF"], RIM=WEIGHTS["RIM"], Warranted=WEIGHTS["Warranted"], DDM=WEIGHTS["DDM"])
VARIANTS = {  # fixed values: weights, quality dimensions (5 old / 4 new), flag rule, gap blend, factor weights, method scope
    "v1": dict(w=_OLD, q="q5", decay=False),
    "v2w": dict(w=_NEW, q="q4", decay=True),
    "v2": dict(w=_NEW, q="q4", decay=True, gap=0.4),
    "v3": dict(w=_NEW, q="q4", decay=True, factors=(1 / 3, 1 / 3, 1 / 3)),
    "v3m": dict(w=_NEW, q="q4", decay=True, factors=(0.25, 0.25, 0.50)),
    "v2r": dict(w=_NEW, q="q4", decay=True, rim_fin=True),
    "v2rd": dict(w=_NEW, q="q4", decay=True, rim_fin=True, ddm=True),
}
ADOPTED = "v2rd"


def _variant_sql(name, c):
    f = c.get("factors", (0.0, 0.0, 0.0))
    return ("named_struct('variant', '{}', 'w1', {}D, 'w2', {}D, 'w3', {}D, 'w4', {}D, 'five', {}, 'decay', {}, 'gap_w', {}D, "
            "'l7', {}, 'fv', {!r}D, 'fq', {!r}D, 'fm', {!r}D, 'rim_fin', {}, 'use_ddm', {})").format(
        name, c["w"]["DCF"], c["w"]["RIM"], c["w"]["Warranted"], c["w"]["DDM"], str(c["q"] == "q5").lower(), str(c["decay"]).lower(),
        c.get("gap", 0.0), str("factors" in c).lower(), *f, str(c.get("rim_fin", False)).lower(), str(c.get("ddm", False)).lower())


def score_variants(cross: DataFrame, names=tuple(VARIANTS)) -> DataFrame:
    """Every scoring variant of every quarter in one pass; variants are a literal list on each row."""
    dims5 = {"om": "om", "roe": "roe", "g_tr": "g_tr", "fcf_margin": "fcf_margin", "lev": "lev"}
    arr = ", ".join(f"named_struct('dim', '{k}', 'val', {c})" for k, c in dims5.items())
    long = (cross.select("qdate", "ticker", F.explode(F.expr(f"array({arr})")).alias("p"))
            .select("qdate", "ticker", "p.dim", "p.val").where("val IS NOT NULL"))
    pr = ranks.with_cume_dist(long, "val", ["qdate", "dim"], "pr").groupBy("qdate", "ticker").agg(
        F.avg("pr").alias("q5"), F.expr("avg(if(dim <> 'g_tr', pr, NULL))").alias("q4"))
    base = cross.join(pr, ["qdate", "ticker"], "left")
    base = base.withColumn("v", F.explode(F.expr("array(" + ", ".join(_variant_sql(n, VARIANTS[n]) for n in names) + ")")))
    base = base.select("*", "v.*").drop("v")
    base = with_exprs(base, _rim="if(rim_fin AND coalesce(sector NOT IN ('Financials', 'Real Estate'), true), NULL, rim)",
                      _ddm="if(use_ddm, ddm, NULL)")
    df = v.triangulate(base, {"A": "dcf", "B": "_rim", "C": "warr", "D": "_ddm"}, {"A": "w1", "B": "w2", "C": "w3", "D": "w4"}, floor="epv")
    df = with_exprs(df.where("mid IS NOT NULL"), q="coalesce(100 * if(five, q5, q4), 50D)")
    up = {k: f"if({c} <> 0, {c} / price - 1, NULL)" for k, c in (("dcf_up", "dcf"), ("warr_up", "warr"), ("epv_up", "epv"), ("rim_up", "rim"))}
    df = with_exprs(df, rev_gap="g_tr - impl", raw="""(greatest(-0.5D, least(0.6D, upside)) + 0.5) * (conf / 5D) * (q / 100D)
      * if(decay, pow(0.85D, flags), if(flags + cast(cyc AS int) > 0, 0.55D, 1D))""", **up)
    df = stage(df.select("qdate", "ticker", "variant", "sector", "upside", "q", "mom", "dcf_up", "warr_up", "epv_up", "rim_up", "rev_gap",
                         "raw", "gap_w", "l7", "fv", "fq", "fm"))
    keys = ["qdate", "variant"]
    plain = df.where("gap_w = 0 AND NOT l7").withColumn("score", F.col("raw"))
    gap = x.rank_blend(df.where("gap_w > 0"), "raw", "rev_gap", keys, "gap_w", "score")
    l7 = x.sector_z_many(df.where("l7"), ["warr_up", "rev_gap", "q", "mom"], keys)
    l7 = x.factor_blend(l7, {"V": ["z_warr_up", "z_rev_gap"], "Q": ["z_q"], "M": ["z_mom"]}, {"V": "fv", "Q": "fq", "M": "fm"}, "score")
    cols = ["qdate", "ticker", "variant", "sector", "score", "upside", "q", "mom", "dcf_up", "warr_up", "epv_up", "rim_up", "rev_gap"]
    return plain.select(*cols).unionByName(gap.select(*cols)).unionByName(l7.select(*cols))


def top_quintile(scored: DataFrame, fwd: DataFrame, score="score", keys=("variant", "qdate"), least=20) -> DataFrame:
    """Rows with a forward return, and whether each is among the max(10, n/5) best."""
    keys = list(keys)
    rows = stage(scored.join(fwd, ["qdate", "ticker"]))
    rows = ranks.with_position(rows, score, keys, "ticker", out="place", total="n", desc=True).where(f"n >= {least}")
    return with_exprs(rows, held="place <= greatest(10, n DIV 5)")


def quintile_returns(picked: DataFrame, keys=("variant", "qdate")) -> DataFrame:
    """Equal-weight return of the basket and of everyone."""
    return picked.groupBy(*keys).agg(F.max("n").alias("n"), F.expr("avg(if(held, fwd, NULL))").alias("strat"), F.avg("fwd").alias("bench"))


def method_reliability(scored: DataFrame, fwd: DataFrame, least=20) -> DataFrame:
    """The same test ranked by each measure on its own, against everyone's return that quarter."""
    methods = ["score", "dcf_up", "warr_up", "epv_up", "rim_up", "rev_gap", "mom"]
    rows = stage(scored.select("qdate", "ticker", *methods).join(fwd, ["qdate", "ticker"]))
    bench = rows.groupBy("qdate").agg(F.avg("fwd").alias("bench"), F.count(F.lit(1)).alias("_n")).where(f"_n >= {least}")
    arr = ", ".join(f"named_struct('method', '{c}', 'val', cast({c} AS double))" for c in methods)
    long = (rows.select("qdate", "ticker", "fwd", F.explode(F.expr(f"array({arr})")).alias("p"))
            .select("qdate", "ticker", "fwd", "p.method", "p.val").where("val IS NOT NULL"))
    top = ranks.with_position(long, "val", ["qdate", "method"], "ticker", out="place", total="n", desc=True)
    top = top.where(f"n >= {least} AND place <= greatest(10, n DIV 5)")
    q = (top.groupBy("qdate", "method").agg(F.avg("fwd").alias("r")).join(F.broadcast(bench), "qdate")
         .withColumn("excess", F.col("r") - F.col("bench")))
    return q.groupBy("method").agg(F.count(F.lit(1)).alias("quarters"), F.expr("count_if(excess > 0) / count(1)").alias("hit_rate"),
                                   F.avg("excess").alias("avg_excess"))


def turnover(picked: DataFrame, keys=("variant",), when="qdate") -> DataFrame:
    """Share of the basket that was not in the previous one; the first basket has none."""
    keys = list(keys)
    held = picked.where("held").select(*keys, when, "ticker")
    seq = held.groupBy(*keys, when).agg(F.count(F.lit(1)).alias("size"))
    seq = seq.withColumn("prev", F.lag(when).over(Window.partitionBy(*keys).orderBy(when)))
    now = ranks.with_groups(held, seq, [*keys, when])
    old = held.select(*keys, F.col(when).alias("prev"), "ticker", F.lit(1).alias("kept"))
    out = now.join(old, [*keys, "prev", "ticker"], "left").groupBy(*keys, when).agg(
        F.max("prev").alias("prev"), F.max("size").alias("size"), F.count("kept").alias("kept"))
    return with_exprs(out, turnover="if(prev IS NULL, NULL, 1 - kept / size)").select(*keys, when, "turnover")


def equity_curve(returns: DataFrame, keys=("variant",), when="qdate", places=4) -> DataFrame:
    """B11, curve: compounded values after each period and their drawdowns; a few rows per strategy."""
    w = Window.partitionBy(*keys).orderBy(when).rowsBetween(Window.unboundedPreceding, 0)

    def grown(c):
        path = F.collect_list(c).over(w)
        value = F.aggregate(path, F.lit(1.0), lambda a, r: a * (1 + r))
        return F.round(value, places) if places is not None else value

    df = returns.withColumns({"sv": grown("strat"), "bv": grown("bench")})
    for s in ("sv", "bv"):
        df = df.withColumn(f"{s}_dd", F.col(s) / F.greatest(F.lit(1.0), F.max(s).over(w)) - 1)
    return df


def curve_stats(returns: DataFrame, turns: DataFrame, keys=("variant",), when="qdate", per_year=4, least=8, places=4) -> DataFrame:
    """B11, stats: growth, hit rate, Sharpe, worst drawdown, turnover, names."""
    keys = list(keys)
    df = equity_curve(returns, keys, when, places).join(turns, [*keys, when], "left")
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"), F.max_by("sv", when).alias("sv"), F.max_by("bv", when).alias("bv"),
        F.expr("count_if(strat > bench) / count(1)").alias("hit_rate"), F.avg("strat").alias("ms"), F.stddev_pop("strat").alias("ss"),
        F.avg("bench").alias("mb"), F.stddev_pop("bench").alias("sb"), F.least(F.lit(0.0), F.min("sv_dd")).alias("strat_dd"),
        F.least(F.lit(0.0), F.min("bv_dd")).alias("bench_dd"), F.avg("turnover").alias("turnover"), F.avg("n").alias("names"))
    s = s.where(f"periods >= {least}")
    ann = "pow({0}, {1}D / periods) - 1"
    root = per_year ** 0.5
    return with_exprs(s, strat_cagr=ann.format("sv", per_year), bench_cagr=ann.format("bv", per_year),
                      strat_sharpe=f"if(ss > 0, ms * {per_year} / (ss * {root!r}D), 0D)",
                      bench_sharpe=f"if(sb > 0, mb * {per_year} / (sb * {root!r}D), 0D)").drop("sv", "bv", "ms", "ss", "mb", "sb")


def _in_windows(df, windows, when):
    """Rows repeated for each window they fall in."""
    arr = ", ".join(f"named_struct('label', '{n}', 'a', DATE'{a}', 'b', DATE'{b}')" for n, a, b in windows)
    df = df.withColumn("w", F.explode(F.expr(f"array({arr})"))).where(f"{when} BETWEEN w.a AND w.b")
    return df.withColumn("label", F.col("w.label")).drop("w")


def split_validation(picked: DataFrame, windows, quarters: DataFrame) -> DataFrame:
    """Excess growth and hit rate of each variant in each window."""
    ends = _in_windows(quarters.select("qdate").distinct(), windows, "qdate").groupBy("label").agg(F.max("qdate").alias("last_q"))
    rows = _in_windows(picked, windows, "qdate").join(F.broadcast(ends), "label").where("qdate < last_q")
    keys = ["variant", "label"]
    r = quintile_returns(rows, [*keys, "qdate"])
    s = curve_stats(r, turnover(rows, keys), keys)
    return with_exprs(s, excess="round(strat_cagr, 4) - round(bench_cagr, 4)").select(*keys, "excess", "hit_rate", "periods")


def coverage(members: DataFrame, signals: DataFrame, early="2016-01-01") -> DataFrame:
    """Members against signals per quarter."""
    m_ = members.groupBy("qdate").agg(F.count(F.lit(1)).alias("members"))
    s_ = signals.groupBy("qdate").agg(F.count(F.lit(1)).alias("signals"))
    out = m_.join(s_, "qdate", "left").fillna(0, ["signals"])
    return with_exprs(out, share="signals / members", early=f"qdate < DATE'{early}'")


def coverage_means(covered: DataFrame) -> DataFrame:
    """The mean share over all quarters and over the early ones; covered: coverage()."""
    return covered.agg(F.count(F.lit(1)).alias("quarters"), F.avg("share").alias("mean_share"), F.expr("avg(if(early, share, NULL))").alias("early_share"))


def survivorship_gap(curve: DataFrame, proxy: DataFrame, windows, cap_proxy: DataFrame, least=8) -> DataFrame:
    """Growth of the covered pool against an equal-weight index proxy over the same quarters, and the growth of a
    cap-weighted one beside it where that has a price at both ends.
    curve: (qdate, bench level after that quarter); proxy: (month, adjclose).  A level stands at the quarter's end, which
    is the next quarter's date, and the pool starts at one."""
    start = curve.agg(F.min("qdate").alias("qdate")).where("qdate IS NOT NULL").withColumn("bv", F.lit(1.0))
    curve = curve.select(F.last_day(F.add_months("qdate", 3)).alias("qdate"), "bv").unionByName(start)
    p = proxy.where("adjclose <> 0").select("month", F.col("adjclose").alias("pv"))
    rows = _in_windows(curve.join(p, F.trunc("qdate", "month") == p.month), windows, "qdate")
    s = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min_by("bv", "qdate").alias("b0"), F.max_by("bv", "qdate").alias("b1"),
                                  F.min_by("pv", "qdate").alias("p0"), F.max_by("pv", "qdate").alias("p1"),
                                  F.trunc(F.min("qdate"), "month").alias("m0"), F.trunc(F.max("qdate"), "month").alias("m1")).where(f"n >= {least}")
    c = cap_proxy.where("adjclose <> 0")
    for end in "01":
        s = s.join(c.select(F.col("month").alias(f"m{end}"), F.col("adjclose").alias(f"c{end}")), f"m{end}", "left")
    s = with_exprs(s, covered="pow(b1 / b0, 4D / (n - 1)) - 1", index_ew="pow(p1 / p0, 4D / (n - 1)) - 1",
                   index_cap="pow(c1 / c0, 4D / (n - 1)) - 1")
    return with_exprs(s, gap_pp="(covered - index_ew) * 100").select("label", "covered", "index_ew", "gap_pp", "index_cap")


MOMENTUM_VARIANTS = {  # fixed values: trend filter, cost per side
    "MOM (gross)": (False, 0.0), "MOM (net 10bp)": (False, 0.0010), "MOM (net 25bp)": (False, 0.0025), "MOM+trend (net)": (True, 0.0010)}


def momentum_study(prices, membership, market, windows, start=None, least_names=20, least_months=24) -> DataFrame:
    """Monthly top quintile by 12-1 momentum, its cost, and a market-trend filter."""
    from .membership import members_asof
    nxt = market.where("adjclose <> 0").select(F.add_months("month", -1).alias("month"))
    months = prices.select("month").distinct().join(nxt, "month", "left_semi")
    if start is not None:
        months = months.where(F.col("month") >= F.lit(start).cast("date"))
    mk = px.momentum_12_1(market.withColumn("ticker", F.lit("M"))).select("month", F.col("mom").alias("mkt_mom"))
    mom = px.momentum_12_1(prices)
    ahead = prices.select("ticker", F.add_months("month", -1).alias("month"), F.col("adjclose").alias("p1"))
    rows = (members_asof(membership, months).join(mom, ["ticker", "month"]).join(ahead, ["ticker", "month"])
            .where("mom IS NOT NULL AND adjclose > 0 AND p1 <> 0").withColumn("fwd", F.col("p1") / F.col("adjclose") - 1))
    rows = ranks.with_position(stage(rows), "mom", ["month"], "ticker", out="place", total="n", desc=True).where(f"n >= {least_names}")
    rows = stage(with_exprs(rows, held="place <= greatest(10, n DIV 5)").select("month", "ticker", "fwd", "held", "n"))
    base = quintile_returns(rows, ["month"]).join(mk, "month", "left")
    arr = ", ".join(f"named_struct('variant', '{n}', 'trend', {str(t).lower()}, 'cost', {c}D)" for n, (t, c) in MOMENTUM_VARIANTS.items())
    plan = base.withColumn("v", F.explode(F.expr(f"array({arr})"))).select("*", "v.*").drop("v")
    plan = with_exprs(plan, on="NOT trend OR coalesce(nullif(mkt_mom, 0D), -1D) > 0")
    w = Window.partitionBy("variant").orderBy("month")
    plan = plan.withColumns({"was_on": F.lag("on").over(w), "prev": F.lag("month").over(w)})
    held = rows.where("held").select("month", "ticker")
    pairs = plan.select("month", "prev").distinct().where("prev IS NOT NULL")
    kept = (held.join(F.broadcast(pairs), "month").join(held.select(F.col("month").alias("prev"), "ticker"), ["prev", "ticker"])
            .groupBy("month").agg(F.count(F.lit(1)).alias("kept")))
    plan = plan.join(kept, "month", "left")
    plan = with_exprs(plan, turnover="CASE WHEN on THEN 1 - if(coalesce(was_on, false), coalesce(kept, 0), 0) / greatest(10, n DIV 5) "
                                     "WHEN coalesce(was_on, false) THEN 1D ELSE 0D END")
    plan = with_exprs(plan, strat="if(on, strat, bench) - turnover * 2 * cost")
    plan = _in_windows(stage(plan.select("variant", "month", "strat", "bench", "turnover", "n")), windows, "month")
    keys = ["variant", "label"]
    s = curve_stats(plan.drop("turnover"), plan.select(*keys, "month", "turnover"), keys, "month", 12, least_months, None)
    return with_exprs(s, excess="strat_cagr - bench_cagr")
