"""Queries over company metrics."""
from pyspark.sql import functions as F

from . import bindings as b
from .registry import query, tidy
from ..assumptions import assumption_tables
from ..functions.exprs import with_exprs
from ..functions.staging import keep, stage
from ..operators import metrics as m, quality as q

RF = 0.043
TODAY = "2001-12-31"


def financials(spark, d):
    """The long form; what is staged has a row per company-year, which is written and read back in a fraction of the time."""
    return b.financials_long(keep(spark, d, "financials", lambda: b.financials_wide(spark, d)))


def fresh_inputs(spark, d):
    fin = financials(spark, d)
    comp = stage(b.companies(spark, d, fin))
    dq = q.mcap_xcheck(comp, b.external_mcap(spark, d, comp))
    return m.company_inputs(comp, fin, b.financials_now(spark, d, fin), b.company_betas(spark, d), RF,
                            assumption_tables(spark)["archetype_overrides"], dq)


def inputs(spark, d):
    return keep(spark, d, "inputs", lambda: fresh_inputs(spark, d))


def series(spark, d):
    return m.company_series(financials(spark, d))


@query
def company_wide(spark, d):
    out = m.company_wide(b.financials(spark, d))
    out = with_exprs(out, revenue_m="revenue / 999983.0", equity_m="equity / 999983.0", impair_m="re_impair / 999983.0", shares_m="shares / 999983.0")
    return tidy(out, ["ticker", "fiscal_year"], revenue_m=6, equity_m=6, impair_m=6, shares_m=6)


@query
def latest_of_series(spark, d):
    out = m.latest_by(b.financials(spark, d)).withColumn("value_m", F.col("value") / 999983.0)
    return tidy(out, ["ticker", "concept", "fiscal_year"], value_m=6)


@query
def revenue_cagr(spark, d):
    return tidy(with_exprs(series(spark, d), cagr=m.cagr_sql(), cagr_ebit=m.cagr_sql("ebit", 3)), ["ticker"], cagr=6, cagr_ebit=6)


@query
def mean_margin(spark, d):
    return tidy(with_exprs(series(spark, d), m5=m.avg_ratio_sql("ebit", "revenue", 5), m10=m.avg_ratio_sql("ebit", "revenue", 10)),
                ["ticker"], m5=6, m10=6)


@query
def roe_metrics(spark, d):
    out = with_exprs(series(spark, d), roe=m.avg_ratio_sql("net_income", "equity", 5, True), roe_std=m.roe_std_sql(),
                     eq_assets=m.avg_ratio_sql("equity", "assets", 3, True))
    return tidy(out, ["ticker"], roe=6, roe_std=6, eq_assets=6)


@query
def effective_tax(spark, d):
    return tidy(with_exprs(series(spark, d), tax=m.effective_tax_sql()), ["ticker"], tax=6)


@query
def discount_rates(spark, d):
    """M5-M7: size premium, cost of debt, cost of equity, WACC."""
    return tidy(inputs(spark, d).where("why IS NULL"), ["ticker"], size_prem=4, rd=6, re=6, wacc=6)


@query
def revenue_volatility(spark, d):
    out = with_exprs(series(spark, d), vol=m.revenue_volatility_sql())
    return tidy(with_exprs(out, cyclical="cast(coalesce(vol > 0.18, false) AS int)"), ["ticker", "cyclical"], vol=6)


@query
def normalized_fcf(spark, d):
    out = with_exprs(inputs(spark, d).where("why IS NULL"), fcf_norm_m="fcf_norm / 999983.0", fcf_last_m="fcf_last / 999983.0")
    return tidy(out, ["ticker"], fcf_margin=6, fcf_norm_m=5, fcf_last_m=5)


@query
def company_inputs(spark, d):
    out = with_exprs(inputs(spark, d), rev_m="rev_now / 999983.0", debt_m="debt / 999983.0", risk_m="debt_risk / 999983.0", cash_m="cash / 999983.0",
                     mcap_m="mcap / 999983.0", div_m="div / 999983.0")
    return tidy(out, ["ticker", "arch", "why"], rev_m=5, debt_m=5, risk_m=5, cash_m=5, mcap_m=5, div_m=5, g1=6, beta=3)


@query
def excluded_first_pass(spark, d):
    """Counts by reason.  Nothing else reads these inputs, so they are not staged with all their metrics and histories."""
    return fresh_inputs(spark, d).where("why IS NOT NULL").groupBy("why").agg(F.count(F.lit(1)).alias("n"))


@query
def returns_on_capital(spark, d):
    return tidy(with_exprs(inputs(spark, d).where("why IS NULL"), nopat_m="nopat_norm / 999983.0"), ["ticker"], roic=6, nopat_m=5, roic_dcf=6)


@query
def ffo_series(spark, d):
    out = series(spark, d).select("ticker", F.explode(F.expr(m.FFO)).alias("f")).select("ticker", "f.fy", (F.col("f.ffo") / 999983.0).alias("ffo_m"))
    return tidy(out, ["ticker", "fy"], ffo_m=6)


@query
def altman_z(spark, d):
    return tidy(m.with_altman_z(inputs(spark, d).where("why IS NULL")), ["ticker"], altman_z=4)


@query
def piotroski_score(spark, d):
    return tidy(m.with_piotroski(series(spark, d)), ["ticker"], piotroski=0, piotroski_n=0)


@query
def stale_filings(spark, d):
    out = m.with_stale(inputs(spark, d), TODAY)
    return out.select("ticker", F.col("stale").cast("int").alias("stale"))


@query
def capital_panel(spark, d):
    return tidy(m.capital_panel(inputs(spark, d).where("why IS NULL")), ["ticker"], cap_roic=4, cap_spread=4, cap_reinvest=4, cap_inc_roic=4)


@query
def trend_arrays(spark, d):
    out = m.with_trend_change(m.trends(series(spark, d)))
    return tidy(with_exprs(out, years="array_join(trends.years, ',')", gaps="size(filter(trends.fcfB, x -> x IS NULL))",
                           last_rev="get(trends.revenueB, size(trends.revenueB) - 1)"),
                ["ticker", "years", "gaps"], last_rev=3, revenueB_chg=3, opMargin_chg=3, sharesM_chg=3)
