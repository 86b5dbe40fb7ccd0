"""Per-company metrics (S8, S9, M1-M20, Q8 first pass).

``company_series`` makes the shuffles by ticker; the rest are projections over its array column.
"""
from pyspark.sql import DataFrame, functions as F

from ..assumptions import CFG, CONCEPTS, CYCLICAL_VOL, DEBT_FLOOR_SPREAD, REINVEST_CAP
from ..functions.exprs import clamp, last_n, latest, mean_of, moments, overlap, with_exprs
from .entities import HYGIENE

FCF = "x.cfo - x.capex - coalesce(x.sbc, 0D)"


def company_wide(fin: DataFrame, keys=("ticker",)) -> DataFrame:
    """S8, one row per company-year with a column per concept."""
    picks = [F.expr(f"max(if(concept = '{c}', value, NULL))").alias(c) for c in CONCEPTS]
    return fin.groupBy(*keys, "fiscal_year").agg(*picks)


def company_series(fin: DataFrame, keys=("ticker",), dealt=None) -> DataFrame:
    """Long annual facts to one row per company.  Facts become company-years where they are read, and only these are
    shuffled, once for each grouping; facts that are dealt by some of the keys already stay there for both."""
    wide = company_wide(fin.repartition(*dealt) if dealt else fin, keys)
    entry = F.struct(F.col("fiscal_year").alias("fy"), *CONCEPTS)
    return wide.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("series"))


def latest_by(fin: DataFrame, keys=("ticker", "concept")) -> DataFrame:
    """The newest year's value."""
    return fin.groupBy(*keys).agg(F.max_by("value", "fiscal_year").alias("value"),
                                  F.max("fiscal_year").alias("fiscal_year"))


def now_map(now: DataFrame) -> DataFrame:
    """Fresh values per ticker as a map (at most one entry per concept) with their dates."""
    return now.groupBy("ticker").agg(
        F.map_from_entries(F.collect_list(F.struct("concept", "value"))).alias("now"),
        F.expr("max(if(concept = 'revenue', thru, NULL))").alias("fin_thru"), F.max("thru").alias("any_thru"))


# ---- single metrics as SQL text over `series` ----
def cagr_sql(field="revenue", years=5):
    """M1."""
    ends = (f"get(transform(array({overlap(field)}), s -> named_struct('a', get(s, greatest(size(s) - 1 - {years}, 0)), "
            "'b', get(s, size(s) - 1))), 0)")
    return (f"get(transform(array({ends}), p -> CASE WHEN p.b.fy > p.a.fy AND p.a.{field} > 0 AND p.b.{field} > 0 "
            f"THEN pow(p.b.{field} / p.a.{field}, 1D / (p.b.fy - p.a.fy)) - 1 END), 0)")


def avg_ratio_sql(num, den, years, positive=False):
    """M2, M3: mean of num/den over the last years both exist; unusable years drop after the cut."""
    test = f"x.{den} > 0" if positive else f"x.{den} <> 0"
    return mean_of(last_n(overlap(num, den), years), f"x.{num} / x.{den}", test)


def roe_std_sql(years=6, least=3):
    """M3: population deviation of ROE."""
    roes = f"transform(filter({last_n(overlap('net_income', 'equity'), years)}, x -> x.equity > 0), x -> x.net_income / x.equity)"
    return f"get(transform(array({moments(roes)}), m -> if(m.n >= {least}, sqrt(m.q / m.n), NULL)), 0)"


def effective_tax_sql(years=3):
    """M4."""
    mean = mean_of(last_n(overlap("tax_exp", "pretax"), years), "x.tax_exp / x.pretax", "x.pretax > 0 AND x.tax_exp > 0")
    return f"coalesce({clamp(mean, CFG['tax_floor'], CFG['tax_cap'])}, {CFG['tax_rate']}D)"


def size_premium_sql(mcap="mcap"):
    """M5."""
    whens = " ".join(f"WHEN {mcap} >= {float(lo)!r}D THEN {p}D" for lo, p in CFG["size_premium_bands"])
    return f"CASE WHEN {mcap} IS NULL OR {mcap} = 0 THEN 0D {whens} ELSE 0D END"


def cost_of_debt_sql(interest, debt, rf):
    """M6."""
    return (f"CASE WHEN {interest} > 0 AND {debt} > 0 THEN greatest({rf} + {DEBT_FLOOR_SPREAD}, "
            f"least({CFG['cost_of_debt_cap']}D, {interest} / {debt})) ELSE {rf} + {CFG['cost_of_debt_spread']} END")


def wacc_sql(equity="mcap", debt="greatest(debt, 0D)", re="re", rd="rd", tax="tax_r"):
    """M7."""
    return (f"CASE WHEN {equity} + {debt} > 0 THEN {equity} / ({equity} + {debt}) * {re} + "
            f"{debt} / ({equity} + {debt}) * {rd} * (1 - {tax}) ELSE {re} END")


def revenue_volatility_sql(obs=6, least=3):
    """M8: population deviation of the last year-on-year revenue growths."""
    s = overlap("revenue")
    n = f"greatest(size({s}) - 1, 0)"
    growth = (f"filter(zip_with(slice({s}, 1, {n}), slice({s}, 2, {n}), (a, b) -> "
              "if(a.revenue <> 0, b.revenue / a.revenue - 1, NULL)), g -> g IS NOT NULL)")
    last = f"get(transform(array({growth}), gs -> {last_n('gs', obs)}), 0)"
    return f"get(transform(array({moments(last)}), m -> if(m.n >= {least}, sqrt(m.q / m.n), NULL)), 0)"


FFO = ("transform(filter(series, x -> x.net_income IS NOT NULL AND x.dep_amort IS NOT NULL), x -> named_struct('fy', x.fy, "
       "'ffo', x.net_income + x.dep_amort - coalesce(x.gain_sale, 0D) + coalesce(x.re_impair, 0D)))")


def archetype_sql(sector="sector", override="NULL"):
    """V11, first step."""
    return (f"coalesce({override}, CASE {sector} WHEN 'Financials' THEN 'financial' "
            f"WHEN 'Real Estate' THEN 'reit' ELSE 'standard' END)")


def with_archetype(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """A pinned archetype, else by sector.  The pins are configuration."""
    ov = overrides.select("ticker", F.col("archetype").alias("_pin"))
    return (df.join(F.broadcast(ov), "ticker", "left")
            .withColumn("arch", F.expr(archetype_sql(override="_pin"))).drop("_pin"))


def with_first_exclusion(df: DataFrame) -> DataFrame:
    """Q8, first pass: ordered reasons a company cannot be valued."""
    empty = "size({}) = 0"
    return df.withColumn("why", F.expr(f"""CASE
      WHEN ({HYGIENE}) IS NOT NULL THEN ({HYGIENE})
      WHEN price IS NULL OR price = 0 THEN 'no price'
      WHEN shares IS NULL OR shares = 0 THEN 'no share count'
      WHEN form = '20-F' AND coalesce(dq_status, 'no_ext') = 'no_ext'
        THEN 'ADR: share count unverified'
      WHEN arch = 'standard' AND ({empty.format(overlap('revenue'))} OR {empty.format(overlap('cfo'))}
        OR {empty.format(overlap('capex'))}) THEN 'missing core financials (revenue/CFO/capex)'
      WHEN arch <> 'standard' AND ({empty.format(overlap('equity'))} OR {empty.format(overlap('net_income'))})
        THEN concat(arch, ': no book value / net income for RIM') END"""))


def company_inputs(companies: DataFrame, fin: DataFrame, now: DataFrame, betas: DataFrame,
                   rf: float, overrides: DataFrame, dq: DataFrame | None = None) -> DataFrame:
    """One row per company with every input the engines need; `why` tells who is left out.
    A share count that the cross-check of market caps corrected takes the place of the filed one."""
    df = companies.join(company_series(fin), "ticker", "left").join(now_map(now), "ticker", "left")
    df = df.join(betas.select("ticker", F.col("beta").alias("beta_in")), "ticker", "left")
    if dq is None:
        df = df.withColumn("dq_status", F.lit(None).cast("string"))
    else:
        checked = dq.select("ticker", F.col("status").alias("dq_status"), "shares_checked")
        df = df.join(checked, "ticker", "left").withColumn("shares_out", F.coalesce("shares_checked", "shares_out")).drop("shares_checked")
    df = with_archetype(df, overrides)

    def fresh(concept, old=None):
        return f"coalesce(now['{concept}'], {old or latest(concept)})"

    df = with_exprs(
        df, series="coalesce(series, array())", now="coalesce(now, map())",
        shares=f"coalesce(nullif(shares_out, 0D), {latest('shares')})")
    df = with_first_exclusion(df)
    df = with_exprs(
        df, rev_vol=revenue_volatility_sql(), g_trail=cagr_sql(),
        rev_now=fresh("revenue"), ebit_now=fresh("ebit"), ni_now=fresh("net_income"), cfo_now=fresh("cfo"),
        capex_now=fresh("capex"), dna=fresh("dep_amort"), div=f"coalesce({fresh('dividends')}, 0D)",
        equity_now=fresh("equity"), cash=f"coalesce({fresh('cash')}, 0D)",
        debt=f"coalesce({fresh('long_debt')}, 0D) + coalesce({fresh('short_debt')}, 0D)",
        leases=f"coalesce({fresh('op_leases')}, 0D)", interest=fresh("interest_exp"),
        tax_r=effective_tax_sql(), beta=f"coalesce(beta_in, {CFG['beta_default']}D)", mcap="price * shares",
        last_fy=f"get({overlap('revenue')}, size({overlap('revenue')}) - 1).fy")
    rev = overlap("revenue")
    df = with_exprs(df, rev_declining=f"coalesce(get({rev}, size({rev}) - 1).revenue < get({rev}, size({rev}) - 4).revenue, false)")
    df = with_exprs(df, cyclical=f"coalesce(rev_vol > {CYCLICAL_VOL}, false)", debt_risk="debt + leases")
    df = with_exprs(df, nyrs="if(cyclical, 10, 5)")
    df = with_exprs(df, window=last_n(overlap("revenue", "cfo", "capex"), "nyrs"), om=avg_ratio_sql("ebit", "revenue", "nyrs"))
    df = with_exprs(df, fcf_margin=mean_of("window", f"({FCF}) / x.revenue", "x.revenue <> 0"),
                    fcf_year=f"get(transform(window, x -> {FCF}), size(window) - 1)")
    df = with_exprs(
        df, fcf_norm="fcf_margin * rev_now",
        fcf_last="coalesce(now['cfo'] - now['capex'] - coalesce(now['sbc'], 0D), fcf_year)",
        g1=clamp("coalesce(g_trail, 0D)", f"{CFG['initial_growth_floor']}D", f"{CFG['initial_growth_cap']}D"),
        size_prem=size_premium_sql(), inv_cap="coalesce(equity_now, 0D) + debt - cash",
        rd=cost_of_debt_sql("interest", "debt", f"{rf}D"))
    df = with_exprs(df, re=f"{rf}D + beta * {CFG['equity_risk_premium']} + size_prem")
    df = with_exprs(
        df, wacc=wacc_sql(), roic="if(inv_cap > 0, ebit_now * (1 - tax_r) / inv_cap, NULL)",
        nopat_norm="if(rev_now <> 0, om * rev_now * (1 - tax_r), NULL)")
    df = with_exprs(df, roic_dcf="if(inv_cap > 0, nopat_norm / inv_cap, NULL)",
                    roe_avg=avg_ratio_sql("net_income", "equity", 5, True), roe_std=roe_std_sql(),
                    eq_assets=avg_ratio_sql("equity", "assets", 3, True),
                    base_fcf="if(fcf_norm > 0, fcf_norm, fcf_last)",
                    book_ps="if(equity_now <> 0, equity_now / shares, NULL)",
                    ffo_ps=f"if(arch = 'reit', nullif(get({FFO}, size({FFO}) - 1).ffo, 0D) / shares, NULL)")
    return df.drop("window", "fcf_year", "beta_in")


# ---- safety, capital, trends ----
def with_altman_z(df: DataFrame) -> DataFrame:
    """Null when any component is missing."""
    cur = {c: f"coalesce(now['{c}'], {latest(c)})" for c in ("assets", "liabilities", "assets_current", "liab_current", "retained")}
    df = with_exprs(df, _ta=cur["assets"], _tl=cur["liabilities"], _ac=cur["assets_current"], _lc=cur["liab_current"], _re=cur["retained"])
    df = with_exprs(df, _tl="coalesce(_tl, _ta - equity_now)")
    z = ("if(_ta > 0 AND _tl > 0, 1.2D * (_ac - _lc) / _ta + 1.4D * _re / _ta + 3.3D * ebit_now / _ta "
         "+ 0.6D * mcap / _tl + coalesce(rev_now, 0D) / _ta, NULL)")
    return with_exprs(df, altman_z=z).drop("_ta", "_tl", "_ac", "_lc", "_re")


def piotroski_sql():
    """M14 as an array of evaluated signals: true, false, or null where it cannot be told."""
    def two(*fields):
        return last_n(overlap(*fields), 2)

    def sig(fields, body, guard=None):
        pair = two(*fields)
        test = f"size(p) = 2{' AND ' + guard if guard else ''}"
        return f"get(transform(array({pair}), p -> if({test}, {body}, NULL)), 0)"

    def ratio_up(num, den, op=">"):
        return sig((num, den), f"p[1].{num} / p[1].{den} {op} p[0].{num} / p[0].{den}",
                   f"p[0].{den} <> 0 AND p[1].{den} <> 0")

    margin = f"if(size({two('gross_profit', 'revenue')}) = 2, {ratio_up('gross_profit', 'revenue')}, {ratio_up('ebit', 'revenue')})"
    return "array(" + ", ".join([
        sig(("net_income", "assets"), "p[1].net_income > 0"), ratio_up("net_income", "assets"),
        sig(("cfo", "net_income"), "p[1].cfo > 0"), sig(("cfo", "net_income"), "p[1].cfo > p[1].net_income"),
        ratio_up("long_debt", "assets", "<="), ratio_up("assets_current", "liab_current"),
        sig(("shares",), "p[1].shares <= p[0].shares * 1.005", "p[0].shares <> 0"), margin,
        ratio_up("revenue", "assets")]) + ")"


def with_piotroski(df: DataFrame) -> DataFrame:
    """(score, number evaluated); no score under five evaluated signals."""
    df = with_exprs(df, _sig=f"filter({piotroski_sql()}, s -> s IS NOT NULL)")
    return with_exprs(df, piotroski="if(size(_sig) >= 5, size(filter(_sig, s -> s)), NULL)",
                      piotroski_n="size(_sig)").drop("_sig")


def with_stale(df: DataFrame, today: str) -> DataFrame:
    """No filing covers the last nine months; by fiscal year when nothing is dated."""
    return with_exprs(df, stale=f"""CASE WHEN coalesce(fin_thru, any_thru) IS NOT NULL
      THEN coalesce(fin_thru, any_thru) < date_sub(DATE'{today}', 270)
      WHEN last_fy IS NOT NULL THEN last_fy < year(DATE'{today}') - 1 ELSE true END""")


def capital_panel(df: DataFrame) -> DataFrame:
    """ROIC, its spread over WACC, reinvestment and incremental ROIC."""
    pair = overlap("ebit", "equity")
    cap = "({0}.equity + coalesce({0}.long_debt, 0D) + coalesce({0}.short_debt, 0D) - coalesce({0}.cash, 0D))"
    df = with_exprs(df, _n=f"size({pair})", _a=f"get({pair}, greatest(size({pair}) - 5, 0))", _b=f"get({pair}, size({pair}) - 1)")
    df = with_exprs(df, _cap1=cap.format("_b"), _add=f"{cap.format('_b')} - {cap.format('_a')}")
    ok = "if(roic_dcf > 0, {}, NULL)"
    return with_exprs(
        df, cap_roic=ok.format("roic_dcf"), cap_spread=ok.format("roic_dcf - wacc"),
        cap_reinvest=ok.format(clamp("coalesce(g1, 0D) / roic_dcf", "0D", f"{REINVEST_CAP}D")),
        cap_inc_roic=ok.format("if(_n >= 3 AND _add > 0 AND _add > 0.02D * abs(_cap1), "
                               "(_b.ebit - _a.ebit) * (1 - tax_r) / _add, NULL)")
    ).drop("_n", "_a", "_b", "_cap1", "_add")


TRENDS = {  # fixed values: the five trend lines and their unit
    "revenueB": "x.revenue / 1e9D", "opMargin": "if(x.revenue <> 0, x.ebit / x.revenue, NULL)",
    "fcfB": f"({FCF}) / 1e9D", "equityB": "x.equity / 1e9D", "sharesM": "x.shares / 1e6D"}


def trends(df: DataFrame, years=8) -> DataFrame:
    """Arrays over the last revenue years, gaps kept as nulls."""
    win = last_n(overlap("revenue"), years)
    fields = ", ".join(f"'{k}', transform({win}, x -> round({v}, 3))" for k, v in TRENDS.items())
    return with_exprs(df, trends=f"named_struct('years', transform({win}, x -> x.fy), {fields})")


def trend_change_sql(arr):
    """Last over first non-null point, less one."""
    v = f"filter({arr}, x -> x IS NOT NULL)"
    return f"if(size({v}) >= 2, try_divide(get({v}, size({v}) - 1), get({v}, 0)) - 1, NULL)"


def with_trend_change(df: DataFrame) -> DataFrame:
    return with_exprs(df, **{f"{k}_chg": trend_change_sql(f"trends.{k}") for k in TRENDS})


def with_multiples(df: DataFrame) -> DataFrame:
    """Multiples; enterprise measures only where the effective archetype is standard."""
    std = "if(eff_arch = 'standard' AND {}, {}, NULL)"
    df = with_exprs(df, _ebitda="coalesce(ebit_now, 0D) + coalesce(dna, 0D)", _nips="coalesce(ni_now, 0D) / shares")
    return with_exprs(
        df, pe="if(_nips > 0, price / _nips, NULL)",
        evebitda=std.format("_ebitda > 0", "(mcap + debt - cash) / _ebitda"),
        fcfy=std.format("mcap <> 0", "base_fcf / mcap"), div_yield="if(mcap <> 0, div / mcap, NULL)",
        nde=std.format("_ebitda > 0", "(debt_risk - cash) / _ebitda")).drop("_ebitda", "_nips")


INFO_FLAGS = ["Cyclical revenue", "REIT: RIM on book, not FFO/NAV"]  # fixed values: shown, not penalized
STRUCTURE_RISK = ["PDD"]  # fixed value


def with_trap_flags(df: DataFrame) -> DataFrame:
    """Ordered warnings."""
    ebitda = "(coalesce(ebit_now, 0D) + coalesce(dna, 0D))"
    std = "arch = 'standard'"
    risky = ", ".join(f"'{t}'" for t in STRUCTURE_RISK)
    rules = [
        ("rev_declining", "'Declining revenue 3y'"),
        (f"{std} AND coalesce(fcf_norm, 0D) <= 0 AND coalesce(fcf_last, 0D) <= 0", "'Negative FCF'"),
        (f"{std} AND {ebitda} > 0 AND (debt_risk - cash) > 3.5D * {ebitda}", "'High leverage'"),
        ("equity_now < 0", "'Negative book value'"),
        (f"{std} AND ni_now <> 0 AND cfo_now <> 0 AND ni_now > cfo_now * 1.2D", "'High accruals'"),
        ("altman_z < 1.81D", "'Altman-Z: distress'"),
        ("piotroski <= 3", "concat('Piotroski ', piotroski, '/9')"),
        ("cyclical", f"'{INFO_FLAGS[0]}'"),
        (f"ticker IN ({risky})", "'VIE/ADR structure'"),
        ("mcap < min_mcap", "'Suspect share count'"),
        ("arch = 'reit' AND ffo IS NULL", f"'{INFO_FLAGS[1]}'"),
        ("stale", "'Stale filings'")]
    items = ", ".join(f"CASE WHEN {test} THEN {label} END" for test, label in rules)
    return with_exprs(df, flags=f"array_compact(array({items}))")
