from .base import sql, view
from . import entities  # noqa: F401  (views)

RF = 0.043
view("yr", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS rn, count(*) OVER (PARTITION BY ticker) AS n, "
           "revenue / lag(revenue) OVER (PARTITION BY ticker ORDER BY fiscal_year) - 1 AS gr FROM fw")
view("vol", """SELECT ticker, CASE WHEN count(gr) FILTER (rn <= 6) >= 3 THEN stddev_pop(gr) FILTER (rn <= 6) END AS vol FROM yr GROUP BY 1""")
view("cs", f"""SELECT ticker, max(fiscal_year) AS last_fy, max(n) AS n, any_value(vol) AS vol, any_value(nyrs) AS nyrs,
  max(fiscal_year) - max(CASE WHEN rn = least(n, 6) THEN fiscal_year END) AS span,
  power(max(CASE WHEN rn = 1 THEN revenue END) / max(CASE WHEN rn = least(n, 6) THEN revenue END),
    1.0 / nullif(max(fiscal_year) - max(CASE WHEN rn = least(n, 6) THEN fiscal_year END), 0)) - 1 AS g_trail,
  avg(ebit / revenue) FILTER (rn <= nyrs) AS om, avg((cfo - capex - sbc) / revenue) FILTER (rn <= nyrs) AS fcf_margin,
  avg(net_income / equity) FILTER (rn <= 5) AS roe_avg, CASE WHEN max(n) >= 3 THEN stddev_pop(net_income / equity) FILTER (rn <= 6) END AS roe_std,
  avg(equity / assets) FILTER (rn <= 3) AS eq_assets,
  CASE WHEN count(*) FILTER (rn <= 3 AND pretax > 0 AND tax_exp > 0) = 0 THEN 0.21 ELSE
    greatest(0.10, least(0.35, avg(tax_exp / pretax) FILTER (rn <= 3 AND pretax > 0 AND tax_exp > 0))) END::DOUBLE AS tax_r,
  {", ".join(f"max(CASE WHEN rn = 1 THEN {c} END) AS {c}" for c in
             "revenue ebit net_income cfo capex sbc dep_amort equity cash long_debt short_debt op_leases interest_exp assets liabilities assets_current liab_current retained gross_profit shares gain_sale re_impair".split())},
  arg_max(dividends, fiscal_year) FILTER (dividends IS NOT NULL) AS dividends
  FROM (SELECT yr.*, vol, CASE WHEN vol > 0.18 THEN 10 ELSE 5 END AS nyrs FROM yr JOIN vol USING (ticker)) GROUP BY 1""")
NOWC = "revenue ebit net_income cfo capex sbc cash equity assets".split()
view("nw", "SELECT ticker, max(thru) AS thru, " + ", ".join(f"max(value) FILTER (concept = '{c}') AS n_{c}" for c in NOWC) + " FROM now_t GROUP BY 1")
view("ci0", f"""SELECT c.ticker, c.name, c.sector, c.sic, c.form, c.cik, c.price, coalesce(CASE WHEN x.status IN ('derived', 'patched') THEN x.ext_mcap / x.price ELSE c.shares_out END, cs.shares) AS shares,
  CASE c.sector WHEN 'Financials' THEN 'financial' WHEN 'Real Estate' THEN 'reit' ELSE 'standard' END AS arch, cs.* EXCLUDE (ticker, shares), nw.thru,
  {", ".join(f"coalesce(n_{c}, cs.{c}) AS {c}_now" for c in "revenue ebit net_income cfo capex equity assets".split())},
  coalesce(n_cash, cs.cash, 0) AS cash_now, cs.long_debt + cs.short_debt AS debt, coalesce(cs.dividends, 0) AS div, coalesce(b.beta, 1.0) AS beta,
  CASE WHEN n_cfo IS NOT NULL THEN n_cfo - n_capex - n_sbc ELSE cs.cfo - cs.capex - cs.sbc END AS fcf_last, x.status
  FROM comp c LEFT JOIN cs USING (ticker) LEFT JOIN nw USING (ticker) LEFT JOIN cbeta b USING (ticker) LEFT JOIN xck x USING (ticker)""")
view("ci1", f"""SELECT *, price * shares AS mcap, debt + op_leases AS debt_risk, greatest(0, least(0.20, coalesce(g_trail, 0))) AS g1,
  fcf_margin * revenue_now AS fcf_norm, equity_now + debt - cash_now AS inv_cap, vol > 0.18 AS cyc,
  CASE WHEN interest_exp > 0 AND debt > 0 THEN greatest({RF} + 0.005, least(0.15, interest_exp / debt)) ELSE {RF} + 0.01 END AS rd,
  CASE WHEN price > 0 AND price < 1 THEN 'sub-$1 share price (L0 hygiene)' WHEN price IS NULL THEN 'no price' WHEN shares IS NULL THEN 'no share count'
    WHEN form = '20-F' AND coalesce(status, 'no_ext') = 'no_ext' THEN 'ADR: share count unverified'
    WHEN revenue IS NULL THEN 'missing core financials (revenue/CFO/capex)' END AS why FROM ci0""")
view("ci2", f"""SELECT *, CASE WHEN mcap >= 10e9 THEN 0 WHEN mcap >= 2e9 THEN 0.003 WHEN mcap >= 0.5e9 THEN 0.008 WHEN mcap > 0 THEN 0.015 ELSE 0 END::DOUBLE AS size_prem FROM ci1""")
view("ci3", f"""SELECT *, {RF} + beta * 0.05 + size_prem AS re, om * revenue_now * (1 - tax_r) AS nopat_norm,
  CASE WHEN inv_cap > 0 THEN ebit_now * (1 - tax_r) / inv_cap END AS roic,
  CASE WHEN inv_cap > 0 THEN om * revenue_now * (1 - tax_r) / inv_cap END AS roic_dcf,
  CASE WHEN fcf_norm > 0 THEN fcf_norm ELSE fcf_last END AS base_fcf, equity_now / shares AS book_ps FROM ci2""")
view("ci", "SELECT *, mcap / (mcap + debt) * re + debt / (mcap + debt) * rd * (1 - tax_r) AS wacc FROM ci3")
view("y2", "SELECT a.*, " + ", ".join(f"p.{c} AS p_{c}" for c in "net_income assets long_debt assets_current liab_current shares gross_profit revenue".split())
     + " FROM (SELECT * FROM yr WHERE rn = 1 AND n >= 2) a JOIN (SELECT * FROM yr WHERE rn = 2) p USING (ticker)")
view("pio", """SELECT ticker, (net_income > 0)::INT + (net_income / assets > p_net_income / p_assets)::INT + (cfo > 0)::INT + (cfo > net_income)::INT
  + (long_debt / assets <= p_long_debt / p_assets)::INT + (assets_current / liab_current > p_assets_current / p_liab_current)::INT
  + (shares <= p_shares * 1.005)::INT + (gross_profit / revenue > p_gross_profit / p_revenue)::INT + (revenue / assets > p_revenue / p_assets)::INT AS score, 9 AS n FROM y2""")
view("alt", """SELECT ticker, CASE WHEN assets_now > 0 AND liabilities > 0 THEN 1.2 * (assets_current - liab_current) / assets_now + 1.4 * retained / assets_now
  + 3.3 * ebit_now / assets_now + 0.6 * mcap / liabilities + revenue_now / assets_now END AS z FROM ci""")
view("capx", """SELECT ticker, a.ebit AS ebit_a, b.ebit AS ebit_b, a.equity + a.long_debt + a.short_debt - a.cash AS ic_a,
  b.equity + b.long_debt + b.short_debt - b.cash AS ic_b, b.n FROM (SELECT * FROM yr WHERE rn = 1) b JOIN (SELECT * FROM yr WHERE rn = least(n, 5)) a USING (ticker)""")

SQL = {
    "company_wide": sql("""SELECT ticker, fiscal_year, round(revenue / 999983.0::DOUBLE, 6) AS revenue_m, round(equity / 999983.0::DOUBLE, 6) AS equity_m,
      round(re_impair / 999983.0::DOUBLE, 6) AS impair_m, round(shares / 999983.0::DOUBLE, 6) AS shares_m FROM fw"""),
    "latest_of_series": sql("""SELECT ticker, concept, fiscal_year, round(value / 999983.0::DOUBLE, 6) AS value_m FROM fin
      QUALIFY row_number() OVER (PARTITION BY ticker, concept ORDER BY fiscal_year DESC) = 1"""),
    "revenue_cagr": sql("""WITH e AS (SELECT ticker, max(CASE WHEN rn = 1 THEN ebit END) AS eb, max(CASE WHEN rn = least(n, 4) THEN ebit END) AS ea,
      max(fiscal_year) - max(CASE WHEN rn = least(n, 4) THEN fiscal_year END) AS sp FROM yr GROUP BY 1)
      SELECT ticker, round(g_trail, 6) AS cagr, round(CASE WHEN ea > 0 AND eb > 0 AND sp > 0 THEN power(eb / ea, 1.0 / sp) - 1 END, 6) AS cagr_ebit FROM cs JOIN e USING (ticker)"""),
    "mean_margin": sql("""SELECT ticker, round(avg(ebit / revenue) FILTER (rn <= 5), 6) AS m5, round(avg(ebit / revenue) FILTER (rn <= 10), 6) AS m10 FROM yr GROUP BY 1"""),
    "roe_metrics": sql("SELECT ticker, round(roe_avg, 6) AS roe, round(roe_std, 6) AS roe_std, round(eq_assets, 6) AS eq_assets FROM cs"),
    "effective_tax": sql("SELECT ticker, round(tax_r, 6) AS tax FROM cs"),
    "discount_rates": sql("SELECT ticker, round(size_prem, 4) AS size_prem, round(rd, 6) AS rd, round(re, 6) AS re, round(wacc, 6) AS wacc FROM ci WHERE why IS NULL"),
    "revenue_volatility": sql("SELECT ticker, round(vol, 6) AS vol, coalesce(vol > 0.18, false)::INT AS cyclical FROM vol"),
    "normalized_fcf": sql("SELECT ticker, round(fcf_margin, 6) AS fcf_margin, round(fcf_norm / 999983.0::DOUBLE, 5) AS fcf_norm_m, round(fcf_last / 999983.0::DOUBLE, 5) AS fcf_last_m FROM ci WHERE why IS NULL"),
    "company_inputs": sql("""SELECT ticker, arch, why, round(revenue_now / 999983.0::DOUBLE, 5) AS rev_m, round(coalesce(debt, 0) / 999983.0::DOUBLE, 5) AS debt_m,
      round(coalesce(debt_risk, 0) / 999983.0::DOUBLE, 5) AS risk_m, round(coalesce(cash_now, 0) / 999983.0::DOUBLE, 5) AS cash_m, round(mcap / 999983.0::DOUBLE, 5) AS mcap_m, round(div / 999983.0::DOUBLE, 5) AS div_m,
      round(g1, 6) AS g1, round(beta, 3) AS beta FROM ci"""),
    "excluded_first_pass": sql("SELECT why, count(*) AS n FROM ci WHERE why IS NOT NULL GROUP BY 1"),
    "returns_on_capital": sql("SELECT ticker, round(roic, 6) AS roic, round(nopat_norm / 999983.0::DOUBLE, 5) AS nopat_m, round(roic_dcf, 6) AS roic_dcf FROM ci WHERE why IS NULL"),
    "ffo_series": sql("SELECT ticker, fiscal_year AS fy, round((net_income + dep_amort - coalesce(gain_sale, 0) + coalesce(re_impair, 0)) / 999983.0::DOUBLE, 6) AS ffo_m FROM fw"),
    "altman_z": sql("SELECT ticker, round(z, 4) AS altman_z FROM alt JOIN ci USING (ticker) WHERE why IS NULL"),
    "piotroski_score": sql("SELECT cs.ticker, score::DOUBLE AS piotroski, coalesce(pio.n, 0)::DOUBLE AS piotroski_n FROM cs LEFT JOIN pio USING (ticker)"),
    "stale_filings": sql("""SELECT ticker, CASE WHEN thru IS NOT NULL THEN thru < DATE '2001-12-31' - 270 WHEN last_fy IS NOT NULL THEN last_fy < 2000 ELSE true END::INT AS stale FROM ci"""),
    "capital_panel": sql("""SELECT ticker, round(CASE WHEN roic_dcf > 0 THEN roic_dcf END, 4) AS cap_roic, round(CASE WHEN roic_dcf > 0 THEN roic_dcf - wacc END, 4) AS cap_spread,
      round(CASE WHEN roic_dcf > 0 THEN greatest(0, least(0.9, g1 / roic_dcf)) END, 4) AS cap_reinvest,
      round(CASE WHEN roic_dcf > 0 AND capx.n >= 3 AND ic_b - ic_a > 0 AND ic_b - ic_a > 0.02 * abs(ic_b) THEN (ebit_b - ebit_a) * (1 - tax_r) / (ic_b - ic_a) END, 4) AS cap_inc_roic
      FROM ci JOIN capx USING (ticker) WHERE why IS NULL"""),
    "trend_arrays": sql("""WITH t AS (SELECT ticker, fiscal_year, n, rn, round(revenue / 1e9, 3) AS r, round(ebit / revenue, 3) AS o, round(shares / 999983.0::DOUBLE, 3) AS s FROM yr WHERE rn <= 8),
      a AS (SELECT ticker, string_agg(fiscal_year::VARCHAR, ',' ORDER BY fiscal_year) AS years, 0 AS gaps, arg_max(r, fiscal_year) AS last_rev, max(n) AS n,
      arg_min(r, fiscal_year) AS r0, arg_min(o, fiscal_year) AS o0, arg_max(o, fiscal_year) AS o1, arg_min(s, fiscal_year) AS s0, arg_max(s, fiscal_year) AS s1 FROM t GROUP BY 1)
      SELECT ticker, years, gaps, last_rev, round(CASE WHEN n >= 2 AND r0 <> 0 THEN last_rev / r0 - 1 END, 3) AS "revenueB_chg",
      round(CASE WHEN n >= 2 AND o0 <> 0 THEN o1 / o0 - 1 END, 3) AS "opMargin_chg", round(CASE WHEN n >= 2 THEN s1 / s0 - 1 END, 3) AS "sharesM_chg" FROM a"""),
}
