from equispan.assumptions import load
from .base import sql, view
from . import metrics  # noqa: F401  (views)

TG = "0.025::DOUBLE"


def grow(g, k="k"):
    return f"(CASE WHEN {k} <= 5 THEN {g} ELSE {g} + ({TG} - {g}) * ({k} - 5) / 5 END)"


def pv_fcf(f, w, g):
    lv = f"list_product([1 + {grow(g)} for k in range(1, t + 1)])"
    end = f"list_product([1 + {grow(g)} for k in range(1, 11)])"
    return (f"({f} * (list_sum([{lv} / pow(1 + {w}, t) for t in range(1, 11)]) + {end} * (1 + {TG}) / ({w} - {TG}) / pow(1 + {w}, 10)))")


def pv_nopat(n, r, w, g):
    lv = f"list_product([1 + {grow(g)} for k in range(1, t + 1)])"
    end = f"list_product([1 + {grow(g)} for k in range(1, 11)])"
    return (f"({n} * (list_sum([{lv} * (1 - greatest(0, least(0.9, {grow(g, 't')} / {r}))) / pow(1 + {w}, t) for t in range(1, 11)]) "
            f"+ {end} * (1 + {TG}) * (1 - greatest(0, least(0.9, {TG} / {r}))) / ({w} - {TG}) / pow(1 + {w}, 10)))")


def ev(w="wacc", g="g1", n="nopat_norm"):
    return f"(CASE WHEN {n} > 0 AND roic_dcf > 0 THEN {pv_nopat(n, 'roic_dcf', w, g)} WHEN base_fcf > 0 THEN {pv_fcf('base_fcf', w, g)} END)"


def pos(x):
    return f"(CASE WHEN {x} > 0 THEN {x} END)"


view("vl", """SELECT *, (book_ps > 0 AND book_ps / price >= 0.15 AND roe_avg <= 0.40) AS rim_ok FROM ci WHERE why IS NULL""")
view("ve", """SELECT *, CASE WHEN arch = 'financial' AND NOT rim_ok AND base_fcf > 0 AND base_fcf / mcap <= 0.06 THEN 'standard' ELSE arch END AS eff_arch,
  (CASE WHEN arch = 'reit' THEN net_income + dep_amort - coalesce(gain_sale, 0) + coalesce(re_impair, 0) END) / shares AS ffo_ps FROM vl""")
view("vdcf", f"SELECT ticker, CASE WHEN wacc - {TG} >= 0.015 THEN ({ev()} - (debt - cash_now)) / shares END AS ps FROM ve")
view("bis0", f"""SELECT ticker, base_fcf, wacc, debt - cash_now AS nd, mcap, nopat_norm, roic_dcf, nopat_norm > 0 AND roic_dcf > 0 AS prof,
  {ev(g='-0.30::DOUBLE')} - (debt - cash_now) AS e0, {ev(g='0.80::DOUBLE')} - (debt - cash_now) AS e1 FROM ve
  WHERE wacc - {TG} >= 0.015 AND NOT (nopat_norm > 0 AND roic_dcf > 0 AND roic_dcf <= wacc)""")
view("bis", f"""SELECT ticker, base_fcf, wacc, nd, mcap, nopat_norm, roic_dcf, -0.30::DOUBLE AS lo, 0.80::DOUBLE AS hi, 0.25::DOUBLE AS g1, 0 AS i FROM bis0
  WHERE e1 > e0 AND e0 <= mcap AND e1 >= mcap
  UNION ALL SELECT ticker, base_fcf, wacc, nd, mcap, nopat_norm, roic_dcf, lo2, hi2, (lo2 + hi2) / 2, i + 1 FROM (SELECT *,
  CASE WHEN up THEN lo ELSE g1 END AS lo2, CASE WHEN up THEN g1 ELSE hi END AS hi2 FROM (SELECT *, {ev()} - nd > mcap AS up FROM bis WHERE i < 50))""")
view("vimp", """SELECT ve.ticker, CASE WHEN e1 > e0 AND e0 > mcap0 THEN -0.3::DOUBLE WHEN e1 > e0 AND e1 < mcap0 THEN 0.8::DOUBLE ELSE g END AS g,
  CASE WHEN e1 > e0 AND e0 > mcap0 THEN '<' WHEN e1 > e0 AND e1 < mcap0 THEN '>' WHEN g IS NOT NULL THEN '=' END AS op
  FROM ve LEFT JOIN (SELECT ticker, e0, e1, mcap AS mcap0 FROM bis0) b USING (ticker) LEFT JOIN (SELECT ticker, g1 AS g FROM bis WHERE i = 50) s USING (ticker)""")
view("vepv", """SELECT ticker, CASE WHEN om * revenue_now > 0 THEN ((om * revenue_now * (1 - tax_r) + dep_amort - least(capex_now, dep_amort)) / wacc + cash_now - debt) / shares END AS ps FROM ve""")
view("vrim", """SELECT ticker, CASE WHEN rim_ok AND eff_arch <> 'standard' THEN book_ps + list_sum([(roe_avg - re) * book_ps * pow(0.62, t - 1) / pow(1 + re, t) for t in range(1, 11)])
  + (roe_avg - re) * book_ps * pow(0.62, 10) / (1 + re - 0.62) / pow(1 + re, 10) END AS ps FROM ve""")
view("vddm", f"""SELECT ticker, CASE WHEN div > 0 AND div / shares / price >= 0.01 AND (eff_arch = 'reit' OR (net_income_now > 0 AND div <= net_income_now * 1.5)) AND re - {TG} >= 0.005
  THEN {pv_fcf('(div / shares)', 're', 'least(0.08, g1)')} END AS ps FROM ve""")
T = load()
view("sicb", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in T["subsector_by_sic"].items()) + ") t(sic, bucket)")
view("vu", """SELECT universe, ve.*, dcf.ps AS dcf0, epv.ps AS epv0, rim.ps AS rim0, ddm.ps AS ddm_ps, imp.g AS imp0, imp.op AS op0,
  (mcap + debt - cash_now) / ebit_now AS ev_ebit, arch = 'standard' AND ebit_now > 0 AND mcap + debt - cash_now > 0 AS fit_ok, coalesce(roic_dcf, roic, 0) AS fr
  FROM ve JOIN umem USING (ticker) JOIN vdcf dcf USING (ticker) JOIN vepv epv USING (ticker) JOIN vrim rim USING (ticker) JOIN vddm ddm USING (ticker) JOIN vimp imp USING (ticker)""")
view("vdims", """SELECT universe, ticker, eff_arch = 'standard' AS std, unnest(CASE WHEN eff_arch = 'standard' THEN ['om', 'roe', 'roic', 'fcfm', 'lev'] ELSE ['roe', 'stab', 'cap'] END) AS dim,
  unnest(CASE WHEN eff_arch = 'standard' THEN [om, roe_avg, roic, fcf_margin, CASE WHEN ebit_now > 0 THEN -(debt_risk - cash_now) / ebit_now END] ELSE [roe_avg, -roe_std, eq_assets] END) AS val FROM vu""")
view("vq0", """SELECT universe, ticker, avg(pr) AS mr FROM (SELECT *, cume_dist() OVER (PARTITION BY universe, std, dim ORDER BY val) AS pr FROM vdims WHERE val IS NOT NULL) GROUP BY 1, 2""")
view("vq", """SELECT vu.*, CASE WHEN eff_arch = 'standard' OR count(*) OVER (PARTITION BY universe, eff_arch = 'standard') >= 5 THEN round_even(round(100 * mr, 9), 0)::INT END AS quality0
  FROM vu LEFT JOIN vq0 USING (universe, ticker)""")
view("vb", """SELECT *, CASE WHEN rb = sector OR cnt >= 8 THEN rb ELSE sector END AS wbucket FROM (SELECT *, count(*) FILTER (fit_ok) OVER (PARTITION BY universe, rb) AS cnt FROM
  (SELECT vq.*, CASE WHEN sector = 'Information Technology' THEN coalesce(bucket, sector) ELSE sector END AS rb FROM vq LEFT JOIN sicb USING (sic)))""")
view("vfit", """SELECT universe, wbucket, greatest(5, least(60, ev_ebit)) AS y, greatest(0, least(0.3, g1)) AS g, greatest(0, least(0.6, coalesce(om, 0))) AS m,
  greatest(0, least(0.5, fr)) AS r FROM vb WHERE fit_ok""")
view("vanch", """SELECT universe, wbucket AS scope, least(28, median(y)) AS a_y, median(g) AS a_g, median(m) AS a_m, median(r) AS a_r FROM vfit GROUP BY 1, 2 HAVING count(*) >= 3
  UNION ALL SELECT universe, '*', least(28, median(y)), median(g), median(m), median(r) FROM vfit GROUP BY 1""")
A = ", ".join(f"coalesce(o.a_{c}, z.a_{c}) AS a_{c}" for c in "ygmr")


def anchored(t):
    return (f"SELECT t.*, {A} FROM {t} t LEFT JOIN vanch o ON o.universe = t.universe AND o.scope = t.wbucket "
            "LEFT JOIN vanch z ON z.universe = t.universe AND z.scope = '*'")


view("vols", f"""SELECT universe, count(*) AS n, sum((g-a_g)*(g-a_g)) AS a, sum((g-a_g)*(m-a_m)) AS b, sum((g-a_g)*(r-a_r)) AS c, sum((m-a_m)*(m-a_m)) AS d,
  sum((m-a_m)*(r-a_r)) AS e, sum((r-a_r)*(r-a_r)) AS f, sum((g-a_g)*(y-a_y)) AS p, sum((m-a_m)*(y-a_y)) AS q, sum((r-a_r)*(y-a_y)) AS s FROM ({anchored('vfit')}) GROUP BY 1""")
DET = "(a*(d*f-e*e) - b*(b*f-e*c) + c*(b*e-d*c))"
view("vcoef", f"""SELECT universe, n, greatest(0, (p*(d*f-e*e) - b*(q*f-e*s) + c*(q*e-d*s)) / {DET}) AS c_g, greatest(0, (a*(q*f-e*s) - p*(b*f-e*c) + c*(b*s-q*c)) / {DET}) AS c_m,
  greatest(0, (a*(d*s-q*e) - b*(b*s-q*c) + p*(b*e-d*c)) / {DET}) AS c_r FROM vols""")
view("vpffo", "SELECT universe, greatest(8, least(20, median(price / ffo_ps))) AS anchor FROM vu WHERE eff_arch = 'reit' AND ffo_ps > 0 GROUP BY 1 HAVING count(*) >= 5")
view("vw", f"""SELECT w.*, CASE WHEN ebit_now > 0 THEN (greatest(4, least(40, a_y + c_g * (g1 - a_g) + c_m * (greatest(0, least(0.6, coalesce(om, 0))) - a_m)
  + c_r * (greatest(0, least(0.5, fr)) - a_r))) * ebit_now - debt + cash_now) / shares END AS warr0, CASE WHEN eff_arch = 'reit' AND ffo_ps > 0 THEN anchor * ffo_ps END AS ffo
  FROM ({anchored('vb')}) w LEFT JOIN vcoef USING (universe) LEFT JOIN vpffo USING (universe)""")
S = "eff_arch = 'standard'"
view("vg", f"""SELECT *, CASE WHEN {S} THEN dcf_v END AS dcf_ps, CASE WHEN {S} THEN epv0 END AS epv_ps, CASE WHEN {S} THEN warr0 END AS warr_ps, CASE WHEN {S} THEN imp0 END AS implied_g,
  CASE WHEN {S} THEN op0 END AS implied_op, CASE WHEN ffo IS NULL THEN rim0 END AS rim_ps, CASE WHEN {S} THEN pscore END AS pio_score, CASE WHEN {S} THEN z END AS alt_z,
  0.10 + (1 - coalesce(quality0, 50) / 100::DOUBLE) * 0.30 + CASE WHEN cyc THEN 0.10 ELSE 0 END AS band
  FROM (SELECT *, CASE WHEN dcf0 > 0 THEN dcf0 END AS dcf_v FROM vw) LEFT JOIN (SELECT ticker, score AS pscore FROM pio) USING (ticker) LEFT JOIN (SELECT ticker, z FROM alt) USING (ticker)""")
M = [("dcf_ps", 0.10), ("rim_ps", 0.35), ("warr_ps", 0.30), ("ffo", 0.30), ("ddm_ps", 0.10)]
view("vm", f"""SELECT *, ({" + ".join(f"({c} > 0 AND {c} IS NOT NULL)::INT" for c, _ in M)}) AS nm,
  coalesce(({" + ".join(f"coalesce(CASE WHEN {c} > 0 THEN {c} * {w} END, 0)" for c, w in M)}) / nullif({" + ".join(f"(CASE WHEN {c} > 0 THEN {w} ELSE 0 END)" for c, w in M)}, 0), {pos('epv_ps')}) AS mid FROM vg""")
view("vt0", f"""SELECT *, least({", ".join(pos(c) for c, _ in M)}, {pos('epv_ps')}) AS low, greatest({", ".join(pos(c) for c, _ in M)}, {pos('epv_ps')}, mid * (1 + band)) AS high,
  mid / price - 1 AS upside, {" + ".join(f"coalesce(({c} > 0 AND abs({c} / mid - 1) <= 0.10)::INT, 0)" for c, _ in M)} AS within FROM vm""")
view("vt", """SELECT *, CASE WHEN nm < 2 THEN 2 WHEN within / nm >= 0.99 THEN 5 WHEN within / nm >= 0.66 THEN 4 WHEN within / nm >= 0.5 THEN 3 ELSE 2 END AS conf,
  CASE WHEN mid IS NULL THEN CASE arch WHEN 'financial' THEN 'financial: RIM only, and book value/ROE not usable'
    WHEN 'reit' THEN 'reit: unpriceable, no positive FFO base and book unusable' ELSE 'no positive FCF/earnings base (GAAP loss-maker)' END
  WHEN form = '20-F' AND NOT (mid >= price / 10 AND mid <= price * 10) THEN 'ADR: per-share value failed the 10x sanity bound' END AS why2 FROM vt0""")
view("r3", "SELECT a.ticker, a.revenue < b.revenue AS decl FROM (SELECT * FROM yr WHERE rn = 1) a JOIN (SELECT * FROM yr WHERE rn = 4) b USING (ticker)")
view("cmom", """WITH h AS (SELECT universe, u.ticker, month, adjclose, max(month) OVER (PARTITION BY universe) AS top FROM umem u
  JOIN pxm p ON p.ticker = (1 + (u.ticker::BIGINT - 1) % (SELECT max(s_suppkey) FROM supplier))::VARCHAR),
  m AS (SELECT universe, ticker, max(adjclose) FILTER (month = top - INTERVAL 1 MONTH) / max(adjclose) FILTER (month = top - INTERVAL 12 MONTH) - 1 AS mom FROM h GROUP BY 1, 2)
  SELECT universe, ticker, mom, round_even(round(100 * cume_dist() OVER (PARTITION BY universe ORDER BY mom), 9), 0)::INT AS mom_pct FROM m WHERE mom IS NOT NULL""")
view("vf", f"""SELECT vt.*, list_filter([CASE WHEN decl THEN 'Declining revenue 3y' END,
  CASE WHEN arch = 'standard' AND coalesce(fcf_norm, 0) <= 0 AND coalesce(fcf_last, 0) <= 0 THEN 'Negative FCF' END,
  CASE WHEN arch = 'standard' AND ebit_now + dep_amort > 0 AND (debt_risk - cash_now) / (ebit_now + dep_amort) > 3.5 THEN 'High leverage' END,
  CASE WHEN equity_now < 0 THEN 'Negative book value' END, CASE WHEN arch = 'standard' AND net_income_now > cfo_now * 1.2 THEN 'High accruals' END,
  CASE WHEN alt_z < 1.81 THEN 'Altman-Z: distress' END, CASE WHEN pio_score <= 3 THEN 'Piotroski ' || pio_score || '/9' END,
  CASE WHEN cyc THEN 'Cyclical revenue' END, CASE WHEN mcap < CASE universe WHEN 'sp500' THEN 3e9 ELSE 0.3e9 END THEN 'Suspect share count' END,
  CASE WHEN arch = 'reit' AND ffo IS NULL THEN 'REIT: RIM on book, not FFO/NAV' END,
  CASE WHEN CASE WHEN thru IS NOT NULL THEN thru < DATE '2001-12-31' - 270 ELSE last_fy < 2000 END THEN 'Stale filings' END], lambda s: s IS NOT NULL) AS flags,
  coalesce(nullif(quality0, 0), 50) AS quality, mom_pct, mom FROM vt LEFT JOIN r3 USING (ticker) LEFT JOIN cmom USING (universe, ticker)""")
view("bd", """SELECT *, (greatest(-0.5, least(0.6, upside)) + 0.5) * (conf / 5) * (quality / 100) *
  pow(0.85, len(list_filter(flags, lambda s: s NOT IN ('Cyclical revenue', 'REIT: RIM on book, not FFO/NAV')))) AS score,
  CASE WHEN net_income_now > 0 THEN price / (net_income_now / shares) END AS pe,
  CASE WHEN eff_arch = 'standard' AND ebit_now + dep_amort > 0 THEN (mcap + debt - cash_now) / (ebit_now + dep_amort) END AS evebitda,
  CASE WHEN eff_arch = 'standard' THEN base_fcf / mcap END AS fcfy, div / mcap AS div_yield,
  CASE WHEN eff_arch = 'standard' AND ebit_now + dep_amort > 0 THEN (debt_risk - cash_now) / (ebit_now + dep_amort) END AS nde FROM vf WHERE why2 IS NULL""")
view("gone", "SELECT universe, ticker, why FROM ci JOIN umem USING (ticker) WHERE why IS NOT NULL UNION ALL SELECT universe, ticker, why2 FROM vt WHERE why2 IS NOT NULL")
view("sc0", """SELECT *, least(2.0, greatest(1.0, band / 0.10)) AS u FROM bd""")
view("sc1", f"""SELECT * REPLACE (nopat_norm AS nopat_norm), least(0.5, 0.010 * u / greatest(coalesce(nullif(om, 0), 0.05), 0.05)) AS rel, greatest(wacc - 0.004 * u, {TG} + 0.015 + 0.005) AS wu, wacc + 0.004 * u AS wd,
  least(g1 + 0.015 * u, 0.30) AS gu, greatest(g1 - 0.015 * u, -0.05) AS gd FROM sc0 WHERE dcf_ps > 0 AND nopat_norm > 0 AND roic_dcf > 0""")
view("sc2", f"""SELECT *, (({pv_nopat('(nopat_norm * (1 + rel))', 'roic_dcf', 'wu', 'gu')}) - (debt - cash_now)) / shares AS up_ps,
  CASE WHEN wd - {TG} >= 0.015 THEN (({pv_nopat('(nopat_norm * (1 - rel))', 'roic_dcf', 'wd', 'gd')}) - (debt - cash_now)) / shares END AS dn_ps FROM sc1""")
view("sc3", """SELECT universe, ticker, price, mid, epv_ps, CASE WHEN up_ps > 0 THEN greatest(mid, mid * least(up_ps / dcf_ps, 1.65)) ELSE mid END AS bull,
  CASE WHEN dn_ps > 0 THEN least(mid, mid * greatest(dn_ps / dcf_ps, 0.55)) ELSE mid END AS b0 FROM sc2""")
view("sc4", "SELECT *, greatest(CASE WHEN epv_ps > 0 AND epv_ps < mid THEN greatest(b0, epv_ps) ELSE b0 END, 0) AS bear FROM sc3")
view("sc5", "SELECT *, 0.25 * bear + 0.5 * mid + 0.25 * bull AS pw FROM sc4")
LO, HI = "floor(0.05::DOUBLE * (n - 1))::INT + 1", "floor(0.95::DOUBLE * (n - 1))::INT + 1"


def winsor(col, t="bd"):
    return (f"SELECT universe, ticker, sector, greatest(lo, least(hi, v)) AS w FROM (SELECT universe, ticker, sector, {col} AS v FROM {t}) x JOIN "
            f"(SELECT universe, vs[{LO}] AS lo, vs[{HI}] AS hi FROM (SELECT universe, list_sort(list({col})) AS vs, count({col}) AS n FROM {t} WHERE {col} IS NOT NULL GROUP BY 1)) l USING (universe) WHERE v IS NOT NULL")


def zs(col, t="bd"):
    return (f"SELECT universe, ticker, greatest(-3, least(3, (w - CASE WHEN sn >= 5 THEN sm ELSE gm END) / CASE WHEN sn >= 5 AND ss > 1e-12 THEN ss ELSE coalesce(nullif(gs, 0), 1) END)) AS z FROM "
            f"(SELECT *, count(*) OVER s AS sn, avg(w) OVER s AS sm, stddev_pop(w) OVER s AS ss, avg(w) OVER g AS gm, stddev_pop(w) OVER g AS gs FROM ({winsor(col, t)}) "
            "WINDOW s AS (PARTITION BY universe, sector), g AS (PARTITION BY universe))")


view("gapb", "SELECT *, CASE WHEN implied_op IS NOT NULL THEN g_trail - implied_g END AS gap FROM bd")
PR = "cume_dist() OVER (PARTITION BY universe, sector ORDER BY {0})"


def peer_pct(c, sign=""):
    base = f"SELECT universe, ticker, sector, {sign}{c} AS v, count(*) OVER (PARTITION BY universe, sector) AS sn FROM bd"
    return (f"(SELECT universe, ticker, CASE WHEN sn >= 5 THEN CASE WHEN count(*) OVER (PARTITION BY universe, sector) >= 5 THEN cume_dist() OVER (PARTITION BY universe, sector ORDER BY v) END "
            f"ELSE CASE WHEN count(*) OVER (PARTITION BY universe) >= 5 THEN cume_dist() OVER (PARTITION BY universe ORDER BY v) END END AS pct FROM ({base}) WHERE v IS NOT NULL)")


def preset(name, cond):
    return f"SELECT '{name}' AS preset, universe, ticker FROM bd WHERE {cond}"


PCT = "CASE WHEN {0} IS NULL THEN '' ELSE printf('%.1f%%', {0} * 100) END"
PEER_DIMS = {"g_trail": "", "roic": "", "om": "", "nde": "-", "roe_avg": "", "roe_std": "-", "eq_assets": ""}
SQL = {
    "present_value_fcf": sql(f"SELECT ticker, round({pv_fcf('base_fcf', 'wacc', 'g1')} / 1e6, 3) AS pv FROM ve WHERE base_fcf > 0 AND wacc - {TG} >= 0.015"),
    "present_value_nopat": sql(f"SELECT ticker, round({pv_nopat('nopat_norm', 'roic_dcf', 'wacc', 'g1')} / 1e6, 3) AS pv FROM ve WHERE nopat_norm > 0 AND roic_dcf > 0 AND wacc - {TG} >= 0.015"),
    "dcf_value": sql("SELECT ticker, round(CASE WHEN ps > 0 THEN ps END, 5) AS dcf_ps FROM vdcf"),
    "market_implied_growth": sql("SELECT ticker, op AS implied_op, round(g, 5) AS implied_g FROM vimp"),
    "epv_value": sql("SELECT ticker, round(ps, 5) AS epv_ps FROM vepv"),
    "rim_value": sql("SELECT ticker, round(ps, 5) AS rim_ps FROM vrim"),
    "ddm_value": sql("SELECT ticker, round(ps, 5) AS ddm_ps FROM vddm"),
    "archetype_router": sql("SELECT ticker, arch, eff_arch, rim_ok::INT AS rim_ok FROM ve"),
    "quality_score": sql("SELECT universe, ticker, quality0::DOUBLE AS quality FROM vq"),
    "bucket_assign": sql("SELECT universe, ticker, wbucket FROM vb"),
    "warranted_anchors": sql("SELECT universe, scope, round(a_y, 5) AS a_y, round(a_g, 6) AS a_g, round(a_m, 6) AS a_m, round(a_r, 6) AS a_r FROM vanch"),
    "warranted_coefs": sql("SELECT universe, n, round(c_g, 4) AS c_g, round(c_m, 4) AS c_m, round(c_r, 4) AS c_r FROM vcoef"),
    "warranted_value": sql("SELECT universe, ticker, round(warr0, 4) AS warr_ps FROM vw"),
    "reit_anchor": sql("SELECT universe, ticker, round(ffo, 4) AS ffo FROM vw WHERE eff_arch = 'reit'"),
    "engine_gates": sql("SELECT universe, ticker, implied_op, round(dcf_ps, 4) AS dcf_ps, round(epv_ps, 4) AS epv_ps, round(rim_ps, 4) AS rim_ps, round(warr_ps, 4) AS warr_ps, round(ffo, 4) AS ffo FROM bd"),
    "triangulation": sql("SELECT universe, ticker, nm AS n_methods, within, conf, round(low, 4) AS low, round(mid, 4) AS mid, round(high, 4) AS high, round(upside, 4) AS upside FROM bd"),
    "predictability_band": sql("SELECT universe, ticker, round(band, 4) AS band FROM bd"),
    "scenario_cone": sql("""SELECT bd.universe, bd.ticker, round(bear, 4) AS bear, round(sc5.mid, 4) AS base, round(bull, 4) AS bull, round(pw, 4) AS pw, round(sc5.mid / sc5.price - 1, 4) AS exp_base,
      round(pw / sc5.price - 1, 4) AS exp_pw, round(pow(pw / sc5.price, 0.2) - 1, 4) AS ann_pw FROM bd LEFT JOIN sc5 USING (universe, ticker)"""),
    "sensitivity_grid": sql(f"""SELECT ticker, dg, dw, round(CASE WHEN w - {TG} >= 0.015 THEN {pos(f"(({ev(w='w', g='g1')}) - nd) / shares")} END, 4) AS grid_ps FROM
      (SELECT ticker, nopat_norm, roic_dcf, base_fcf, shares, debt - cash_now AS nd, dg, dw, g1 + dg AS g1, wacc + dw AS w FROM ve, (VALUES (-0.02::DOUBLE), (0::DOUBLE), (0.02::DOUBLE)) a(dg), (VALUES (-0.01::DOUBLE), (0::DOUBLE), (0.01::DOUBLE)) b(dw) WHERE eff_arch = 'standard')"""),
    "adr_sanity": sql("SELECT universe, ticker, (why2 IS NOT NULL)::INT AS adr_bad FROM vt WHERE form = '20-F' AND mid IS NOT NULL"),
    "composite_score": sql("SELECT universe, ticker, quality, round(score, 6) AS score FROM bd"),
    "method_weights": sql("""SELECT universe, ticker, method, round(value, 4) AS value, round(w / sum(w) OVER (PARTITION BY universe, ticker), 6) AS share FROM (SELECT universe, ticker,
      unnest(['DCF', 'RIM', 'Warranted', 'FFO', 'DDM']) AS method, unnest([dcf_ps, rim_ps, warr_ps, ffo, ddm_ps]) AS value, unnest([0.10::DOUBLE, 0.35::DOUBLE, 0.30::DOUBLE, 0.30::DOUBLE, 0.10::DOUBLE]) AS w FROM bd) WHERE value IS NOT NULL"""),
    "verdicts": sql("""SELECT universe, ticker, CASE WHEN upside > 0.04 THEN 'Undervalued' WHEN upside < -0.04 THEN 'Overvalued' ELSE 'Fairly valued' END AS verdict,
      CASE WHEN implied_g IS NULL OR g_trail IS NULL THEN NULL WHEN implied_g > g_trail + 0.04 THEN 'optimistic' WHEN implied_g < greatest(-0.3, g_trail - 0.04) THEN 'pessimistic' ELSE 'roughly in line' END AS growth_view,
      CASE WHEN nm <= 1 THEN 'Single method' WHEN conf >= 4 THEN 'Strong' WHEN conf >= 3 THEN 'Fair' ELSE 'Wide range' END AS agreement FROM bd"""),
    "counter_case": sql("""SELECT universe, ticker, array_to_string(list_filter(CASE WHEN upside > 0.04 THEN [CASE WHEN implied_g < g_trail - 0.04 THEN 'implied growth below trailing' END,
      CASE WHEN mom_pct <= 35 THEN 'weak momentum' END, CASE WHEN quality < 48 THEN 'low quality' END, CASE WHEN nm <= 1 THEN 'single method' WHEN conf <= 2 THEN 'engines disagree' END]
      WHEN upside < -0.04 THEN [CASE WHEN implied_g > g_trail + 0.04 THEN 'implied growth above trailing' END, CASE WHEN mom_pct >= 65 THEN 'strong momentum' END, CASE WHEN quality >= 70 THEN 'high quality' END]
      ELSE [] END, lambda s: s IS NOT NULL), '; ') AS counter_case FROM bd"""),
    "excluded_report": sql("SELECT * FROM gone"),
    "multiples": sql("SELECT universe, ticker, round(pe, 4) AS pe, round(evebitda, 4) AS evebitda, round(fcfy, 5) AS fcfy, round(div_yield, 5) AS div_yield, round(nde, 4) AS nde FROM bd"),
    "trap_flags": sql("SELECT universe, ticker, array_to_string(flags, '|') AS flags FROM bd"),
    "percentile_rank": sql("SELECT universe, ticker, round(CASE WHEN roic IS NOT NULL THEN cume_dist() OVER (PARTITION BY universe, roic IS NULL ORDER BY roic) END, 6) AS pr FROM bd"),
    "winsorize": sql(f"SELECT universe, ticker, round(w, 5) AS w FROM ({winsor('upside')})"),
    "sector_zscore": sql(f"SELECT universe, ticker, round(z, 5) AS z FROM ({zs('upside')})"),
    "factor_blend": sql(f"""SELECT universe, ticker, round(coalesce((CASE WHEN v IS NULL THEN 0 ELSE 0.25 * v END + CASE WHEN q IS NULL THEN 0 ELSE 0.25 * q END + CASE WHEN m IS NULL THEN 0 ELSE 0.5 * m END)
      / nullif((v IS NOT NULL)::INT * 0.25 + (q IS NOT NULL)::INT * 0.25 + (m IS NOT NULL)::INT * 0.5, 0), 0), 5) AS blend FROM (SELECT bd.universe, bd.ticker,
      CASE WHEN a.z IS NULL THEN b.z WHEN b.z IS NULL THEN a.z ELSE (a.z + b.z) / 2 END AS v, c.z AS q, e.z AS m FROM bd LEFT JOIN ({zs('upside')}) a USING (universe, ticker)
      LEFT JOIN ({zs('gap', 'gapb')}) b USING (universe, ticker) LEFT JOIN ({zs('roic')}) c USING (universe, ticker) LEFT JOIN ({zs('mom')}) e USING (universe, ticker))"""),
    "rank_blend": sql("""SELECT universe, ticker, round(CASE WHEN gap IS NULL THEN rs ELSE 0.6 * rs + 0.4 * cume_dist() OVER (PARTITION BY universe, gap IS NULL ORDER BY gap) END, 6) AS blend
      FROM (SELECT *, cume_dist() OVER (PARTITION BY universe ORDER BY score) AS rs, g_trail - implied_g AS gap0 FROM bd) x JOIN (SELECT universe, ticker, g_trail - implied_g AS gap FROM bd) USING (universe, ticker)"""),
    "sector_medians": sql("SELECT universe, sector, count(*) AS n_all, round(median(upside), 5) AS median FROM bd GROUP BY 1, 2"),
    "peer_percentile": sql("SELECT bd.universe, bd.ticker, " + ", ".join(f"round(p{i}.pct, 6) AS {c}_pct" for i, c in enumerate(PEER_DIMS)) + " FROM bd " + " ".join(
        f"LEFT JOIN {peer_pct(c, s)} p{i} USING (universe, ticker)" for i, (c, s) in enumerate(PEER_DIMS.items()))),
    "peer_strip": sql("""SELECT a.universe, a.ticker, b.ticker AS peer, row_number() OVER (PARTITION BY a.universe, a.ticker ORDER BY b.mcap DESC, b.ticker)::INT AS rank
      FROM bd a JOIN bd b ON a.universe = b.universe AND a.sector = b.sector AND a.ticker <> b.ticker QUALIFY rank <= 5"""),
    "axis_bounds": sql("""WITH q AS (SELECT universe, vs[least(n - 1, floor(2 / 100 * n)::INT) + 1] AS p2, vs[least(n - 1, floor(96 / 100 * n)::INT) + 1] AS p96 FROM
      (SELECT universe, list_sort(list(upside)) AS vs, count(*) AS n FROM bd GROUP BY 1)), l AS (SELECT universe, greatest(-1, least(-0.10, floor((p2 - 0.04) * 20) / 20)) AS x_min,
      least(2.5, greatest(0.30, ceil((p96 + 0.06) * 20) / 20)) AS x_max FROM q) SELECT universe, count(*) FILTER (upside > x_max OR upside < x_min) AS off_chart, round(any_value(x_min), 4)::DOUBLE AS x_min, round(any_value(x_max), 4)::DOUBLE AS x_max
      FROM bd JOIN l USING (universe) GROUP BY 1"""),
    "kpi_strip": sql("""SELECT universe, count(*) AS covered, count(*) FILTER (upside > 0.15) AS undervalued, count(*) FILTER (quality >= 70) AS pass_quality, count(*) FILTER (len(flags) > 0) AS flagged,
      round(list_sort(list(upside))[count(*) // 2 + 1], 5) AS median_upside FROM bd GROUP BY 1"""),
    "screen_filter": sql("""SELECT universe, ticker FROM bd WHERE sector IN ('Industrials', 'Energy', 'Financials') AND round(mcap / 1e9, 1) >= 10 AND round(mcap / 1e9, 1) < 200 AND quality >= 30 AND conf >= 2 AND upside >= -0.4 AND mom_pct >= 10"""),
    "screen_presets": sql(" UNION ALL ".join([preset("Deep value", "upside * 100 >= 25 AND conf >= 3"), preset("Quality compounders", "quality >= 78 AND upside >= 0 AND len(flags) = 0"),
      preset("Clean & cheap", "upside * 100 >= 10 AND quality >= 65 AND len(flags) = 0"), preset("Value confirmed by tape", "upside * 100 >= 15 AND conf >= 3 AND len(flags) = 0 AND mom_pct >= 50")])),
    "sorted_screen": sql("SELECT universe, ticker, row_number() OVER (PARTITION BY universe ORDER BY coalesce(pe, -1e18), ticker) AS place FROM bd"),
    "name_search": sql("SELECT universe, ticker, name FROM bd WHERE lower(ticker) LIKE '%000012%' OR lower(name) LIKE '%000012%' QUALIFY row_number() OVER (PARTITION BY universe ORDER BY score DESC, ticker) <= 7"),
    "ranked_board": sql("SELECT universe, ticker, sector, eff_arch, conf, quality, round(price, 4) AS price, round(mid, 4) AS mid, round(upside, 4) AS upside, round(score, 6) AS score FROM bd"),
    "watchlist": sql("SELECT universe, ticker FROM bd WHERE ticker IN ('7', '12', '99', '101')"),
    "distinct_sectors": sql("SELECT DISTINCT sector FROM bd"),
    "archetype_tally": sql("""SELECT universe, arch, count(*) FILTER (ok) AS ranked, count(*) FILTER (ok AND eff_arch <> 'standard') AS gated, count(*) FILTER (ok AND arch = 'financial' AND eff_arch = 'standard') AS rerouted,
      count(*) FILTER (NOT ok) AS excluded FROM (SELECT universe, arch, eff_arch, why2 IS NULL AS ok FROM vt UNION ALL SELECT universe, arch, NULL, false FROM ci JOIN umem USING (ticker) WHERE why IS NOT NULL) GROUP BY 1, 2"""),
    "company_records": sql("""WITH t AS (SELECT ticker, string_agg(fiscal_year::VARCHAR, ',' ORDER BY fiscal_year) AS years, arg_max(round(revenue / 1e9, 3), fiscal_year) AS last_rev
        FROM yr WHERE rn <= 8 GROUP BY 1), n AS (SELECT *, 'not used for this archetype' AS off, eff_arch = 'standard' AS std, CASE WHEN div IS NULL THEN 0 ELSE div END AS d0 FROM bd)
      SELECT n.universe, n.ticker, 5 + (eff_arch = 'reit')::INT AS n_listed, (dcf_ps IS NOT NULL)::INT + (rim_ps IS NOT NULL)::INT + (ffo IS NOT NULL)::INT + (n.epv_ps IS NOT NULL)::INT
      + (warr_ps IS NOT NULL)::INT + (ddm_ps IS NOT NULL)::INT AS n_applicable, array_to_string(flags, '|') AS flags, round(pw, 2) AS pw, round(CASE WHEN pw IS NOT NULL THEN n.upside END, 4) AS exp_base,
      round(CASE WHEN std AND roic_dcf > 0 THEN roic_dcf END, 4) AS roic, round(CASE WHEN std AND roic_dcf > 0 THEN greatest(0, least(0.9, g1 / roic_dcf)) END, 4) AS reinvest,
      round(CASE WHEN std AND roic_dcf > 0 AND capx.n >= 3 AND ic_b - ic_a > 0 AND ic_b - ic_a > 0.02 * abs(ic_b) THEN (ebit_b - ebit_a) * (1 - tax_r) / (ic_b - ic_a) END, 4) AS inc_roic,
      concat_ws('|', CASE WHEN NOT std THEN off ELSE (CASE WHEN nopat_norm > 0 AND roic_dcf > 0 THEN 'normalized NOPAT less reinvestment of g/ROIC' ELSE 'normalized FCF' END)
          || (CASE WHEN cyc THEN ' over 10 years' ELSE '' END) || printf(', growth %.0f%%, WACC %.1f%%', g1 * 100, wacc * 100) END,
        CASE WHEN rim_ps IS NOT NULL THEN 'book value and discounted excess ROE' || (CASE WHEN arch <> 'standard' THEN ', the anchor here' ELSE '' END) WHEN ffo IS NOT NULL THEN 'replaced by P/FFO'
          WHEN std THEN 'for financials and REITs only' ELSE 'book value or ROE not usable' END,
        CASE WHEN eff_arch = 'reit' THEN CASE WHEN ffo IS NOT NULL THEN 'FFO at the median multiple of the covered REITs' ELSE 'no positive FFO' END END,
        CASE WHEN NOT std THEN off WHEN n.epv_ps > n.mid THEN 'no-growth value, above the growth cases' ELSE 'no-growth value, sets the low end only' END,
        CASE WHEN NOT std THEN off ELSE 'median EV/EBIT of ' || wbucket || ', adjusted for growth, margin and ROIC' END,
        CASE WHEN ddm_ps IS NOT NULL THEN printf('dividend of %.2f a share, discounted at %.1f%%', d0 / shares, re * 100) WHEN d0 = 0 THEN 'no dividend' ELSE 'dividend not covered by earnings, or too small' END) AS notes,
      years, last_rev, 'USD' AS fin_currency, round(n.roic, 6) AS roic_now, round(n.om, 6) AS om, round(n.roe_avg, 6) AS roe, round(n.roe_std, 6) AS roe_std, round(n.eq_assets, 6) AS eq_assets
      FROM n LEFT JOIN sc5 USING (universe, ticker) LEFT JOIN capx USING (ticker) LEFT JOIN t USING (ticker)"""),
    "run_records": sql("""WITH x AS (SELECT universe, ticker, NULL::VARCHAR AS why FROM bd UNION ALL SELECT * FROM gone),
      c AS (SELECT universe, regexp_replace(why, '^(\\w+):.*$', '\\1') AS why, count(*) AS n FROM x GROUP BY 1, 2)
      SELECT universe, CASE universe WHEN 'sp500' THEN 'S&P 500' ELSE 'S&P 1500' END AS name, '2001-12-31' AS as_of, 0.043::DOUBLE AS risk_free, 0.05::DOUBLE AS erp, 0.025::DOUBLE AS terminal_g,
      coalesce(sum(n) FILTER (why IS NULL), 0)::BIGINT AS covered, coalesce(sum(n) FILTER (why IS NOT NULL), 0)::BIGINT AS n_excluded,
      coalesce(string_agg(why || '=' || n, '; ' ORDER BY why) FILTER (why IS NOT NULL), '') AS excluded, 'dcf=0.1; rim=0.35; warranted=0.3; ffo=0.3; ddm=0.1' AS weights FROM c GROUP BY 1"""),
    "screen_csv": sql(rf"""SELECT universe, ticker, name, sector, regexp_replace(round(price, 2)::VARCHAR, '\.0$', '') AS price, regexp_replace(round(low, 2)::VARCHAR, '\.0$', '') AS low, regexp_replace(round(mid, 2)::VARCHAR, '\.0$', '') AS mid, regexp_replace(round(high, 2)::VARCHAR, '\.0$', '') AS high, {PCT.format('upside')} AS upside,
      conf::VARCHAR AS confidence, quality::VARCHAR AS quality, coalesce(mom_pct::VARCHAR, '') AS "momentumPct", {PCT.format('mom')} AS "momentum12_1", {PCT.format('implied_g')} AS "impliedGrowth", {PCT.format('g_trail')} AS "trailingGrowth",
      coalesce(regexp_replace(round(pe, 1)::VARCHAR, '\.0$', ''), '') AS pe, coalesce(regexp_replace(round(evebitda, 1)::VARCHAR, '\.0$', ''), '') AS "evEbitda", {PCT.format('fcfy')} AS "fcfYield", regexp_replace(round(mcap / 1e9, 1)::VARCHAR, '\.0$', '') AS "mcapB", array_to_string(flags, '; ') AS flags, regexp_replace(round(score, 4)::VARCHAR, '\.0$', '') AS score
      FROM bd"""),
    "coverage_manifest": sql("SELECT universe, CASE universe WHEN 'sp500' THEN 'S&P 500' ELSE 'S&P 1500' END AS name, count(*) AS covered, 0 AS is_default FROM bd GROUP BY 1"),
}
