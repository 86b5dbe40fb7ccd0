from .base import sql, view
from . import fundamentals  # noqa: F401  (views)
from .valuation import pv_fcf as _pf, pv_nopat as _pn


def _tg(text):
    return text.replace("0.025::DOUBLE", "tg")


def pv_fcf(*a):
    return _tg(_pf(*a))


def pv_nopat(*a):
    return _tg(_pn(*a))


BL = "greatest(0.5, least(2.0, 0.67 * {0} + 0.33))"
view("ret", """SELECT ticker, month, adjclose / lag(adjclose) OVER w - 1 AS r, mp / lag(mp) OVER w - 1 AS rm, row_number() OVER w AS i
  FROM (SELECT pxm.*, mkt.adjclose AS mp FROM pxm JOIN mkt USING (month)) WINDOW w AS (PARTITION BY ticker ORDER BY month)""")
view("rbeta", f"""SELECT ticker, month, CASE WHEN i >= 25 AND k >= 24 AND v > 0 THEN {BL.format('c / v')} ELSE 1.0 END::DOUBLE AS beta FROM (SELECT ticker, month, i, count(r) OVER w AS k,
  covar_pop(r, rm) OVER w AS c, var_pop(CASE WHEN r IS NOT NULL THEN rm END) OVER w AS v FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY month ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))""")
view("mom", """SELECT p.ticker, p.month, p.close, p.adjclose, a.adjclose / b.adjclose - 1 AS mom FROM pxm p LEFT JOIN pxm a ON a.ticker = p.ticker AND a.month = p.month - INTERVAL 1 MONTH
  LEFT JOIN pxm b ON b.ticker = p.ticker AND b.month = p.month - INTERVAL 12 MONTH""")
view("qn", "SELECT qdate, lead(qdate) OVER (ORDER BY qdate) AS qnext FROM qd")
view("fwd", """SELECT qdate, a.ticker, b.adjclose / a.adjclose - 1 AS fwd FROM qn JOIN pxm a ON a.month = date_trunc('month', qdate) JOIN pxm b ON b.ticker = a.ticker AND b.month = date_trunc('month', qnext)""")
view("rfl", """SELECT m.month, coalesce(arg_max(r.rate, r.month), 0.025) AS rate FROM (SELECT DISTINCT date_trunc('month', l_shipdate)::DATE AS month FROM lineitem) m LEFT JOIN rfm r ON r.month <= m.month GROUP BY 1""")
view("qmem", "SELECT qdate, s_suppkey::VARCHAR AS ticker FROM supplier, qd WHERE (s_suppkey + year(qdate) * 4 + quarter(qdate)) % 10 <> 0")
PC = "revenue ebit net_income cfo capex sbc equity long_debt cash dividends".split()
view("pq0", "SELECT qdate, ticker, fy, " + ", ".join(f"max(value) FILTER (concept = '{c}') AS {c}" for c in PC) + " FROM pasof GROUP BY ALL")
view("pq", """SELECT *, row_number() OVER (PARTITION BY qdate, ticker ORDER BY fy DESC) AS rn, count(*) OVER (PARTITION BY qdate, ticker) AS n,
  revenue / lag(revenue) OVER (PARTITION BY qdate, ticker ORDER BY fy) - 1 AS gr FROM pq0""")
view("pv", "SELECT qdate, ticker, CASE WHEN count(gr) FILTER (rn <= 6) >= 3 THEN coalesce(stddev_pop(gr) FILTER (rn <= 6) > 0.18, false) ELSE false END AS cyc FROM pq GROUP BY 1, 2")
L = ", ".join(f"max(CASE WHEN rn = 1 THEN {c} END) AS {c}" for c in PC if c != "dividends")
view("ps0", f"""SELECT qdate, ticker, any_value(cyc) AS cyc, max(n) AS n, max(fy) AS last_fy, {L}, arg_max(dividends, fy) FILTER (dividends IS NOT NULL) AS div,
  avg((cfo - capex - sbc) / revenue) FILTER (rn <= ny) AS fcf_margin, avg(ebit / revenue) FILTER (rn <= ny) AS om, avg(net_income / equity) FILTER (rn <= 5) AS roe,
  max(CASE WHEN rn = 4 THEN revenue END) AS rev4, pow(max(CASE WHEN rn = 1 THEN revenue END) / max(CASE WHEN rn = least(n, 6) THEN revenue END),
  1.0 / nullif(max(fy) - max(CASE WHEN rn = least(n, 6) THEN fy END), 0)) - 1 AS g_tr FROM (SELECT pq.*, cyc, CASE WHEN cyc THEN 10 ELSE 5 END AS ny FROM pq JOIN pv USING (qdate, ticker)) GROUP BY 1, 2""")
view("ps1", """SELECT m.qdate, m.ticker, x.sector, p.close AS price, p.mom, coalesce(b.beta, 1) AS beta, r.rate, s.shares, p.close * s.shares AS mcap, ps0.* EXCLUDE (qdate, ticker),
  long_debt AS debt, equity + long_debt - cash AS inv_cap, greatest(0, least(0.20, coalesce(g_tr, 0))) AS g1, fcf_margin * revenue AS fcf_norm, om * revenue * 0.79 AS nopat,
  CASE WHEN r.rate > 0.005 THEN least(0.025, r.rate) ELSE 0.005 END AS tg
  FROM qmem m JOIN ps0 USING (qdate, ticker) JOIN shasof s ON s.qdate = m.qdate AND s.ticker = m.ticker JOIN mom p ON p.ticker = m.ticker AND p.month = date_trunc('month', m.qdate)
  LEFT JOIN rbeta b ON b.ticker = m.ticker AND b.month = p.month JOIN rfl r ON r.month = p.month LEFT JOIN ssec x ON x.ticker = m.ticker
  WHERE n >= 3 AND last_fy >= year(m.qdate) - 2""")
view("ps2", """SELECT *, rate + beta * 0.05 + CASE WHEN mcap >= 10e9 THEN 0 WHEN mcap >= 2e9 THEN 0.003 WHEN mcap >= 0.5e9 THEN 0.008 ELSE 0.015 END AS re,
  CASE WHEN inv_cap > 0 THEN nopat / inv_cap END AS roic FROM ps1""")
view("ps3", "SELECT *, mcap / (mcap + debt) * re + debt / (mcap + debt) * (rate + 0.01) * 0.79 AS wacc FROM ps2")
EV = f"(CASE WHEN nopat > 0 AND roic > 0 THEN {pv_nopat('nopat', 'roic', 'wacc', 'g1')} WHEN fcf_norm > 0 THEN {pv_fcf('fcf_norm', 'wacc', 'g1')} END)"
view("pb0", f"""SELECT qdate, ticker, fcf_norm, wacc, tg, debt - cash AS nd, mcap, nopat, roic, {EV.replace('g1', '(-0.30::DOUBLE)')} - (debt - cash) AS e0, {EV.replace('g1', '(0.80::DOUBLE)')} - (debt - cash) AS e1
  FROM ps3 WHERE wacc - tg >= 0.015 AND NOT (nopat > 0 AND roic > 0 AND roic <= wacc)""")
view("pbis", f"""SELECT qdate, ticker, fcf_norm, wacc, tg, nd, mcap, nopat, roic, -0.30::DOUBLE AS lo, 0.80::DOUBLE AS hi, 0.25::DOUBLE AS g1, 0 AS i FROM pb0 WHERE e1 > e0 AND e0 <= mcap AND e1 >= mcap
  UNION ALL SELECT qdate, ticker, fcf_norm, wacc, tg, nd, mcap, nopat, roic, lo2, hi2, (lo2 + hi2) / 2, i + 1 FROM (SELECT *, CASE WHEN up THEN lo ELSE g1 END AS lo2, CASE WHEN up THEN g1 ELSE hi END AS hi2
  FROM (SELECT *, {EV} - nd > mcap AS up FROM pbis WHERE i < 45))""")
view("psig", f"""SELECT p.*, CASE WHEN p.wacc - p.tg >= 0.015 THEN (SELECT CASE WHEN q > 0 THEN q END FROM (SELECT ({EV} - (debt - cash)) / shares AS q)) END AS dcf,
  CASE WHEN om * revenue > 0 THEN (om * revenue * 0.79 / p.wacc + cash - debt) / shares END AS epv,
  CASE WHEN equity > 0 AND roe <= 0.40 AND equity / shares / price >= 0.15 THEN equity / shares + list_sum([(roe - re) * equity / shares * pow(0.62, t - 1) / pow(1 + re, t) for t in range(1, 11)])
    + (roe - re) * equity / shares * pow(0.62, 10) / (1 + re - 0.62) / pow(1 + re, 10) END AS rim,
  CASE WHEN div > 0 AND div / shares / price >= 0.01 AND (sector = 'Real Estate' OR (net_income > 0 AND div <= net_income * 1.5)) AND re - p.tg >= 0.005 THEN {pv_fcf('(div / shares)', 're', 'least(0.08, g1)')} END AS ddm,
  CASE WHEN e1 > e0 AND e0 > p.mcap THEN -0.3::DOUBLE WHEN e1 > e0 AND e1 < p.mcap THEN 0.8::DOUBLE ELSE g END AS impl,
  CASE WHEN ebit > 0 THEN -(debt - cash) / ebit END AS lev, coalesce((revenue < rev4)::INT, 0) + (fcf_norm <= 0)::INT + coalesce((ebit > 0 AND (debt - cash) / ebit > 3.5)::INT, 0) + (net_income > cfo * 1.2)::INT AS flags
  FROM ps3 p LEFT JOIN (SELECT qdate, ticker, e0, e1 FROM pb0) b USING (qdate, ticker) LEFT JOIN (SELECT qdate, ticker, g1 AS g FROM pbis WHERE i = 45) s USING (qdate, ticker)""")
view("pc", "SELECT *, coalesce(sector, 'UNKNOWN') AS bucket FROM psig QUALIFY count(*) OVER (PARTITION BY qdate) >= 20")
view("pfit", """SELECT qdate, bucket, greatest(5, least(60, (mcap + debt - cash) / ebit)) AS y, greatest(0, least(0.3, g1)) AS g, greatest(0, least(0.6, coalesce(om, 0))) AS m,
  greatest(0, least(0.5, coalesce(roic, 0))) AS r FROM pc WHERE ebit > 0 AND mcap + debt - cash > 0""")
view("pan", """SELECT qdate, bucket AS scope, least(28, median(y)) AS a_y, median(g) AS a_g, median(m) AS a_m, median(r) AS a_r FROM pfit GROUP BY 1, 2 HAVING count(*) >= 3
  UNION ALL SELECT qdate, '*', least(28, median(y)), median(g), median(m), median(r) FROM pfit GROUP BY 1""")
A = ", ".join(f"coalesce(o.a_{c}, z.a_{c}) AS a_{c}" for c in "ygmr")


def anchored(t):
    return f"SELECT t.*, {A} FROM {t} t LEFT JOIN pan o ON o.qdate = t.qdate AND o.scope = t.bucket LEFT JOIN pan z ON z.qdate = t.qdate AND z.scope = '*'"


view("pols", f"""SELECT qdate, count(*) AS n, sum((g-a_g)*(g-a_g)) AS a, sum((g-a_g)*(m-a_m)) AS b, sum((g-a_g)*(r-a_r)) AS c, sum((m-a_m)*(m-a_m)) AS d,
  sum((m-a_m)*(r-a_r)) AS e, sum((r-a_r)*(r-a_r)) AS f, sum((g-a_g)*(y-a_y)) AS p, sum((m-a_m)*(y-a_y)) AS q, sum((r-a_r)*(y-a_y)) AS s FROM ({anchored('pfit')}) GROUP BY 1""")
DET = "(a*(d*f-e*e) - b*(b*f-e*c) + c*(b*e-d*c))"
SING = "n <= 3 OR a < 1e-10 OR d - b*b/a < 1e-10"
view("pcoef", f"""SELECT qdate, CASE WHEN {SING} THEN 0 ELSE greatest(0, (p*(d*f-e*e) - b*(q*f-e*s) + c*(q*e-d*s)) / {DET}) END AS c_g, CASE WHEN {SING} THEN 0 ELSE greatest(0, (a*(q*f-e*s) - p*(b*f-e*c) + c*(b*s-q*c)) / {DET}) END AS c_m,
  CASE WHEN {SING} THEN 0 ELSE greatest(0, (a*(d*s-q*e) - b*(b*s-q*c) + p*(b*e-d*c)) / {DET}) END AS c_r FROM pols""")
view("px", f"""SELECT w.*, CASE WHEN ebit > 0 THEN (greatest(4, least(40, a_y + c_g * (g1 - a_g) + c_m * (greatest(0, least(0.6, coalesce(om, 0))) - a_m) + c_r * (greatest(0, least(0.5, coalesce(roic, 0))) - a_r))) * ebit - debt + cash) / shares END AS warr
  FROM ({anchored('pc')}) w LEFT JOIN pcoef USING (qdate)""")
view("pdim", "SELECT qdate, ticker, unnest(['om', 'roe', 'g_tr', 'fcfm', 'lev']) AS dim, unnest([om, roe, g_tr, fcf_margin, lev]) AS val FROM px")
view("pqr", """SELECT qdate, ticker, avg(pr) AS q5, avg(pr) FILTER (dim <> 'g_tr') AS q4 FROM (SELECT *, cume_dist() OVER (PARTITION BY qdate, dim ORDER BY val) AS pr FROM pdim WHERE val IS NOT NULL) GROUP BY 1, 2""")
view("vars", """SELECT * FROM (VALUES ('v1', 0.25, 0.20, 0.25, true, false, false, false, false, 0.0), ('v2w', 0.10, 0.35, 0.30, false, true, false, false, false, 0.0), ('v2', 0.10, 0.35, 0.30, false, true, false, false, false, 0.4),
  ('v3', 0.10, 0.35, 0.30, false, true, true, false, false, 0.0), ('v3m', 0.10, 0.35, 0.30, false, true, true, false, false, 0.0), ('v2r', 0.10, 0.35, 0.30, false, true, false, true, false, 0.0),
  ('v2rd', 0.10, 0.35, 0.30, false, true, false, true, true, 0.0)) t(variant, wd, wr, ww, five, decay, l7, rim_fin, use_ddm, gap_w)""")
view("sv0", """SELECT px.* EXCLUDE (rim, ddm), rim AS rim_all, variant, wd, wr, ww, five, decay, l7, gap_w, CASE WHEN rim_fin AND coalesce(sector NOT IN ('Financials', 'Real Estate'), true) THEN NULL ELSE rim END AS rim,
  CASE WHEN use_ddm THEN ddm END AS ddm, q5, q4 FROM px LEFT JOIN pqr USING (qdate, ticker), vars""")
MS = [("dcf", "wd"), ("rim", "wr"), ("warr", "ww"), ("ddm", "0.10")]
view("sv1", f"""SELECT *, {" + ".join(f"coalesce(({c} > 0)::INT, 0)" for c, _ in MS)} AS nm, coalesce(({" + ".join(f"coalesce(CASE WHEN {c} > 0 THEN {c} * {w} END, 0)" for c, w in MS)})
  / nullif({" + ".join(f"(CASE WHEN {c} > 0 THEN {w} ELSE 0 END)" for c, w in MS)}, 0), CASE WHEN epv > 0 THEN epv END) AS mid FROM sv0""")
view("sv2", f"""SELECT *, mid / price - 1 AS upside, coalesce(100 * CASE WHEN five THEN q5 ELSE q4 END, 50) AS q, g_tr - impl AS rev_gap, warr / price - 1 AS warr_up, dcf / price - 1 AS dcf_up, epv / price - 1 AS epv_up, rim_all / price - 1 AS rim_up,
  {" + ".join(f"coalesce(({c} > 0 AND abs({c} / mid - 1) <= 0.10)::INT, 0)" for c, _ in MS)} AS within FROM sv1 WHERE mid IS NOT NULL""")
view("sv3", """SELECT *, (greatest(-0.5, least(0.6, upside)) + 0.5) * (CASE WHEN nm < 2 THEN 2 WHEN within / nm >= 0.99 THEN 5 WHEN within / nm >= 0.66 THEN 4 WHEN within / nm >= 0.5 THEN 3 ELSE 2 END / 5) * (q / 100)
  * CASE WHEN decay THEN pow(0.85, flags) WHEN flags + cyc::INT > 0 THEN 0.55 ELSE 1 END AS raw FROM sv2""")
view("lz0", "SELECT qdate, variant, ticker, coalesce(sector, 'UNKNOWN') AS sec, unnest(['warr', 'gap', 'q', 'mom']) AS leg, unnest([warr_up, rev_gap, q, mom]) AS val FROM sv3 WHERE l7")
view("lz1", """SELECT z.*, greatest(vs[floor(0.05::DOUBLE * (n - 1))::INT + 1], least(vs[floor(0.95::DOUBLE * (n - 1))::INT + 1], val)) AS w FROM (SELECT * FROM lz0 WHERE val IS NOT NULL) z
  JOIN (SELECT qdate, variant, leg, list_sort(list(val)) AS vs, count(*) AS n FROM lz0 WHERE val IS NOT NULL GROUP BY 1, 2, 3) USING (qdate, variant, leg)""")
view("lz2", """SELECT qdate, variant, ticker, leg, greatest(-3, least(3, (w - CASE WHEN count(*) OVER s >= 5 THEN avg(w) OVER s ELSE avg(w) OVER g END) /
  CASE WHEN count(*) OVER s >= 5 AND stddev_pop(w) OVER s > 1e-12 THEN stddev_pop(w) OVER s ELSE coalesce(nullif(stddev_pop(w) OVER g, 0), 1) END)) AS z FROM lz1
  WINDOW s AS (PARTITION BY qdate, variant, leg, sec), g AS (PARTITION BY qdate, variant, leg)""")
view("lz3", """SELECT qdate, variant, ticker, avg(z) FILTER (leg IN ('warr', 'gap')) AS zv, max(z) FILTER (leg = 'q') AS zq, max(z) FILTER (leg = 'mom') AS zm FROM lz2 GROUP BY 1, 2, 3""")
W1, W2 = "CASE variant WHEN 'v3' THEN 1.0::DOUBLE / 3 ELSE 0.25 END", "CASE variant WHEN 'v3' THEN 1.0::DOUBLE / 3 ELSE 0.50 END"
view("scd", f"""SELECT qdate, ticker, variant, sector, upside, q, mom, rev_gap, warr_up, dcf_up, epv_up, rim_up, CASE WHEN l7 THEN coalesce((coalesce(zv * {W1}, 0) + coalesce(zq * {W1}, 0) + coalesce(zm * {W2}, 0))
  / nullif((zv IS NOT NULL)::INT * {W1} + (zq IS NOT NULL)::INT * {W1} + (zm IS NOT NULL)::INT * {W2}, 0), 0)
  WHEN gap_w > 0 THEN CASE WHEN rev_gap IS NULL THEN rs ELSE 0.6 * rs + 0.4 * rg END ELSE raw END AS score
  FROM (SELECT *, cume_dist() OVER (PARTITION BY qdate, variant ORDER BY raw) AS rs, cume_dist() OVER (PARTITION BY qdate, variant, rev_gap IS NULL ORDER BY rev_gap) AS rg FROM sv3) LEFT JOIN lz3 USING (qdate, variant, ticker)""")
view("pk", """SELECT s.*, fwd, row_number() OVER (PARTITION BY variant, qdate ORDER BY score DESC, ticker) <= greatest(10, count(*) OVER (PARTITION BY variant, qdate) // 5) AS held,
  count(*) OVER (PARTITION BY variant, qdate) AS n FROM scd s JOIN fwd USING (qdate, ticker) QUALIFY count(*) OVER (PARTITION BY variant, qdate) >= 20""")
view("rt", "SELECT variant, qdate, max(n) AS n, avg(fwd) FILTER (held) AS strat, avg(fwd) AS bench FROM pk GROUP BY 1, 2")




view("tn", """SELECT c.variant, c.qdate, CASE WHEN c.prev IS NOT NULL THEN 1 - coalesce(k.kept, 0) / c.sz END AS turnover FROM (SELECT variant, qdate, count(*) AS sz, lag(qdate) OVER (PARTITION BY variant ORDER BY qdate) AS prev FROM pk WHERE held GROUP BY 1, 2) c
  LEFT JOIN (SELECT a.variant, a.qdate, count(*) AS kept FROM (SELECT pk.variant, pk.qdate, ticker, prev FROM pk JOIN (SELECT variant, qdate, lag(qdate) OVER (PARTITION BY variant ORDER BY qdate) AS prev FROM rt) USING (variant, qdate) WHERE held) a
  JOIN pk b ON b.variant = a.variant AND b.qdate = a.prev AND b.ticker = a.ticker AND b.held GROUP BY 1, 2) k USING (variant, qdate)""")
view("cv0", "SELECT *, round(product(1 + strat) OVER w, 4) AS sv, round(product(1 + bench) OVER w, 4) AS bv FROM rt WINDOW w AS (PARTITION BY variant ORDER BY qdate)")
view("cv", "SELECT *, sv / greatest(1, max(sv) OVER w) - 1 AS sd, bv / greatest(1, max(bv) OVER w) - 1 AS bd FROM cv0 WINDOW w AS (PARTITION BY variant ORDER BY qdate)")
STAT = ("count(*) AS periods, round(count(*) FILTER (strat > bench) / count(*), 3) AS hit_rate, round(pow(arg_max(sv, t), {p}.0 / count(*)) - 1, 4) AS strat_cagr, round(pow(arg_max(bv, t), {p}.0 / count(*)) - 1, 4) AS bench_cagr, "
        "round(avg(strat) * {p} / (stddev_pop(strat) * sqrt({p})), 2) AS strat_sharpe, round(avg(bench) * {p} / (stddev_pop(bench) * sqrt({p})), 2) AS bench_sharpe, round(least(0, min(sd)), 3) AS strat_dd, "
        "round(least(0, min(bd)), 3) AS bench_dd, round(avg(turnover), 3) AS turnover, round(avg(n), 1) AS names")
THIRDS = "(VALUES ('full', 0, 3), ('pre', 0, 1), ('fit', 1, 2), ('holdout', 2, 3)) t(label, i, j)"
view("wins", f"SELECT label, a0 + ((z0 - a0) * i // 3)::INT + (i > 0)::INT AS a, a0 + ((z0 - a0) * j // 3)::INT AS b FROM (SELECT min(qdate) AS a0, max(qdate) AS z0 FROM qd), {THIRDS}")
view("mwins", f"SELECT label, a0 + ((z0 - a0) * i // 3)::INT + (i > 0)::INT AS a, a0 + ((z0 - a0) * j // 3)::INT AS b FROM (SELECT date_trunc('month', a)::DATE AS a0, date_trunc('month', z)::DATE AS z0 FROM span), {THIRDS}")
view("mkc", """SELECT month, sum(adjclose * (ticker::BIGINT % 5 + 1)) / sum(ticker::BIGINT % 5 + 1) AS adjclose FROM pxm WHERE ((year(month) - 1970) * 12 + month(month) - 1) % 7 <> 0 GROUP BY 1""")
view("wrt", "SELECT variant, label, qdate, strat, bench FROM rt JOIN wins ON qdate BETWEEN a AND b WHERE qdate < (SELECT max(qdate) FROM qd WHERE qd.qdate <= b)")
view("wcv", "SELECT *, round(product(1 + strat) OVER w, 4) AS sv, round(product(1 + bench) OVER w, 4) AS bv FROM wrt WINDOW w AS (PARTITION BY variant, label ORDER BY qdate)")
view("mmem", "SELECT m.month, q.ticker FROM (SELECT m.month, max(qd.qdate) AS qdate FROM (SELECT DISTINCT month FROM pxm) m JOIN qd ON date_trunc('month', qd.qdate) <= m.month GROUP BY 1) m JOIN qmem q USING (qdate)")
view("mrow", """SELECT mm.month, mm.ticker, mom, n.adjclose / p.adjclose - 1 AS fwd FROM mmem mm JOIN mom p USING (month, ticker) JOIN pxm n ON n.ticker = mm.ticker AND n.month = mm.month + INTERVAL 1 MONTH
  WHERE mom IS NOT NULL AND EXISTS (SELECT 1 FROM mkt WHERE mkt.month = mm.month + INTERVAL 1 MONTH)""")
view("mpk", """SELECT *, count(*) OVER (PARTITION BY month) AS n, row_number() OVER (PARTITION BY month ORDER BY mom DESC, ticker) <= greatest(10, count(*) OVER (PARTITION BY month) // 5) AS held FROM mrow QUALIFY n >= 20""")
view("mret", """SELECT r.month, r.n, r.top, r.bench, k.kept, t.mm FROM (SELECT month, max(n) AS n, avg(fwd) FILTER (held) AS top, avg(fwd) AS bench, lag(month) OVER (ORDER BY month) AS prev FROM mpk GROUP BY 1) r
  LEFT JOIN (SELECT a.month, b.month AS prev, count(*) AS kept FROM mpk a JOIN mpk b ON a.held AND b.held AND a.ticker = b.ticker GROUP BY 1, 2) k ON k.month = r.month AND k.prev = r.prev
  LEFT JOIN (SELECT m.month, a.adjclose / b.adjclose - 1 AS mm FROM mkt m JOIN mkt a ON a.month = m.month - INTERVAL 1 MONTH JOIN mkt b ON b.month = m.month - INTERVAL 12 MONTH) t ON t.month = r.month""")
view("mv0", """SELECT *, NOT trend OR coalesce(nullif(mm, 0), -1) > 0 AS rison FROM mret, (VALUES ('MOM (gross)', false, 0.0), ('MOM (net 10bp)', false, 0.0010), ('MOM (net 25bp)', false, 0.0025), ('MOM+trend (net)', true, 0.0010)) v(variant, trend, cost)""")
view("mv1", """SELECT *, CASE WHEN rison THEN 1 - CASE WHEN was THEN coalesce(kept, 0) ELSE 0 END / greatest(10, n // 5) WHEN was THEN 1 ELSE 0 END AS turnover FROM
  (SELECT *, coalesce(lag(rison) OVER (PARTITION BY variant ORDER BY month), false) AS was FROM mv0)""")
view("mv2", """SELECT variant, label, month AS t, n, turnover, CASE WHEN rison THEN top ELSE bench END - turnover * 2 * cost AS strat, bench FROM mv1 JOIN mwins ON month BETWEEN a AND b""")
view("mv3", "SELECT *, product(1 + strat) OVER w AS sv, product(1 + bench) OVER w AS bv FROM mv2 WINDOW w AS (PARTITION BY variant, label ORDER BY t)")
view("mv4", "SELECT *, sv / greatest(1, max(sv) OVER w) - 1 AS sd, bv / greatest(1, max(bv) OVER w) - 1 AS bd FROM mv3 WINDOW w AS (PARTITION BY variant, label ORDER BY t)")
CUTS = {"1M": "top - 30", "6M": "top - 182", "YTD": "date_trunc('year', top)::DATE", "1Y": "top - 365", "5Y": "top - 1826", "MAX": "DATE '1900-01-01'"}
RANGES = {f"{k} date": ("pxd", "date", v) for k, v in CUTS.items()} | {f"{k} month": ("pxm", "month", f"date_trunc('month', {v})") for k, v in CUTS.items() if k != "5Y"}


def rng(label, t, c, cut):
    return (f"SELECT '{label}' AS rng, ticker, count(*) AS points, round(arg_min(adjclose, d), 6) AS first, round(arg_max(adjclose, d), 6) AS last, round(arg_max(adjclose, d) / arg_min(adjclose, d) - 1, 5) AS change "
            f"FROM (SELECT ticker, {c} AS d, adjclose, max({c}) OVER (PARTITION BY ticker) AS top FROM {t}) WHERE d >= {cut} GROUP BY 2")


SQL = {
    "price_bars": sql("SELECT ticker, date::VARCHAR AS date, round(adjclose, 5) AS close, round(CASE WHEN (date - DATE '1970-01-01') % 3 = 0 THEN adjclose ELSE adjclose * 0.9::DOUBLE END, 5) AS adjclose FROM pxd WHERE (date - DATE '1970-01-01') % 5 <> 0"),
    "split_events": sql("SELECT p_partkey::VARCHAR AS ticker, (DATE '1970-01-01' + p_partkey::INT)::VARCHAR AS sdate, round((p_size % 4) / (p_size % 3), 6) AS factor FROM part WHERE p_size % 4 <> 0 AND p_size % 3 <> 0"),
    "monthly_risk_free": sql("""SELECT date_trunc('month', d)::DATE::VARCHAR AS month, round(arg_max((k % 700) / 100 / 100, d), 6) AS rate FROM (SELECT o_orderdate::DATE AS d, max(o_orderkey) AS k FROM orders GROUP BY 1) WHERE k % 5 > 1 GROUP BY 1"""),
    "blume_beta": sql(f"SELECT ticker, months, round(b, 5) AS beta_raw, round({BL.format('b')}, 5) AS beta FROM (SELECT ticker, count(r) AS months, covar_pop(r, rm) / var_pop(rm) AS b FROM ret WHERE r IS NOT NULL GROUP BY 1) WHERE months >= 24"),
    "rolling_beta": sql("SELECT ticker, month::VARCHAR AS month, round(beta, 5) AS beta FROM rbeta"),
    "momentum_12_1": sql("SELECT ticker, month::VARCHAR AS month, round(mom, 6) AS mom FROM mom"),
    "live_momentum": sql("""WITH h AS (SELECT sector AS universe, pxm.*, max(month) OVER (PARTITION BY sector) AS top FROM pxm JOIN ssec USING (ticker)),
      m AS (SELECT universe, ticker, max(adjclose) FILTER (month = top - INTERVAL 1 MONTH) / max(adjclose) FILTER (month = top - INTERVAL 12 MONTH) - 1 AS mom FROM h GROUP BY 1, 2)
      SELECT universe, ticker, round_even(round(100 * cume_dist() OVER (PARTITION BY universe ORDER BY mom), 9), 0)::INT AS mom_pct, round(mom, 6) AS mom FROM m WHERE mom IS NOT NULL"""),
    "forward_returns": sql("SELECT qdate::VARCHAR AS qdate, ticker, round(fwd, 6) AS fwd FROM fwd"),
    "risk_free_locf": sql("SELECT month::VARCHAR AS month, round(rate, 6) AS rate FROM rfl"),
    "price_ranges": sql(" UNION ALL ".join(rng(k, *v) for k, v in RANGES.items()) + """ UNION ALL SELECT '5Y month', ticker, count(*), round(arg_min(adjclose, month), 6), round(arg_max(adjclose, month), 6), round(arg_max(adjclose, month) / arg_min(adjclose, month) - 1, 5)
      FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY month DESC) AS r FROM pxm) WHERE r <= 60 GROUP BY 2"""),
    "quarter_calendar": sql("""SELECT q::VARCHAR AS qdate FROM (SELECT last_day(m)::DATE AS q FROM (SELECT unnest(generate_series((SELECT date_trunc('year', min(o_orderdate))::DATE + INTERVAL 2 MONTH FROM orders), (SELECT max(o_orderdate)::DATE + INTERVAL 3 MONTH FROM orders), INTERVAL 3 MONTH)) AS m))
      WHERE q BETWEEN (SELECT min(o_orderdate)::DATE FROM orders) AND (SELECT max(o_orderdate)::DATE FROM orders)"""),
    "membership_walkback": sql("""WITH w AS (SELECT unnest(generate_series((SELECT min(date) + 6 FROM chg), (SELECT max(date) FROM chg), INTERVAL 7 DAY))::DATE AS qdate), k AS (SELECT date, row_no, coalesce(added, removed) AS ticker, removed IS NOT NULL AS rem FROM chg),
      f AS (SELECT qdate, ticker, arg_max(rem, row_no) AS rem FROM (SELECT *, min(date) OVER (PARTITION BY qdate, ticker) AS d0 FROM w JOIN k ON date > qdate) WHERE date = d0 GROUP BY 1, 2),
      t AS (SELECT DISTINCT ticker FROM k UNION SELECT ticker FROM cur)
      SELECT w.qdate::VARCHAR AS qdate, t.ticker FROM w CROSS JOIN t LEFT JOIN f ON f.qdate = w.qdate AND f.ticker = t.ticker WHERE CASE WHEN rem IS NULL THEN t.ticker IN (SELECT ticker FROM cur) ELSE rem END"""),
    "walkback_anomalies": sql("""SELECT ticker, date::VARCHAR AS date, row_no, kind FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY ticker ORDER BY date DESC, row_no) = 'remove', ticker IN (SELECT ticker FROM cur)) AS was_in FROM
      (SELECT date, row_no, coalesce(added, removed) AS ticker, CASE WHEN added IS NULL THEN 'remove' ELSE 'add' END AS kind FROM chg)) WHERE (kind = 'add') <> was_in"""),
    "members_by_month": sql("SELECT month::VARCHAR AS month, count(*) AS n, min(ticker) AS first_ticker FROM mmem GROUP BY 1"),
    "pit_signal": sql("""SELECT qdate::VARCHAR AS qdate, ticker, flags, round(g_tr, 5) AS g_tr, round(om, 5) AS om, round(roe, 5) AS roe, round(fcf_margin, 5) AS fcf_margin, round(wacc, 6) AS wacc, round(dcf, 3) AS dcf, round(epv, 3) AS epv, round(rim, 3) AS rim,
      round(ddm, 3) AS ddm, round(impl, 5) AS impl, round(mom, 5) AS mom, round(beta, 5) AS beta FROM psig"""),
    "quarter_warranted": sql("SELECT qdate::VARCHAR AS qdate, ticker, round(warr, 3) AS warr FROM px"),
    "score_variants": sql("SELECT qdate::VARCHAR AS qdate, variant, ticker, round(score, 5) AS score, round(upside, 5) AS upside, round(q, 4) AS q, round(rev_gap, 5) AS rev_gap FROM scd"),
    "top_quintile": sql("SELECT variant, qdate::VARCHAR AS qdate, n, round(strat, 6) AS strat, round(bench, 6) AS bench FROM rt"),
    "method_reliability": sql("""WITH r AS (SELECT * FROM scd JOIN fwd USING (qdate, ticker) WHERE variant = 'v2rd'), bm AS (SELECT qdate, avg(fwd) AS bench FROM r GROUP BY 1 HAVING count(*) >= 20),
      l AS (SELECT qdate, ticker, fwd, unnest(['score', 'dcf_up', 'warr_up', 'epv_up', 'rim_up', 'rev_gap', 'mom']) AS method, unnest([score, dcf_up, warr_up, epv_up, rim_up, rev_gap, mom]) AS val FROM r),
      t AS (SELECT *, row_number() OVER (PARTITION BY qdate, method ORDER BY val DESC, ticker) AS p, count(*) OVER (PARTITION BY qdate, method) AS n FROM l WHERE val IS NOT NULL),
      q AS (SELECT qdate, method, avg(fwd) - any_value(bench) AS ex FROM t JOIN bm USING (qdate) WHERE n >= 20 AND p <= greatest(10, n // 5) GROUP BY 1, 2)
      SELECT method, count(*) AS quarters, round(count(*) FILTER (ex > 0) / count(*), 4) AS hit_rate, round(avg(ex), 6) AS avg_excess FROM q GROUP BY 1"""),
    "basket_turnover": sql("SELECT variant, qdate::VARCHAR AS qdate, round(turnover, 5) AS turnover FROM tn"),
    "equity_curve": sql("SELECT variant, qdate::VARCHAR AS qdate, sv, bv, round(sd, 4) AS sv_dd FROM cv"),
    "curve_stats": sql(f"SELECT variant, {STAT.format(p=4)} FROM (SELECT cv.*, qdate AS t, turnover FROM cv LEFT JOIN tn USING (variant, qdate)) GROUP BY 1 HAVING count(*) >= 8"),
    "split_validation": sql("""SELECT variant, label, count(*) AS periods, round(round(pow(arg_max(sv, qdate), 4.0 / count(*)) - 1, 4) - round(pow(arg_max(bv, qdate), 4.0 / count(*)) - 1, 4), 4) AS excess,
      round(count(*) FILTER (strat > bench) / count(*), 3) AS hit_rate FROM wcv GROUP BY 1, 2 HAVING count(*) >= 8"""),
    "signal_coverage": sql("""SELECT qdate::VARCHAR AS qdate, m AS members, coalesce(s, 0) AS signals, (qdate < (SELECT a FROM wins WHERE label = 'fit'))::INT AS early, round(coalesce(s, 0) / m, 4) AS share FROM (SELECT qdate, count(*) AS m FROM qmem GROUP BY 1)
      LEFT JOIN (SELECT qdate, count(*) AS s FROM psig GROUP BY 1) USING (qdate)"""),
    "coverage_means": sql("""SELECT count(*) AS quarters, round(avg(s / m), 6) AS mean_share, round(avg(s / m) FILTER (qdate < (SELECT a FROM wins WHERE label = 'fit')), 6) AS early_share FROM
      (SELECT qdate, count(*) AS m FROM qmem GROUP BY 1) a LEFT JOIN (SELECT qdate, count(*) AS n FROM psig GROUP BY 1) b USING (qdate), LATERAL (SELECT coalesce(n, 0) AS s)"""),
    "survivorship_gap": sql("""WITH lv AS (SELECT last_day(qdate + INTERVAL 3 MONTH)::DATE AS qdate, bv FROM cv WHERE variant = 'v2rd' UNION ALL SELECT min(qdate), 1.0 FROM cv WHERE variant = 'v2rd'),
      j AS (SELECT label, qdate, bv, adjclose AS p FROM lv JOIN mkt ON month = date_trunc('month', qdate) JOIN wins ON qdate BETWEEN a AND b)
      SELECT label, round(c, 4) AS covered, round(i, 4) AS index_ew, round((c - i) * 100, 1) AS gap_pp, round(pow(z.adjclose / o.adjclose, 4.0 / (n - 1)) - 1, 4) AS index_cap
      FROM (SELECT label, count(*) AS n, date_trunc('month', min(qdate)) AS m0, date_trunc('month', max(qdate)) AS m1, pow(arg_max(bv, qdate) / arg_min(bv, qdate), 4.0 / (count(*) - 1)) - 1 AS c,
      pow(arg_max(p, qdate) / arg_min(p, qdate), 4.0 / (count(*) - 1)) - 1 AS i FROM j GROUP BY 1 HAVING count(*) >= 8) LEFT JOIN mkc o ON o.month = m0 LEFT JOIN mkc z ON z.month = m1"""),
    "momentum_study": sql(f"""SELECT variant, label, periods, round(sc - bc, 4) AS excess, hit_rate, strat_cagr, strat_sharpe, strat_dd, turnover FROM (SELECT variant, label, pow(arg_max(sv, t), 12.0 / count(*)) - 1 AS sc, pow(arg_max(bv, t), 12.0 / count(*)) - 1 AS bc,
      {STAT.format(p=12)} FROM mv4 GROUP BY 1, 2 HAVING count(*) >= 24)"""),
    "price_upsert": sql("""SELECT ticker, month::VARCHAR AS month, round(adjclose * CASE WHEN month >= (SELECT z - INTERVAL 6 MONTH FROM span) THEN 1.1::DOUBLE ELSE 1 END * 1.000123::DOUBLE, 6) AS adjclose FROM pxm UNION ALL SELECT 'NEW', month::VARCHAR, round(adjclose * 1.000123::DOUBLE, 6) FROM pxm WHERE ticker = '3'"""),
    "price_matrix": sql("""WITH pxe AS (SELECT ticker, date, adjclose + 0.00031::DOUBLE AS adjclose FROM pxd), mem AS (SELECT DISTINCT ticker, 'a' AS universe FROM pxd UNION ALL SELECT DISTINCT ticker, 'b' FROM pxd WHERE ticker::BIGINT % 2 = 0), r AS (SELECT * FROM pxe WHERE date >= (SELECT max(date) FROM pxd) - 420),
      lastd AS (SELECT ticker, date_trunc('month', max(date))::DATE AS month, arg_max(adjclose, date) AS v FROM r GROUP BY 1),
      mm AS (SELECT ticker, date_trunc('month', date)::DATE AS month, arg_min(adjclose, date) AS v FROM pxe GROUP BY 1, 2), m2 AS (SELECT ticker, month, coalesce(l.v, mm.v) AS v FROM mm FULL JOIN lastd l USING (ticker, month)),
      c AS (SELECT 'daily' AS block, universe, ticker, date AS ax, adjclose AS v FROM r JOIN mem USING (ticker) UNION ALL SELECT 'monthly', universe, ticker, month, v FROM m2 JOIN mem USING (ticker)),
      a AS (SELECT block, universe, count(DISTINCT ax) AS axis_len FROM c GROUP BY 1, 2)
      SELECT c.block, c.universe, ticker, any_value(axis_len) AS axis_len, any_value(axis_len) - count(*) AS gaps, round(sum(CASE WHEN v >= 5 THEN round(v, 2) ELSE round(v, 4) END), 4) AS total FROM c JOIN a ON a.block = c.block AND a.universe = c.universe GROUP BY 1, 2, 3"""),
}
SQL["price_upsert_table"] = SQL["price_upsert"]
