from .base import sql, view

view("sday", "SELECT day, (SELECT max(session) FROM sess WHERE session <= day) AS session FROM (SELECT DISTINCT day FROM ev)")
view("runs", """SELECT model, coalesce(session, day) AS session, min(day) AS day, arg_min(run_date, day) AS run_date, count(*) - 1 AS collapsed FROM
  (SELECT model, run_date::DATE AS day, max(run_date) AS run_date FROM snap GROUP BY 1, 2) JOIN sday USING (day) GROUP BY 1, 2""")
view("cl", "SELECT * FROM pxd WHERE isodow(date) < 6")
view("lr", """SELECT s.model, r.session, s.ticker, s.score, x.adjclose / e.adjclose - 1 AS ret, row_number() OVER (PARTITION BY s.model, r.session ORDER BY s.score DESC, s.ticker) <=
  greatest(10, count(*) OVER (PARTITION BY s.model, r.session) // 5) AS held FROM snap s JOIN runs r ON r.model = s.model AND r.run_date = s.run_date LEFT JOIN cl e ON e.ticker = s.ticker AND e.date = r.session
  LEFT JOIN (SELECT * FROM cl WHERE date = (SELECT max(date) FROM cl)) x ON x.ticker = s.ticker""")
view("bk", """SELECT model, session, count(*) FILTER (held) AS k, count(*) FILTER (held AND ret IS NOT NULL) AS covered, round(avg(ret) FILTER (held), 4) AS basket_ret, round(avg(ret), 4) AS bench_ret,
  round(avg(ret) FILTER (held) - avg(ret), 4) AS excess, (SELECT max(date) FROM cl) - session AS age_days, (SELECT count(*) FROM sess s WHERE s.session > l.session AND s.session <= (SELECT max(date) FROM cl)) AS trading_days
  FROM lr l GROUP BY model, session""")
view("jp", """SELECT a.model, a.session AS a, b.session AS b, (SELECT count(*) FROM lr p JOIN lr q ON p.ticker = q.ticker AND p.held AND q.held AND p.model = a.model AND q.model = a.model AND p.session = a.session AND q.session = b.session) AS common, a.k AS ka, b.k AS kb
  FROM bk a JOIN bk b ON a.model = b.model AND a.session < b.session WHERE a.age_days > 0 AND b.age_days > 0 AND a.excess IS NOT NULL AND b.excess IS NOT NULL""")
view("pan0", """SELECT model, session, ticker, upside, score, quality, conf FROM (SELECT s.*, d.session FROM snap s JOIN sday d ON d.day = s.run_date::DATE WHERE d.session IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY model, session, ticker ORDER BY run_date) = 1""")
view("pan1", """SELECT p.*, s.pos, x.adjclose / e.adjclose - 1 AS fwd FROM pan0 p JOIN sess s USING (session) JOIN sess z ON z.pos = s.pos + 5 LEFT JOIN cl e ON e.ticker = p.ticker AND e.date = p.session
  LEFT JOIN cl x ON x.ticker = p.ticker AND x.date = z.session""")
view("panl", "SELECT p.*, sector, beta FROM pan1 p LEFT JOIN uattr USING (ticker) WHERE fwd IS NOT NULL QUALIFY count(*) OVER (PARTITION BY model, session) >= 30")
view("bneu", """SELECT model, session, ticker, upside, fwd - avg(fwd) OVER (PARTITION BY model, session, band) AS fwd FROM (SELECT *, least(4, (row_number() OVER (PARTITION BY model, session ORDER BY beta, ticker) - 1) * 5
  // count(*) OVER (PARTITION BY model, session)) AS band, count(*) OVER (PARTITION BY model, session) AS n FROM panl WHERE beta IS NOT NULL) WHERE n >= 15 QUALIFY count(*) OVER (PARTITION BY model, session, band) >= 3""")
view("sneu", """SELECT model, session, ticker, upside, fwd - avg(fwd) OVER w AS fwd FROM panl WINDOW w AS (PARTITION BY model, session, coalesce(sector, '?')) QUALIFY count(*) OVER w >= 3""")
view("icr", """SELECT model, session, 'upside' AS measure, upside AS x, fwd AS y FROM panl UNION ALL SELECT model, session, 'score', score, fwd FROM panl
  UNION ALL SELECT model, session, 'upside_sector_neutral', upside, fwd FROM sneu UNION ALL SELECT model, session, 'upside_beta_neutral', upside, fwd FROM bneu""")


def ranked(t, keys, v, out):
    """Average ranks where neighbours within the tolerance tie."""
    return (f"SELECT * EXCLUDE (rn_, new_, g_), avg(rn_) OVER (PARTITION BY {keys}, g_) AS {out} FROM (SELECT *, sum(new_) OVER (PARTITION BY {keys} ORDER BY rn_) AS g_ FROM "
            f"(SELECT *, row_number() OVER w AS rn_, CASE WHEN abs({v} - lag({v}) OVER w) <= greatest(1e-9 * greatest(abs({v}), abs(lag({v}) OVER w)), 1e-15) THEN 0 ELSE 1 END AS new_ FROM {t} WINDOW w AS (PARTITION BY {keys} ORDER BY {v})))")


def spearman(t, keys, x, y):
    r = ranked("(" + ranked(t, keys, x, "rx") + ")", keys, y, "ry")
    return f"SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 4) END AS ic FROM ({r}) GROUP BY {keys}"


view("ics", "SELECT * FROM (" + spearman("icr", "model, session, measure", "x", "y") + ") WHERE ic IS NOT NULL")
view("ica", "SELECT model, measure, count(*) AS sessions, round(avg(ic), 4) AS mean_ic, round(count(*) FILTER (ic > 0) / count(*), 3) AS hit_rate FROM ics GROUP BY 1, 2")
view("dec", """SELECT model, (p * 10 - 1) // n + 1 AS decile, count(*) AS n, round(avg(upside), 4) AS mean_upside, round(avg(fwd), 4) AS mean_fwd, round(median(fwd), 4) AS median_fwd, avg(beta) AS mb FROM
  (SELECT *, row_number() OVER (PARTITION BY model ORDER BY upside, session::VARCHAR || '|' || ticker) AS p, count(*) OVER (PARTITION BY model) AS n FROM panl) GROUP BY 1, 2""")
view("bands", """SELECT model, field, lo || '-' || hi AS band, upside, fwd FROM (SELECT model, upside, fwd, unnest(['conf', 'quality']) AS field, unnest([conf, quality]) AS v FROM panl)
  JOIN (VALUES ('conf', 1, 2), ('conf', 3, 3), ('conf', 4, 5), ('quality', 0, 39), ('quality', 40, 59), ('quality', 60, 79), ('quality', 80, 100)) b(field, lo, hi) USING (field) WHERE v BETWEEN lo AND hi""")
view("gre", """SELECT model, list_sort(list(DISTINCT pos)) AS ps, 1 AS i, 0::BIGINT AS n, NULL::BIGINT AS last FROM panl GROUP BY 1
  UNION ALL SELECT model, ps, i + 1, CASE WHEN last IS NULL OR ps[i] - last >= 3 THEN n + 1 ELSE n END, CASE WHEN last IS NULL OR ps[i] - last >= 3 THEN ps[i] ELSE last END FROM gre WHERE i <= len(ps)""")
view("cur_s", "SELECT s.* FROM snap s JOIN (SELECT model, max(run_date) AS run_date FROM snap GROUP BY 1) USING (model, run_date)")
view("base_s", """SELECT s.* FROM snap s JOIN (SELECT r.model, max(r.run_date) AS run_date FROM (SELECT model, run_date, count(*) AS m FROM snap GROUP BY 1, 2) r JOIN (SELECT model, max(run_date) AS now, count(*) AS n FROM cur_s GROUP BY 1) c
  ON c.model = r.model AND r.run_date::DATE <> c.now::DATE AND m >= 0.8 * n GROUP BY 1) USING (model, run_date)""")
view("dg", """SELECT coalesce(a.model, b.model) AS model, coalesce(a.ticker, b.ticker) AS ticker, a.upside AS nu, b.upside AS ou, a.quality AS nq, b.quality AS oq, a.conf AS nc, b.conf AS oc, a.score AS ns, a.ticker IS NOT NULL AS isn, b.ticker IS NOT NULL AS was,
  list_sort(list_filter(a.flags, lambda f: NOT list_contains(b.flags, f))) AS gained, list_sort(list_filter(b.flags, lambda f: NOT list_contains(a.flags, f))) AS lost FROM cur_s a FULL JOIN base_s b ON a.model = b.model AND a.ticker = b.ticker""")
view("dgr", """SELECT model, ticker, 'entered_zone' AS kind, '' AS detail, ns AS w FROM dg WHERE isn AND was AND nu > 0.15 AND nq >= 70 AND NOT (ou > 0.15 AND oq >= 70)
  UNION ALL SELECT model, ticker, 'left_zone', '', ns FROM dg WHERE isn AND was AND ou > 0.15 AND oq >= 70 AND NOT (nu > 0.15 AND nq >= 70)
  UNION ALL SELECT model, ticker, 'flagged', array_to_string(gained, '|'), ns FROM dg WHERE isn AND was AND len(gained) > 0
  UNION ALL SELECT model, ticker, 'cleared', array_to_string(lost, '|'), ns FROM dg WHERE isn AND was AND len(lost) > 0
  UNION ALL SELECT model, ticker, 'conf_jump', oc || '>' || nc, ns FROM dg WHERE isn AND was AND abs(nc - oc) >= 2
  UNION ALL SELECT model, ticker, 'big_move', '', abs(round(nu, 3) - round(ou, 3)) FROM dg WHERE isn AND was AND abs(nu - ou) >= 0.15
  UNION ALL SELECT model, ticker, 'new', '', ns FROM dg WHERE isn AND NOT was UNION ALL SELECT model, ticker, 'dropped', '', 0 FROM dg WHERE was AND NOT isn""")


def keep(c, label):
    return f"CASE WHEN {c} IS NULL THEN '{label}-neutral not measurable' WHEN {c} / nullif(r, 0) >= 0.5 THEN '{label}-neutral survives' ELSE 'mostly a {label} bet' END"


SQL = {
    "weekly_gate": sql("""WITH s AS (SELECT model, run_date, max(run_date::DATE) OVER (PARTITION BY model) AS top FROM snap),
      w AS (SELECT universe, model, run_date, run_date::DATE = top AND (universe <> 'again' OR hour(run_date) >= 12) AS fresh FROM s, (VALUES ('week'), ('skip'), ('again')) u(universe)),
      x AS (SELECT universe, model, fresh, CASE WHEN universe = 'week' AND NOT fresh THEN run_date - INTERVAL 7 DAY ELSE run_date END AS run_date FROM w),
      l AS (SELECT universe, model, max(run_date) AS last FROM x WHERE NOT fresh GROUP BY 1, 2),
      ok AS (SELECT x.* FROM x LEFT JOIN l USING (universe, model) WHERE fresh AND (last IS NULL OR last::DATE = run_date::DATE OR yearweek(last) <> yearweek(run_date)))
      SELECT universe, model, run_date::DATE::VARCHAR AS day, count(DISTINCT run_date) AS runs, count(*) AS n FROM (SELECT * FROM ok UNION ALL SELECT * FROM x WHERE NOT fresh
      AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.universe = x.universe AND ok.model = x.model AND ok.run_date::DATE = x.run_date::DATE)) GROUP BY 1, 2, 3"""),
    "change_digest": sql("SELECT model, kind, row_number() OVER (PARTITION BY model, kind ORDER BY w DESC, ticker) AS place, ticker, detail FROM dgr QUALIFY place <= 12"),
    "session_asof": sql("SELECT ticker, date::VARCHAR AS day, session::VARCHAR AS session FROM pxd JOIN sday ON day = date"),
    "run_collapse": sql("SELECT model, session::VARCHAR AS session, day::VARCHAR AS day, collapsed FROM runs"),
    "forward_ledger": sql("SELECT model, session::VARCHAR AS session, k, covered, k - covered AS missing, age_days, trading_days, basket_ret, bench_ret, excess FROM bk"),
    "ledger_summary": sql("""SELECT t.model, t.baskets, t.oldest_days, coalesce(a.aged, 0) AS aged, c.collapsed, coalesce(a.aged, 0) - coalesce(d.r, 0) AS distinct_baskets, a.hit_rate, a.avg_excess, o.avg_overlap
      FROM (SELECT model, count(*) AS baskets, max(age_days) AS oldest_days FROM bk GROUP BY 1) t LEFT JOIN (SELECT model, count(*) AS aged, round(count(*) FILTER (excess > 0) / count(*), 3) AS hit_rate, round(avg(excess), 6) AS avg_excess FROM bk WHERE age_days > 0 AND excess IS NOT NULL GROUP BY 1) a USING (model)
      LEFT JOIN (SELECT model, sum(collapsed)::BIGINT AS collapsed FROM runs GROUP BY 1) c USING (model) LEFT JOIN (SELECT model, round(avg(common / (ka + kb - common)), 3) AS avg_overlap FROM jp GROUP BY 1) o USING (model)
      LEFT JOIN (SELECT model, count(DISTINCT b) AS r FROM jp WHERE common = ka AND common = kb GROUP BY 1) d USING (model)"""),
    "calibration_panel": sql("SELECT model, session::VARCHAR AS session, ticker, sector, quality, conf, round(upside, 6) AS upside, round(fwd, 6) AS fwd, round(beta, 3) AS beta FROM panl"),
    "panel_dropped": sql("SELECT model, session::VARCHAR AS session, count(*) FILTER (fwd IS NULL) AS dropped, count(*) AS n FROM pan1 GROUP BY 1, 2"),
    "rank_ic": sql("SELECT model, session::VARCHAR AS session, measure, n, round(ic, 3) AS ic FROM ics WHERE measure IN ('upside', 'score')"),
    "neutral_ic": sql("SELECT model, session::VARCHAR AS session, measure, n, round(ic, 3) AS ic FROM ics WHERE measure LIKE '%neutral'"),
    "ic_series": sql("SELECT model, measure, sessions, round(mean_ic, 3) AS mean_ic, round(hit_rate, 2) AS hit_rate FROM ica"),
    "independent_windows": sql("SELECT model, n AS independent, len(ps) AS sessions, (n >= 4)::INT AS readable FROM gre WHERE i = len(ps) + 1"),
    "decile_table": sql("SELECT model, decile, n, mean_upside, mean_fwd, median_fwd, round(mb, 3) AS mean_beta FROM dec"),
    "ic_by_band": sql("SELECT s.model, s.field, s.band, s.n, round(s.ic, 3) AS ic, f.mean_fwd FROM (" + spearman("bands", "model, field, band", "upside", "fwd")
                      + ") s JOIN (SELECT model, field, band, round(avg(fwd), 4) AS mean_fwd FROM bands GROUP BY 1, 2, 3) f USING (model, field, band) WHERE s.n >= 30"),
    "calibration_verdict": sql(f"""SELECT model, CASE WHEN coalesce(g.n, 0) < 4 THEN 'not readable: ' || coalesce(g.n, 0) || ' of 4 independent windows' WHEN r IS NULL THEN 'no measurable IC' ELSE CASE WHEN r > 0 THEN 'upside predicts' ELSE 'upside anti-predicts' END || printf(' (IC %.4f)', r) || '; ' || {keep('s', 'sector')} || '; ' || {keep('b', 'beta')}
      || CASE WHEN abs(b1 - b0) > 0.15 THEN '; beta gap' ELSE '' END || printf('; top-bottom spread %.4f', round(t1 - t0, 4)) END AS verdict FROM (SELECT model, max(mean_ic) FILTER (measure = 'upside') AS r, max(mean_ic) FILTER (measure = 'upside_sector_neutral') AS s, max(mean_ic) FILTER (measure = 'upside_beta_neutral') AS b FROM ica GROUP BY 1)
      LEFT JOIN (SELECT model, arg_min(mb, decile) AS b0, arg_max(mb, decile) AS b1, arg_min(mean_fwd, decile) AS t0, arg_max(mean_fwd, decile) AS t1 FROM dec GROUP BY 1) USING (model)
      LEFT JOIN (SELECT model, n FROM gre WHERE i = len(ps) + 1) g USING (model)"""),
    "decile_spread": sql("SELECT model, arg_max(mean_fwd, decile) AS top, arg_min(mean_fwd, decile) AS bottom, round(arg_max(mean_fwd, decile) - arg_min(mean_fwd, decile), 4) AS spread FROM dec GROUP BY 1"),
    "equal_count_buckets": sql("""SELECT model, session::VARCHAR AS session, ticker, (row_number() OVER (PARTITION BY model, session ORDER BY score, ticker) * 7 - 1) // count(*) OVER (PARTITION BY model, session) AS bucket FROM panl"""),
    "beta_bands": sql("SELECT model, session::VARCHAR AS session, ticker, round(fwd, 6) AS fwd FROM bneu"),
    "sector_neutral": sql("SELECT model, session::VARCHAR AS session, ticker, round(fwd, 6) AS fwd FROM sneu"),
    "tolerant_ranks": sql("SELECT model, session::VARCHAR AS session, ticker, round(r, 1) AS avg_rank FROM (" + ranked("(SELECT *, conf / 3 * (1 + CASE WHEN ticker::BIGINT % 2 = 0 THEN 1e-15 ELSE 0 END) + floor(upside * 2) AS v FROM panl)", "model, session", "v", "r") + ")"),
}
SQL["snapshot_table"] = SQL["weekly_gate"]
