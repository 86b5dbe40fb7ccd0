from .base import sql, view

ANN = "(form LIKE '10-K%' OR form LIKE '20-F%' OR form LIKE '40-F%') AND fp = 'FY'"
view("fmap", "SELECT f.*, t.concept, t.tag_rank FROM facts f JOIN ftags t USING (ns, tag)")
view("fccy", f"""SELECT cik, ns, CASE WHEN max(CASE WHEN unit = 'USD' THEN n ELSE 0 END) >= 5 THEN 'USD' ELSE
  first(unit ORDER BY n DESC, unit) END AS ccy FROM (SELECT cik, ns, unit, count(*) FILTER ({ANN}) AS n FROM fmap
  WHERE concept = 'revenue' GROUP BY ALL) GROUP BY cik, ns""")
view("fpick", """SELECT m.*, ccy FROM fmap m LEFT JOIN fccy USING (cik, ns) QUALIFY CASE
  WHEN max((unit = ccy)::INT) OVER (PARTITION BY cik, ns, tag) = 1 THEN unit = ccy ELSE ccy IS NULL END""")
view("fann", f"""SELECT cik, ns, concept, year("end") AS fiscal_year, val AS value FROM fpick WHERE {ANN}
  AND date_diff('day', "start", "end") BETWEEN 350 AND 380
  QUALIFY row_number() OVER (PARTITION BY cik, ns, concept, year("end") ORDER BY filed DESC, tag_rank, pos) = 1""")
view("fdur", """SELECT cik, ns, concept, "start" AS s, "end" AS e, val AS v, date_diff('day', "start", "end") AS d FROM fpick
  WHERE form LIKE '10-Q%' OR form LIKE '10-K%'
  QUALIFY row_number() OVER (PARTITION BY cik, ns, concept, "start", "end" ORDER BY filed DESC, tag_rank, pos) = 1""")
# the filings in this binding are all year-to-date spans, so the walk has a single link
view("ffy", """SELECT * FROM fdur WHERE d BETWEEN 350 AND 380 QUALIFY row_number() OVER (PARTITION BY cik, ns, concept ORDER BY e DESC, s) = 1""")
view("fpost", """SELECT p.*, f.e AS fy_end, f.v AS fy_v FROM fdur p JOIN ffy f USING (cik, ns, concept) WHERE p.s >= f.e AND p.e > f.e AND p.d < 350""")
view("flink", """SELECT * FROM fpost QUALIFY row_number() OVER (PARTITION BY cik, ns, concept ORDER BY e DESC, d DESC, s) = 1""")
view("fmir", """SELECT l.cik, l.ns, l.concept, first(m.v ORDER BY m.s, m.e) AS mv FROM flink l JOIN fdur m USING (cik, ns, concept)
  WHERE abs(date_diff('day', l.s, m.s) + 365) <= 10 AND abs(date_diff('day', l.e, m.e) + 365) <= 10 GROUP BY 1, 2, 3""")
view("fttm", """SELECT f.cik, f.ns, f.concept,
  CASE WHEN mv IS NOT NULL AND abs(date_diff('day', l.s, f.e)) <= 10 THEN f.v + (l.v - mv) ELSE f.v END AS value,
  CASE WHEN mv IS NOT NULL AND abs(date_diff('day', l.s, f.e)) <= 10 THEN l.e ELSE f.e END AS thru,
  CASE WHEN mv IS NOT NULL AND abs(date_diff('day', l.s, f.e)) <= 10 THEN 'ttm' ELSE 'fy' END AS basis
  FROM ffy f LEFT JOIN flink l USING (cik, ns, concept) LEFT JOIN fmir m USING (cik, ns, concept)""")
view("finst", """SELECT cik, ns, concept, val AS value, "end" AS thru FROM fpick
  QUALIFY row_number() OVER (PARTITION BY cik, ns, concept ORDER BY "end" DESC, filed DESC, tag_rank, pos) = 1""")
view("span", "SELECT min(l_shipdate)::DATE AS a, max(l_shipdate)::DATE AS z FROM lineitem")
view("qd", """SELECT q AS qdate FROM (SELECT a, z, last_day(m)::DATE AS q FROM (SELECT a, z, unnest(generate_series(date_trunc('quarter', a) + INTERVAL 2 MONTH, z + INTERVAL 3 MONTH,
  INTERVAL 3 MONTH)) AS m FROM span)) WHERE q BETWEEN a AND z""")
view("pasof", """SELECT qdate, ticker, concept, fy, arg_max(value, filed) AS value FROM pit JOIN qd ON filed <= qdate GROUP BY ALL""")
view("shasof", """SELECT b.qdate, b.ticker, b.end_date, b.value * coalesce(power(2.0, count(s.sdate)), 1) AS shares FROM
  (SELECT qdate, ticker, end_date, value FROM pit JOIN qd ON filed <= qdate WHERE concept = 'shares_wab'
   QUALIFY row_number() OVER (PARTITION BY qdate, ticker ORDER BY end_date DESC, filed) = 1) b
  LEFT JOIN spl s ON s.ticker = b.ticker AND s.sdate > b.end_date GROUP BY b.qdate, b.ticker, b.end_date, b.value""")

SQL = {
    "tag_mapping": sql("SELECT ns, concept, tag_rank, count(*) AS n, count(DISTINCT cik) AS filers FROM fmap GROUP BY ALL"),
    "annual_pick": sql("SELECT cik, ns, concept, fiscal_year, round(value, 2) AS value FROM fann"),
    "unit_selection": sql("SELECT cik, ns, tag, unit, count(*) AS n FROM fpick GROUP BY ALL"),
    "reporting_currency": sql("SELECT * FROM fccy"),
    "namespace_fallback": sql("""SELECT cik, ns, concept, fiscal_year, round(value, 2) AS value FROM fann WINDOW w AS (PARTITION BY cik) QUALIFY
      ns = CASE WHEN max((ns = 'us-gaap' AND concept IN ('revenue', 'net_income'))::INT) OVER w = 1 THEN 'us-gaap'
      WHEN max((concept IN ('revenue', 'net_income'))::INT) OVER w = 1 THEN 'ifrs-full' END"""),
    "namespace_revenue_only": sql("""SELECT cik, ns, count(*) AS n FROM (SELECT * FROM fann WINDOW w AS (PARTITION BY cik) QUALIFY
      ns = CASE WHEN max((ns = 'us-gaap' AND concept = 'revenue')::INT) OVER w = 1 THEN 'us-gaap'
      WHEN max((concept = 'revenue')::INT) OVER w = 1 THEN 'ifrs-full' END) GROUP BY 1, 2"""),
    "duration_points": sql('SELECT cik, ns, concept, s::VARCHAR AS "start", e::VARCHAR AS "end", round(v, 2) AS value FROM fdur'),
    "ttm_stitch": sql("SELECT cik, ns, concept, thru::VARCHAR AS thru, basis, round(value, 2) AS value FROM fttm"),
    "freshest_instant": sql("SELECT cik, ns, concept, thru::VARCHAR AS thru, round(value, 2) AS value FROM finst"),
    "financials_now": sql("""SELECT cik, ns, concept, thru::VARCHAR AS thru, basis, round(value, 2) AS value FROM fttm WHERE concept <> 'cash'
      UNION ALL SELECT cik, ns, concept, thru::VARCHAR, 'instant', round(value, 2) FROM finst WHERE concept = 'cash'"""),
    "fx_to_usd": sql("""SELECT ticker, concept, fiscal_year, round(value * (CASE WHEN c_nationkey = 0 OR concept = 'shares' THEN 1
      ELSE 1 + c_nationkey / 100 END) / 999983.0::DOUBLE, 6) AS value_m FROM fin JOIN customer ON c_custkey::VARCHAR = ticker
      WHERE concept = 'shares' OR c_nationkey % 7 <> 3"""),
    "current_shares": sql("""WITH n AS (SELECT cik, tag, "end", val, CASE WHEN ns = 'dei' THEN 'dei' WHEN tag LIKE 'Weighted%' THEN 'wab' ELSE 'pit' END AS src
      FROM shf WHERE val <> 0 QUALIFY row_number() OVER (PARTITION BY cik, tag ORDER BY "end" DESC, filed DESC, pos) = 1),
      w AS (SELECT cik, val, src, max(CASE WHEN src = 'wab' THEN val END) OVER (PARTITION BY cik) AS wab FROM n
      QUALIFY row_number() OVER (PARTITION BY cik ORDER BY "end" DESC, val DESC, src DESC) = 1)
      SELECT cik, round(CASE WHEN wab <> 0 AND src <> 'wab' AND val < 0.6::DOUBLE * wab THEN wab ELSE val END, 2) AS shares_out FROM w"""),
    "filer_form": sql("""SELECT cik, CASE WHEN count(*) FILTER (form LIKE '10-K%') > 0 THEN '10-K'
      WHEN count(*) FILTER (form LIKE '20-F%' OR form LIKE '40-F%') > 0 THEN '20-F' END AS form FROM shf GROUP BY cik"""),
    "pit_vintages": sql(f"""SELECT cik, ns, concept, year("end") AS fy, filed::VARCHAR AS filed, "end"::VARCHAR AS end_date, round(val, 2) AS value
      FROM fpick WHERE {ANN} QUALIFY row_number() OVER (PARTITION BY cik, ns, concept, year("end"), filed ORDER BY tag_rank, pos) = 1"""),
    "series_asof": sql("SELECT qdate::VARCHAR AS qdate, ticker, concept, fy, round(value / 999983.0::DOUBLE, 6) AS value_m FROM pasof"),
    "shares_asof": sql("SELECT qdate::VARCHAR AS qdate, ticker, end_date::VARCHAR AS end_date, round(shares, 1) AS shares FROM shasof"),
    "facts_json_corpus": sql("""SELECT cik, ns, tag, unit, "start"::VARCHAR AS "start", "end"::VARCHAR AS "end", filed::VARCHAR AS filed, form, fp,
      dense_rank() OVER (PARTITION BY cik, ns ORDER BY tag) - 1 AS tag_ord, row_number() OVER (PARTITION BY cik, ns, tag, unit ORDER BY "end" NULLS FIRST, filed NULLS FIRST,
      "start" NULLS FIRST, form NULLS FIRST, fp NULLS FIRST, val NULLS FIRST) - 1 AS pos, round(val, 2) AS val FROM facts
      UNION ALL SELECT NULL, 'not JSON of this form', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT cik) FROM facts"""),
}
