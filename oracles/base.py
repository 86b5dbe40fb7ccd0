"""Shared views: the sample tables shaped as the library's inputs, in SQL."""
import re

from equispan.plans import bindings as b

VIEWS: dict[str, str] = {}


def view(name, text):
    VIEWS[name] = text


def duck(text):
    text = re.sub(r"\b(\d+(?:\.\d+)?(?:e\d+)?)D\b", r"\1::DOUBLE", text)
    return re.sub(r"\bDIV\b", "//", text)


def sql(body):
    """The body with the views it needs in front, in the order they were defined."""
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(VIEWS[name])
    if not need:
        return body
    if body.startswith("WITH "):
        body = ", " + body[5:]
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in VIEWS if n in need)
    return f"WITH RECURSIVE {ctes}\n{body}"


def _case(col, keys):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{b.SECTORS[k]}'" for k in keys) + " END"


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

view("li", "SELECT *, cast(round(l_extendedprice * 100) AS bigint) AS c, cast(round(l_discount * 100) AS bigint) AS d, "
           "cast(round(l_tax * 100) AS bigint) AS t FROM lineitem")
SUMS = ("sum(c) AS ext, sum(c * (100 - d)) AS net, sum(c * t) AS tax, sum(c * d) AS disc, "
        "sum(CASE WHEN l_linestatus = 'O' THEN c ELSE 0 END) AS ext_o, "
        "sum(CASE WHEN l_returnflag = 'N' THEN c ELSE 0 END) AS ext_n")
SCALED = ("ext::DOUBLE * 100 AS ext, net::DOUBLE AS net, tax::DOUBLE AS tax, disc::DOUBLE AS disc, "
          "ext_o::DOUBLE * 100 AS ext_o, ext_n::DOUBLE * 100 AS ext_n")
C1 = ", ".join(f"{duck(v)} AS {k}" for k, v in b.CONCEPT_SQL.items())
C2 = ", ".join(f"{duck(v)} AS {k}" for k, v in b.CONCEPT_SQL2.items())
view("fin_base", f"SELECT k, fiscal_year, {SCALED} FROM (SELECT o_custkey AS k, year(o_orderdate) AS fiscal_year, {SUMS} "
                 "FROM li JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)")
view("fin_half", f"SELECT k, fiscal_year, {C1} FROM fin_base")
view("fw", f"SELECT *, k::VARCHAR AS ticker, {C2}, "
           "1e7::DOUBLE * (1 + k % 97) * (1 + 0.01::DOUBLE * ((k + fiscal_year) % 3 - 1)) AS shares FROM fin_half")
LONG = ", ".join([*b.WIDE_CONCEPTS, "shares"])
view("fin", f"SELECT ticker, fiscal_year, concept, value FROM (SELECT ticker, fiscal_year, {LONG} FROM fw) "
            f"UNPIVOT (value FOR concept IN ({LONG}))")
view("now_t", "SELECT f.ticker, f.concept, f.v * 1.04::DOUBLE AS value, o.thru, CASE WHEN concept IN ('cash', 'equity', 'assets') "
              "THEN 'instant' ELSE 'ttm' END AS basis FROM (SELECT ticker, concept, arg_max(value, fiscal_year) AS v FROM fin "
              f"WHERE concept IN ({', '.join(repr(c) for c in b.NOW_CONCEPTS)}) AND ticker::BIGINT % 3 = 0 GROUP BY ALL) f "
              "JOIN (SELECT o_custkey::VARCHAR AS ticker, max(o_orderdate)::DATE AS thru FROM orders GROUP BY 1) o USING (ticker)")
NAME = ("{n} || CASE {k} % 4 WHEN 0 THEN ' INC' WHEN 1 THEN ' CORP /DE/' WHEN 2 THEN ' CLASS A' ELSE '' END")
view("comp", f"""SELECT c.ticker, {NAME.format(n='c_name', k='k')} AS name, lpad(c.ticker, 10, '0') AS cik,
  {_case('c_mktsegment', SEGMENTS)} AS sector, (0.5::DOUBLE + (k % 13) / 4::DOUBLE) * rev / (1e7::DOUBLE * (1 + k % 97)) AS price,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE 1e7::DOUBLE * (1 + k % 97) END AS shares_out, 'USD' AS fin_currency,
  lpad((c_nationkey * 97 + 1000)::VARCHAR, 4, '0') AS sic, CASE WHEN k % 11 = 0 THEN '20-F' ELSE '10-K' END AS form
  FROM (SELECT *, c_custkey AS k, c_custkey::VARCHAR AS ticker FROM customer) c LEFT JOIN
  (SELECT ticker, arg_max(value, fiscal_year) AS rev FROM fin WHERE concept = 'revenue' GROUP BY 1) r USING (ticker)""")
view("cbeta", "SELECT c_custkey::VARCHAR AS ticker, 0.5::DOUBLE + (c_custkey % 16) / 10::DOUBLE AS beta FROM customer WHERE c_custkey % 10 <> 0")
view("umem", "SELECT unnest(CASE WHEN c_custkey % 2 = 0 THEN ['sp1500', 'sp500'] ELSE ['sp1500'] END) AS universe, c_custkey::VARCHAR AS ticker FROM customer")
view("xmcap", "SELECT ticker, price * (1e7::DOUBLE * (1 + ticker::BIGINT % 97) * (0.8::DOUBLE + (ticker::BIGINT % 9) * 0.05::DOUBLE)) AS ext_mcap "
              "FROM comp WHERE ticker::BIGINT % 9 <> 0")
view("pxm", "SELECT l_suppkey::VARCHAR AS ticker, month, "
            "close, close * (0.7::DOUBLE + ((year(month) - 1995) * 12 + month(month)) / 400::DOUBLE) AS adjclose FROM "
            "(SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS month, sum(c) / 100 / sum(l_quantity::BIGINT) AS close FROM li GROUP BY ALL)")
view("mkt", "SELECT month, avg(adjclose) AS adjclose FROM pxm GROUP BY 1")
view("ssec", f"SELECT s_suppkey::VARCHAR AS ticker, {_case('r_name', REGIONS)} AS sector FROM supplier "
             "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
view("spl", "SELECT l_suppkey::VARCHAR AS ticker, date_trunc('month', min(l_shipdate))::DATE AS sdate, 2.0::DOUBLE AS factor "
            "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 10 = 0 GROUP BY 1")
view("rfm", "SELECT month, 0.02::DOUBLE + ((s // n) % 3000000) / 1e8::DOUBLE AS rate FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month, "
            "sum(cast(round(o_totalprice * 100) AS bigint))::BIGINT AS s, count(*) AS n FROM orders GROUP BY 1) "
            "WHERE (year(month) * 12 + month(month)) % 7 <> 0")
view("pit_m", f"SELECT l_suppkey AS k, date_trunc('month', l_shipdate)::DATE AS month, {SUMS} FROM li GROUP BY ALL")
CUM = ", ".join(f"sum({c}) OVER w AS {c}" for c in b.BASE_COLS)
view("pit_c", f"SELECT k, year(month) AS fiscal_year, (last_day(month) + 40) AS filed, {CUM} FROM pit_m "
              "WINDOW w AS (PARTITION BY k, year(month) ORDER BY month)")
view("pit_h", f"SELECT k, fiscal_year, filed, {C1} FROM (SELECT k, fiscal_year, filed, {SCALED} FROM pit_c)")
view("pit_w", f"SELECT *, k::VARCHAR AS ticker, {C2}, 1.5e7::DOUBLE * (1 + k % 5) AS shares_wab FROM pit_h")
PL = ", ".join(b.PIT_CONCEPTS)
view("pit", f"SELECT ticker, concept, fiscal_year AS fy, filed::DATE AS filed, make_date(fiscal_year, 12, 31) AS end_date, value FROM "
            f"(SELECT ticker, fiscal_year, filed, {PL} FROM pit_w) UNPIVOT (value FOR concept IN ({PL}))")
view("ev", "SELECT event_id, ts, ts::DATE AS day, user_id::VARCHAR AS ticker, user_id, event_type, cast(round(value * 100) AS bigint) AS v FROM events")
view("chg", "SELECT day AS date, event_id AS row_no, CASE WHEN event_type = 'signup' THEN ticker END AS added, "
            "CASE WHEN event_type = 'error' THEN ticker END AS removed FROM ev WHERE event_type IN ('signup', 'error')")
view("cur", "SELECT ticker FROM (SELECT ticker, arg_max(event_type, event_id) AS last FROM ev WHERE event_type IN ('signup', 'error') GROUP BY 1) WHERE last = 'signup'")
view("pxd", "SELECT ticker, day AS date, 1 + sum(v) / 100 / count(*) AS adjclose FROM ev GROUP BY ALL")
view("sess", "SELECT day AS session, row_number() OVER (ORDER BY day) AS pos FROM (SELECT DISTINCT day FROM ev WHERE isodow(day) < 6)")
view("snap", """SELECT r.run_date, 'U' AS universe, CASE WHEN day(s.day) <= 15 THEN 'm1' ELSE 'm2' END AS model, ticker,
  1 + sv / 100 / n AS price, sv / 100::DOUBLE AS score, (sv * tn)::BIGINT / tv::DOUBLE - 1 AS upside, (2 + user_id % 4)::INT AS conf,
  (user_id % 101)::INT AS quality, flags FROM
  (SELECT day, hour(ts) >= 12 AS half, ticker, user_id, sum(v)::BIGINT AS sv, count(*) AS n, list_sort(list(DISTINCT event_type)) AS flags FROM ev GROUP BY 1, 2, 3, 4) s
  JOIN (SELECT day, hour(ts) >= 12 AS half, max(ts) AS run_date FROM ev GROUP BY 1, 2) r ON r.day = s.day AND r.half = s.half
  JOIN (SELECT day, half, sum(sv)::BIGINT AS tv, count(*) AS tn FROM (SELECT day, hour(ts) >= 12 AS half, ticker, sum(v) AS sv FROM ev GROUP BY 1, 2, 3) GROUP BY 1, 2) t
  ON t.day = s.day AND t.half = s.half""")
SEC_LIST = list(dict.fromkeys(b.SECTORS.values()))
view("uattr", f"SELECT DISTINCT ticker, {SEC_LIST}[user_id % 5 + 1] AS sector, CASE WHEN user_id % 10 = 0 THEN NULL "
              "ELSE 0.5::DOUBLE + (user_id % 16) / 10::DOUBLE END AS beta FROM ev")
view("facts", """SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, CASE WHEN o_custkey % 5 = 0 THEN 'ifrs-full' ELSE 'us-gaap' END AS ns,
  'Tag_' || o_orderstatus AS tag, CASE WHEN o_custkey % 7 = 0 AND o_orderkey % 4 <> 0 THEN 'EUR' ELSE 'USD' END AS unit,
  (CASE WHEN month(e) = 12 THEN last_day(e - INTERVAL 12 MONTH) ELSE date_trunc('year', e) END)::DATE AS "start", e AS "end",
  o_totalprice AS val, (e + (o_orderkey % 90)::INT)::DATE AS filed, CASE WHEN month(e) = 12 THEN '10-K' ELSE '10-Q' END AS form,
  CASE WHEN month(e) = 12 THEN 'FY' ELSE 'Q' END AS fp, o_orderkey AS pos FROM (SELECT *, last_day(o_orderdate)::DATE AS e FROM orders)""")
view("ftags", "SELECT * FROM (VALUES " + ", ".join(map(str, b.FACT_TAGS)) + ") t(ns, concept, tag, tag_rank)")
view("shf", """SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, CASE WHEN o_orderpriority[1] = '1' THEN 'dei' ELSE 'us-gaap' END AS ns,
  CASE o_orderpriority[1] WHEN '1' THEN 'EntityCommonStockSharesOutstanding' WHEN '2' THEN 'CommonStockSharesOutstanding'
  WHEN '3' THEN 'CommonStockSharesIssued' ELSE 'WeightedAverageNumberOfSharesOutstandingBasic' END AS tag,
  o_orderdate::DATE AS "end", CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_totalprice END AS val, (o_orderdate::DATE + (o_orderkey % 90)::INT)::DATE AS filed,
  CASE WHEN o_custkey % 13 = 0 THEN '6-K' WHEN o_custkey % 11 = 0 THEN '20-F' ELSE '10-K/A' END AS form, o_orderkey AS pos FROM orders""")
view("filers", f"""SELECT lpad(k::VARCHAR, 10, '0') AS cik, {NAME.format(n='c_name', k='k')} AS name,
  CASE WHEN k % 8 = 0 THEN '' ELSE lpad((c_nationkey * 97 + 1000)::VARCHAR, 4, '0') END AS sic,
  CASE WHEN k % 6 = 0 THEN []::VARCHAR[] ELSE ['T' || (CASE WHEN k % 5 = 0 THEN k // 2 ELSE k END)::VARCHAR] END AS tickers,
  CASE WHEN k % 3 = 0 THEN ['NYSE'] ELSE ['Nasdaq'] END AS exchanges,
  CASE WHEN k % 7 = 0 THEN ['Old ' || c_name || ' Holdings, Inc.'] ELSE []::VARCHAR[] END AS former_names
  FROM (SELECT *, c_custkey AS k FROM customer)""")
