from equispan.assumptions import load
from .base import sql, view
from . import fundamentals  # noqa: F401  (views)

NOISE = "('INC','CORP','CORPORATION','CO','COMPANY','LTD','LLC','LP','PLC','THE','GROUP','HOLDINGS','HOLDING','COM','NEW','&')"


def words(col):
    """Words of a name after the marks are cleaned away."""
    t = rf"regexp_replace(upper({col}), '\([^)]*\)', ' ', 'g')"
    t = f"replace(replace(replace({t}, ' /DE/', ''), ' /MD/', ''), ' /DE', '')"
    t = f"regexp_replace({t}, '[''’.]', '', 'g')"
    return f"list_filter(string_split_regex(regexp_replace({t}, '[/,\\\\-]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


def norm(ws):
    return (f"array_to_string(list_filter({ws}, lambda w, i: w NOT IN {NOISE} AND NOT (w IN ('CLASS', 'CL') AND "
            f"coalesce(len({ws}[i + 1]) = 1, false)) AND NOT (w IN ('A', 'B', 'C') AND i > 1 AND {ws}[i - 1] IN ('CLASS', 'CL'))), ' ')")


_T = load()["overrides"]
PINS = ", ".join([f"('{t}', '{v}', NULL, NULL)" for t, v in _T["archetype"].items()] + [f"('{t}', NULL, '{v}', NULL)" for t, v in _T["cik"].items()]
                 + [f"('{t}', NULL, NULL, '{v}')" for t, v in _T["subsector"].items()])
SUB = ", ".join(f"('{k}', '{v}')" for k, v in load()["subsector_by_sic"].items())
SIC = ", ".join(f"('{k}', '{v}')" for k, v in load()["sector_by_sic"].items())
view("sicmap", f"SELECT * FROM (VALUES {SIC}) t(prefix, sector)")
view("fil", "SELECT * FROM filers WHERE len(tickers) > 0 OR sic <> ''")
view("fnames", f"""SELECT cik, norm FROM (SELECT cik, {norm('ws')} AS norm FROM (SELECT cik, {words('n')} AS ws FROM
  (SELECT cik, unnest(list_concat([name], former_names)) AS n FROM fil))) GROUP BY ALL""")
view("lists", """SELECT universe, ticker, CASE WHEN universe = 'ndx' THEN upper(name) ELSE name END AS name,
  CASE WHEN universe = 'sp500' THEN sector ELSE 'ICB ' || sector END AS sector FROM comp, (VALUES ('ndx'), ('sp500'), ('nyse')) u(universe)
  WHERE CASE universe WHEN 'ndx' THEN ticker::BIGINT % 3 = 0 WHEN 'sp500' THEN ticker::BIGINT % 4 = 0 ELSE ticker::BIGINT % 5 <> 0 END""")
view("dnames", f"""SELECT ticker, {norm('ws')} AS key FROM (SELECT ticker, {words('name')} AS ws FROM (SELECT 'D' || c_custkey AS ticker,
  CASE c_custkey % 10 WHEN 3 THEN c_name || ', Corporation' WHEN 4 THEN substr(c_name, 10) WHEN 5 THEN substr(c_name, 1, 16)
  WHEN 7 THEN 'The Old ' || c_name WHEN 8 THEN substr(c_name, 15) ELSE c_name END AS name FROM customer))""")
view("xck", """SELECT ticker, price, shares_out, ext_mcap, price * shares_out / ext_mcap - 1 AS diff,
  CASE WHEN ext_mcap IS NULL THEN 'no_ext' WHEN shares_out IS NULL THEN 'derived' WHEN abs(price * shares_out / ext_mcap - 1) <= 0.05 THEN 'ok'
  WHEN abs(price * shares_out / ext_mcap - 1) <= 0.15 THEN 'drift' ELSE 'patched' END AS status
  FROM comp LEFT JOIN xmcap USING (ticker) WHERE price IS NOT NULL""")

SQL = {
    "filer_headers": sql("""SELECT f.cik, f.name, f.sic, array_to_string(tickers, ',') AS tickers, array_to_string(exchanges, ',') AS exchanges,
      n.norm_names FROM fil f JOIN (SELECT cik, string_agg(norm, ' | ' ORDER BY norm) AS norm_names FROM fnames GROUP BY 1) n USING (cik)"""),
    "name_normalization": sql(f"""SELECT name, {norm('ws')} AS norm_name FROM (SELECT name, {words('name')} AS ws FROM (SELECT
      CASE k % 7 WHEN 0 THEN 'The ' || n || ' Group, Inc.' WHEN 1 THEN n || ' Corp /DE/' WHEN 2 THEN n || ' (Old) Holdings Class A'
      WHEN 3 THEN n || ' Co. CL B' WHEN 4 THEN 'O''' || n || '-West & Co' WHEN 5 THEN n || ' /MD/ New A' ELSE n END AS name FROM
      (SELECT s_name AS n, s_suppkey AS k FROM supplier UNION ALL SELECT c_name, c_custkey FROM customer)))"""),
    "delisted_name_resolve": sql("""WITH ex AS (SELECT ticker, count(DISTINCT cik) AS n, min(cik) AS cik FROM dnames JOIN fnames ON key = norm GROUP BY 1),
      sub AS (SELECT ticker, count(DISTINCT cik) AS n, min(cik) AS cik FROM dnames JOIN fnames ON contains(norm, key) GROUP BY 1)
      SELECT d.ticker, CASE WHEN ex.n = 1 THEN ex.cik WHEN ex.n > 1 THEN NULL WHEN sub.n = 1 THEN sub.cik END AS cik
      FROM dnames d LEFT JOIN ex USING (ticker) LEFT JOIN sub USING (ticker)"""),
    "namesake_guard": sql(f"""WITH p AS (SELECT lpad((CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 1 ELSE c_custkey END)::VARCHAR, 10, '0') AS cik,
      CASE WHEN c_custkey % 3 = 0 THEN substr(c_name, 1, 8) || ' ' || substr(c_name, 9) ELSE c_name END AS name FROM customer),
      k AS (SELECT cik, name, replace({norm('ws')}, ' ', '') AS key FROM (SELECT *, {words('name')} AS ws FROM p))
      SELECT k.cik, k.name, coalesce(max(contains(replace(norm, ' ', ''), key)::INT), 0) AS matches FROM k LEFT JOIN fnames USING (cik) GROUP BY ALL"""),
    "ticker_to_cik": sql("""SELECT ticker, first(cik ORDER BY src, cik) AS cik FROM (SELECT unnest(tickers) AS ticker, cik, 2 AS src FROM fil
      UNION ALL SELECT 'T' || s_suppkey, lpad((s_suppkey + 900000)::VARCHAR, 10, '0'), 1 FROM supplier WHERE s_suppkey % 4 = 0
      UNION ALL SELECT 'T' || n_nationkey, lpad((n_nationkey + 5000000)::VARCHAR, 10, '0'), 0 FROM nation WHERE n_nationkey % 5 = 0) GROUP BY 1"""),
    "share_class_dedupe": sql("""SELECT lpad((c_custkey // 3)::VARCHAR, 10, '0') AS cik, c_custkey::VARCHAR AS ticker, c_name AS name FROM customer
      QUALIFY row_number() OVER (PARTITION BY c_custkey // 3 ORDER BY c_custkey::VARCHAR) = 1"""),
    "resume_ingest": sql("""SELECT ticker, name FROM (SELECT ticker, name FROM comp UNION ALL SELECT 'N' || ticker, name FROM comp) WHERE ticker NOT IN (SELECT ticker FROM
      (SELECT ticker, concept FROM fin UNION ALL SELECT 'N' || ticker, concept FROM fin WHERE concept IN ('revenue', 'ebit', 'cash', 'equity')) GROUP BY 1 HAVING count(DISTINCT concept) >= 15)"""),
    "constituent_lists": sql("""SELECT ticker, name, sector FROM lists QUALIFY row_number() OVER (PARTITION BY ticker
      ORDER BY CASE universe WHEN 'sp500' THEN 1 WHEN 'ndx' THEN 2 ELSE 3 END) = 1"""),
    "universe_union": sql("""SELECT ticker, first(name ORDER BY CASE universe WHEN 'ndx' THEN 0 WHEN 'sp500' THEN 1 ELSE 3 END) AS name,
      first(sector ORDER BY CASE universe WHEN 'sp500' THEN 0 WHEN 'ndx' THEN 1 ELSE 3 END) AS sector,
      string_agg(universe, ',' ORDER BY universe) AS universes FROM lists GROUP BY 1"""),
    "resolved_assumptions": sql(f"""WITH pins AS (SELECT ticker, max(a) AS a, max(c) AS c, max(bk) AS bk, row_number() OVER (ORDER BY ticker) AS k FROM (SELECT t AS ticker, a, c, bk FROM (VALUES {PINS}) v(t, a, c, bk)) GROUP BY 1),
      x AS (SELECT coalesce(p.ticker, m.ticker) AS ticker, coalesce(c, cik) AS cik, a AS archetype_pin, bk, CASE WHEN m.ticker::BIGINT % 2 = 0 THEN sic ELSE lpad((3570 + m.ticker::BIGINT % 110)::VARCHAR, 4, '0') END AS sic,
        CASE WHEN m.ticker::BIGINT % 3 = 0 THEN NULL ELSE sector END AS own, price * shares_out AS mcap FROM comp m LEFT JOIN pins p ON p.k = m.ticker::BIGINT)
      SELECT x.ticker, cik, archetype_pin, coalesce(bk, sb.bucket) AS bucket, coalesce(own, a.sector, b.sector, c.sector) AS sector, coalesce(a.sector, b.sector, c.sector) AS sic_sector,
        CASE WHEN mcap IS NULL THEN NULL WHEN mcap >= 10e9 THEN 0.0 WHEN mcap >= 2e9 THEN 0.003 WHEN mcap >= 0.5e9 THEN 0.008 ELSE 0.015 END::DOUBLE AS size_premium,
        coalesce((mcap >= 15e9)::INT + (mcap >= 3e9)::INT + (mcap >= 0.3e9)::INT + (mcap >= 1e9)::INT, 0) AS n_universes
      FROM x LEFT JOIN sicmap a ON a.prefix = x.sic LEFT JOIN sicmap b ON b.prefix = x.sic[1:3] LEFT JOIN sicmap c ON c.prefix = x.sic[1:2]
      LEFT JOIN (VALUES {SUB}) sb(sic, bucket) ON sb.sic = x.sic"""),
    "sic_sector": sql("""SELECT p.p_partkey, p.sic, coalesce(a.sector, b.sector, c.sector) AS sector FROM
      (SELECT p_partkey, lpad(((p_partkey * 7) % 9000 + 100)::VARCHAR, 4, '0') AS sic FROM part) p LEFT JOIN sicmap a ON a.prefix = p.sic
      LEFT JOIN sicmap b ON b.prefix = p.sic[1:3] LEFT JOIN sicmap c ON c.prefix = p.sic[1:2]"""),
    "listed_census": sql("""WITH fr AS (SELECT cik, CASE WHEN count(*) FILTER (form LIKE '10-K%') > 0 THEN '10-K'
      WHEN count(*) FILTER (form LIKE '20-F%') > 0 THEN '20-F' END AS form FROM shf GROUP BY 1)
      SELECT f.cik, tickers[1] AS ticker, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name,
      coalesce(a.sector, b.sector, c.sector) AS sector, form FROM fil f JOIN fr USING (cik) LEFT JOIN sicmap a ON a.prefix = sic
      LEFT JOIN sicmap b ON b.prefix = sic[1:3] LEFT JOIN sicmap c ON c.prefix = sic[1:2]
      WHERE form IS NOT NULL AND exchanges[1] = 'NYSE' AND len(tickers) > 0 AND sic NOT LIKE '%9' AND sic NOT IN ('6726', '6221', '6770', '6792')
      AND coalesce(a.sector, b.sector, c.sector) IS NOT NULL"""),
    "hygiene_reason": sql("""SELECT c_custkey::VARCHAR AS ticker, CASE WHEN c_custkey % 30 BETWEEN 1 AND 9 THEN 'sub-$1 share price (L0 hygiene)'
      WHEN c_custkey % 23 = 0 THEN 'SPAC / blank-check shell (SIC 6770)' WHEN c_custkey % 17 = 0 OR c_custkey % 19 = 0
      THEN 'non-common instrument (warrant/right/preferred)' END AS hygiene FROM customer"""),
    "universe_floor": sql("""SELECT universe, ticker FROM umem LEFT JOIN comp USING (ticker)
      WHERE universe <> 'sp500' OR coalesce(price * shares_out, 0) >= 5e9"""),
    "coverage_regression": sql("""WITH c AS (SELECT concept, count(DISTINCT ticker) AS n FROM fin GROUP BY 1),
      p AS (SELECT concept, CASE WHEN concept[1] IN ('a', 'c', 's') THEN n * 11 // 10 ELSE n END AS before, n FROM c)
      SELECT concept, before, n AS now FROM p WHERE n < before * 0.95"""),
    "ghost_tripwire": sql("""SELECT c.ticker, c.cik, count(f.concept) AS facts FROM (SELECT ticker, cik FROM comp UNION ALL SELECT 'G' || ticker, cik FROM comp) c LEFT JOIN
      (SELECT ticker, concept FROM fin UNION ALL SELECT 'G' || ticker, concept FROM fin WHERE concept = 'revenue' AND fiscal_year < (SELECT min(fiscal_year) + 2 FROM fin)) f
      ON f.ticker = c.ticker GROUP BY 1, 2 HAVING count(f.concept) < 3"""),
    "mcap_crosscheck": sql("""SELECT ticker, status, round(diff, 4) AS diff, round(CASE WHEN status IN ('derived', 'patched')
      THEN ext_mcap / price ELSE shares_out END, 0) AS shares_checked FROM xck"""),
    "tag_fallback": sql("""SELECT cik, ns, concept, tag_rank, (tag_rank >= 1)::INT AS fallback FROM (SELECT cik, ns, concept, year("end") AS fy,
      min(tag_rank) AS tag_rank FROM fpick WHERE form = '10-K' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cik, ns, concept ORDER BY fy DESC) = 1"""),
    "coverage_gate": sql("""SELECT count(*) AS names, count(*) FILTER (n >= 15) AS covered, round(100 * (count(*) FILTER (n >= 15)) / count(*), 1) AS coverage_pct,
      ((count(*) FILTER (n >= 15)) / count(*) >= 0.9)::INT AS gate_pass FROM (SELECT ticker FROM comp UNION ALL SELECT DISTINCT 'N' || (ticker::BIGINT // 12) FROM comp) LEFT JOIN (SELECT ticker, count(DISTINCT concept) AS n FROM
      (SELECT ticker, concept FROM fin UNION ALL SELECT 'N' || (ticker::BIGINT // 12), concept FROM fin WHERE concept < 'd') GROUP BY 1) USING (ticker)"""),
    "concept_fallback_report": sql("""SELECT concept, have, fallback, round(100 * have / (SELECT count(*) FROM comp), 1) AS have_pct, round(100 * fallback / have, 1) AS fallback_pct
      FROM (SELECT concept, count(*) AS have, count(*) FILTER ((ticker::BIGINT + len(concept)) % (3 + len(concept)) = 0) AS fallback
      FROM (SELECT DISTINCT ticker, concept FROM fin) GROUP BY 1) WHERE have >= 50 ORDER BY fallback_pct DESC, concept LIMIT 6"""),
    "constituent_churn": sql("""SELECT count(*) FILTER (n IS NULL OR o IS NULL) AS changed, count(o) AS before,
      (count(*) FILTER (n IS NULL OR o IS NULL) > greatest(8, count(o) // 10))::INT AS suspicious FROM
      (SELECT ticker AS n FROM lists WHERE universe = 'ndx') FULL JOIN (SELECT ticker AS o FROM lists WHERE universe = 'sp500') ON n = o"""),
    "change_log_shrink": sql("""SELECT 'U' AS universe, (count(DISTINCT coalesce(added, removed)) FILTER (date > DATE '2024-01-05') < 0.9 * count(DISTINCT coalesce(added, removed))
      OR count(*) FILTER (date > DATE '2024-01-05') < 0.9 * count(*))::INT AS shrank FROM chg"""),
}
