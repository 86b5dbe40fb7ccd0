"""Queries over companies, names, universes and data quality."""
from pyspark.sql import functions as F

from . import bindings as b
from .queries_fundamentals import picked
from .registry import query, tidy
from ..assumptions import assumption_tables
from ..operators import entities as en, settings as st, quality as q
from ..sources import facts as src


def filers(spark, d):
    raw = b.filers(spark, d).select(
        "cik", "name", "sic", F.lit("").alias("sicDescription"), "tickers", "exchanges",
        F.expr("transform(former_names, n -> named_struct('name', n))").alias("formerNames"))
    return src.shape_filers(raw)


def member_lists(spark, d):
    """Every company on three lists, with the name and sector each list gives it."""
    return b.companies(spark, d).select("ticker", "name", "sector", F.explode(F.expr(
        "filter(array(if(cast(ticker AS bigint) % 3 = 0, 'ndx', NULL), if(cast(ticker AS bigint) % 4 = 0, 'sp500', NULL), "
        "if(cast(ticker AS bigint) % 5 <> 0, 'nyse', NULL)), x -> x IS NOT NULL)")).alias("universe")).select(
        "universe", "ticker", F.expr("if(universe = 'ndx', upper(name), name)").alias("name"),
        F.expr("if(universe = 'sp500', sector, concat('ICB ', sector))").alias("sector"))


@query
def filer_headers(spark, d):
    return filers(spark, d).select(
        "cik", "name", "sic", F.array_join("tickers", ",").alias("tickers"),
        F.array_join("exchanges", ",").alias("exchanges"), F.array_join("norm_names", " | ").alias("norm_names"))


@query
def name_normalization(spark, d):
    both = b.table(spark, d, "supplier").select(F.col("s_name").alias("n"), F.col("s_suppkey").alias("k")).unionByName(
        b.table(spark, d, "customer").select(F.col("c_name").alias("n"), F.col("c_custkey").alias("k")))
    names = both.select(F.expr(
        "CASE k % 7 WHEN 0 THEN concat('The ', n, ' Group, Inc.') WHEN 1 THEN concat(n, ' Corp /DE/') "
        "WHEN 2 THEN concat(n, ' (Old) Holdings Class A') WHEN 3 THEN concat(n, ' Co. CL B') "
        "WHEN 4 THEN concat('O''', n, '-West & Co') WHEN 5 THEN concat(n, ' /MD/ New A') ELSE n END").alias("name"))
    return en.with_norm_name(names)


@query
def delisted_name_resolve(spark, d):
    names = b.table(spark, d, "customer").select(
        F.concat(F.lit("D"), F.col("c_custkey").cast("string")).alias("ticker"), F.expr(
            "CASE c_custkey % 10 WHEN 3 THEN concat(c_name, ', Corporation') WHEN 4 THEN substr(c_name, 10) "
            "WHEN 5 THEN substr(c_name, 1, 16) WHEN 7 THEN concat('The Old ', c_name) "
            "WHEN 8 THEN substr(c_name, 15) ELSE c_name END").alias("name"))
    return en.resolve_names(names, filers(spark, d))


@query
def namesake_guard(spark, d):
    pairs = b.table(spark, d, "customer").select(
        F.lpad(F.expr("cast(if(c_custkey % 4 = 0, c_custkey + 1, c_custkey) AS string)"), 10, "0").alias("cik"),
        F.expr("if(c_custkey % 3 = 0, concat(substr(c_name, 1, 8), ' ', substr(c_name, 9)), c_name)").alias("name"))
    out = en.name_consistent(pairs, filers(spark, d))
    return out.withColumn("matches", F.col("matches").cast("int"))


@query
def ticker_to_cik(spark, d):
    reg = b.table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(
        F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("ticker"),
        F.lpad((F.col("s_suppkey") + 900000).cast("string"), 10, "0").alias("cik"))
    pins = b.table(spark, d, "nation").where("n_nationkey % 5 = 0").select(
        F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("ticker"),
        F.lpad((F.col("n_nationkey") + 5000000).cast("string"), 10, "0").alias("cik"))
    return en.ticker_cik(filers(spark, d), reg, pins)


@query
def share_class_dedupe(spark, d):
    rows = b.table(spark, d, "customer").select(
        F.lpad((F.floor(F.col("c_custkey") / 3)).cast("string"), 10, "0").alias("cik"),
        F.col("c_custkey").cast("string").alias("ticker"), F.col("c_name").alias("name"))
    return en.dedupe_share_class(rows)


@query
def resume_ingest(spark, d):
    """Each company has a newcomer beside it of which only four concepts are known."""
    fin = b.financials(spark, d)
    comp = b.companies(spark, d, fin).select("ticker", "name")
    new = F.concat(F.lit("N"), "ticker")
    begun = fin.where("concept IN ('revenue', 'ebit', 'cash', 'equity')").withColumn("ticker", new)
    return en.to_ingest(comp.unionByName(comp.withColumn("ticker", new)), fin.unionByName(begun))


@query
def constituent_lists(spark, d):
    ranked = member_lists(spark, d).withColumn("list_rank", F.expr("array_position(array('sp500', 'ndx', 'nyse'), universe)"))
    return en.constituents(ranked)


@query
def universe_union(spark, d):
    out = en.union_universe(member_lists(spark, d), assumption_tables(spark)["universes"])
    return out.select("ticker", "name", "sector", F.array_join("universes", ",").alias("universes"))


@query
def resolved_assumptions(spark, d):
    """The first companies bear the tickers that the configuration names; every third lacks a sector."""
    tables = assumption_tables(spark)
    named = sorted({r.ticker for t in ("archetype_overrides", "cik_pins", "subsector_overrides") for r in tables[t].select("ticker").collect()})
    names = ", ".join(f"'{t}'" for t in named)
    comp = b.companies(spark, d).selectExpr(
        f"coalesce(get(array({names}), cast(ticker AS int) - 1), ticker) AS ticker", "cik", "if(cast(ticker AS bigint) % 2 = 0, sic, lpad(cast(3570 + cast(ticker AS bigint) % 110 AS string), 4, '0')) AS sic",
        "if(cast(ticker AS bigint) % 3 = 0, NULL, sector) AS sector", "price * shares_out AS mcap")
    return tidy(st.resolve_assumptions(comp, tables), ["ticker", "cik", "archetype_pin", "bucket", "sector", "sic_sector", "n_universes"], size_premium=4)


@query
def sic_sector(spark, d):
    rows = b.table(spark, d, "part").select("p_partkey", F.lpad(((F.col("p_partkey") * 7) % 9000 + 100).cast("string"), 4, "0").alias("sic"))
    return en.with_sector_by_sic(rows, assumption_tables(spark)["sector_by_sic"])


@query
def listed_census(spark, d):
    from ..operators.fundamentals import filer_form
    forms = filer_form(b.share_facts(spark, d))
    rows = filers(spark, d).withColumn("name", F.expr("if(sic LIKE '%9', concat(name, ' Bond Fund'), name)"))
    return en.listed_census(rows, forms, assumption_tables(spark)["sector_by_sic"])


@query
def hygiene_reason(spark, d):
    rows = b.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("ticker"),
        F.expr("CASE WHEN c_custkey % 17 = 0 THEN concat(c_name, ' Preferred') WHEN c_custkey % 19 = 0 "
               "THEN concat(c_name, ' warrants') WHEN c_custkey % 13 = 0 THEN concat(c_name, ' Rightsize') ELSE c_name END").alias("name"),
        F.expr("(c_custkey % 30) / 10D").alias("price"),
        F.expr("if(c_custkey % 23 = 0, '6770', '7372')").alias("sic"))
    return en.with_hygiene_reason(rows).select("ticker", "hygiene")


@query
def universe_floor(spark, d):
    uni = assumption_tables(spark)["universes"].select(
        F.expr("if(universe = 'nyse', 'sp500', 'sp1500')").alias("universe"), F.expr("mcap_floor * 5").alias("mcap_floor")) \
        .where("universe = 'sp500'")
    return en.apply_floor(b.universe_members(spark, d), b.companies(spark, d), uni)


@query
def coverage_regression(spark, d):
    """Last run's counts: a tenth more for the money concepts that start with a, c or s."""
    fin = b.financials(spark, d)
    cov = q.concept_coverage(fin)
    history = cov.select("concept", F.expr("if(substr(concept, 1, 1) IN ('a', 'c', 's'), tickers * 11 DIV 10, tickers)").alias("tickers"),
                         F.explode(F.array(F.lit("2026-01-02"), F.lit("2025-12-01"))).alias("run_date"))
    return q.coverage_regression(fin, history.withColumn("tickers", F.expr("if(run_date < '2026', tickers * 3, tickers)")))


@query
def ghost_tripwire(spark, d):
    """Each company has a ghost beside it that only has the revenue of the table's first two years."""
    fin = b.financials(spark, d)
    comp = b.companies(spark, d, fin).select("ticker", "cik")
    ghost = F.concat(F.lit("G"), "ticker")
    first = fin.agg((F.min("fiscal_year") + 2).alias("_until"))
    few = fin.where("concept = 'revenue'").join(F.broadcast(first), F.col("fiscal_year") < F.col("_until")).drop("_until")
    return q.ghosts(comp.unionByName(comp.withColumn("ticker", ghost)), fin.unionByName(few.withColumn("ticker", ghost)))


@query
def mcap_crosscheck(spark, d):
    comp = b.companies(spark, d)
    return tidy(q.mcap_xcheck(comp, b.external_mcap(spark, d, comp)), ["ticker", "status"], diff=4, shares_checked=0)


@query
def tag_fallback(spark, d):
    return q.tag_rank(picked(spark, d)).select("cik", "ns", "concept", "tag_rank", F.col("fallback").cast("int").alias("fallback"))


@query
def coverage_gate(spark, d):
    """One newcomer for each twelve companies, with the concepts of theirs that come first in the alphabet."""
    fin = b.financials(spark, d)
    new = F.expr("concat('N', cast(ticker AS bigint) DIV 12)")
    names = b.companies(spark, d, fin).select("ticker")
    names = names.unionByName(names.select(new.alias("ticker")).distinct())
    out = q.coverage_gate(names, fin.unionByName(fin.where("concept < 'd'").withColumn("ticker", new)))
    return out.withColumn("gate_pass", F.col("gate_pass").cast("int"))


@query
def concept_fallback_report(spark, d):
    fin = b.financials(spark, d)
    ranks = fin.select("ticker", "concept").distinct().withColumn(
        "fallback", F.expr("(cast(ticker AS bigint) + length(concept)) % (3 + length(concept)) = 0"))
    return q.concept_gate(b.companies(spark, d), fin, ranks, min_have=50, top=6)


@query
def constituent_churn(spark, d):
    m = member_lists(spark, d)
    out = q.churn(m.where("universe = 'ndx'"), m.where("universe = 'sp500'"))
    return out.withColumn("suspicious", F.col("suspicious").cast("int"))


@query
def change_log_shrink(spark, d):
    ch = b.index_changes(spark, d)
    cur = ch.where("date > DATE'2024-01-05'").agg(F.countDistinct(F.coalesce("added", "removed")).alias("members"), F.count(F.lit(1)).alias("changes"))
    prev = ch.agg(F.countDistinct(F.coalesce("added", "removed")).alias("members"), F.count(F.lit(1)).alias("changes"))
    out = q.shrink_guard(cur.withColumn("universe", F.lit("U")), prev.withColumn("universe", F.lit("U")))
    return out.withColumn("shrank", F.col("shrank").cast("int"))
