"""Queries over filing facts."""
from pyspark.sql import functions as F

from . import bindings as b
from .registry import query, tidy
from ..operators import fundamentals as f, backtest as bt


def mapped(spark, d):
    return f.map_tags(b.facts(spark, d), b.fact_tagmap(spark))


def picked(spark, d):
    m = mapped(spark, d)
    return f.select_unit(m, f.reporting_currency(m))


@query
def tag_mapping(spark, d):
    return mapped(spark, d).groupBy("ns", "concept", "tag_rank").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cik").alias("filers"))


@query
def annual_pick(spark, d):
    return tidy(f.annual_series(picked(spark, d)), ["cik", "ns", "concept", "fiscal_year"], value=2)


@query
def unit_selection(spark, d):
    return picked(spark, d).groupBy("cik", "ns", "tag", "unit").agg(F.count(F.lit(1)).alias("n"))


@query
def reporting_currency(spark, d):
    return f.reporting_currency(mapped(spark, d)).select("cik", "ns", "ccy")


@query
def namespace_fallback(spark, d):
    return tidy(f.pick_namespace(f.annual_series(picked(spark, d))), ["cik", "ns", "concept", "fiscal_year"], value=2)


@query
def namespace_revenue_only(spark, d):
    series = f.pick_namespace(f.annual_series(picked(spark, d)), require=("revenue",))
    return series.groupBy("cik", "ns").agg(F.count(F.lit(1)).alias("n"))


@query
def duration_points(spark, d):
    return tidy(f.duration_points(picked(spark, d)), ["cik", "ns", "concept", "start", "end"], value=2)


@query
def ttm_stitch(spark, d):
    return tidy(f.ttm(f.duration_points(picked(spark, d))), ["cik", "ns", "concept", "thru", "basis"], value=2)


@query
def freshest_instant(spark, d):
    return tidy(f.freshest_instant(picked(spark, d)), ["cik", "ns", "concept", "thru"], value=2)


@query
def financials_now(spark, d):
    return tidy(f.financials_now(picked(spark, d)), ["cik", "ns", "concept", "thru", "basis"], value=2)


@query
def fx_to_usd(spark, d):
    """Filers report in the currency of their nation; one nation in seven has no rate."""
    fin = b.financials(spark, d)
    ccy = b.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("ticker"),
        F.expr("if(c_nationkey = 0, 'USD', concat('C', c_nationkey))").alias("ccy"))
    fx = b.fx_rates(spark, d).where("cast(substr(ccy, 2) AS int) % 7 <> 3")
    out = f.to_usd(fin, ccy, fx, keys=("ticker",))
    return tidy(out.withColumn("value_m", F.col("value") / 999983.0), ["ticker", "concept", "fiscal_year"], value_m=6)


@query
def current_shares(spark, d):
    return tidy(f.current_shares(b.share_facts(spark, d)), ["cik"], shares_out=2)


@query
def filer_form(spark, d):
    return f.filer_form(b.share_facts(spark, d)).select("cik", "form")


@query
def pit_vintages(spark, d):
    return tidy(f.pit_vintages(picked(spark, d)), ["cik", "ns", "concept", "fy", "filed", "end_date"], value=2)


def quarters(spark, d):
    return bt.quarter_ends(spark, *b.date_span(spark, d))


@query
def series_asof(spark, d):
    out = f.series_asof(b.pit_vintages(spark, d), quarters(spark, d)).withColumn("value_m", F.col("value") / 999983.0)
    return tidy(out, ["qdate", "ticker", "concept", "fy"], value_m=6)


@query
def shares_asof(spark, d):
    out = f.shares_asof(b.pit_vintages(spark, d), b.splits(spark, d), quarters(spark, d))
    return tidy(out, ["qdate", "ticker", "end_date"], shares=1)


@query
def facts_json_corpus(spark, d):
    """Each filer's whole history as a nested JSON document beside a torn copy of it, read back to long facts; the
    unreadable documents are counted in rows of their own."""
    from ..sources import facts as src
    docs = src.pack_facts(b.facts(spark, d))
    docs = docs.unionByName(docs.withColumn("doc", F.expr("left(doc, length(doc) DIV 2)")))
    rows = src.parse_facts(docs)
    torn = src.unreadable(docs).groupBy(F.col("reason").alias("ns")).agg(F.count(F.lit(1)).cast("double").alias("val"))
    return tidy(rows.unionByName(torn, allowMissingColumns=True),
                ["cik", "ns", "tag", "unit", "start", "end", "filed", "form", "fp", "tag_ord", "pos"], val=2)
