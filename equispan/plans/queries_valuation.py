"""Queries over the valued universe."""
from pyspark.sql import functions as F

from . import bindings as b, pipeline
from .queries_metrics import RF, TODAY, fresh_inputs, series
from .registry import query, tidy
from ..assumptions import assumption_tables
from ..functions import engines as en
from ..functions.exprs import with_exprs
from ..functions.staging import keep, stage
from ..operators import crosssection as x, metrics as m, prices as px, screen as sc, valuation as v
from ..sources import sinks

U = ["universe", "ticker"]


def companies(spark, d):
    """Inputs and engines in one pass over the companies."""
    return keep(spark, d, "engines", lambda: pipeline.company_stage(fresh_inputs(spark, d), RF, TODAY))


def engines(spark, d):
    return companies(spark, d).where("why IS NULL")


def momentum(spark, d):
    """T5 of every company in its universes."""
    prices = b.company_prices(spark, d, keep(spark, d, "monthly_prices", lambda: b.monthly_prices(spark, d)))
    return px.live_momentum(prices, b.universe_members(spark, d))


def valued(spark, d):
    return keep(spark, d, "valued", lambda: pipeline.value_universes(
        companies(spark, d), b.universe_members(spark, d), assumption_tables(spark), momentum(spark, d)))


def board(spark, d):
    return valued(spark, d).where("why IS NULL")


@query
def present_value_fcf(spark, d):
    """V1 on the trailing cash flow, in millions."""
    df = engines(spark, d).where("base_fcf > 0 AND wacc - term_g >= 0.015")
    return tidy(with_exprs(df, pv=f"{en.pv_fcf_sql('base_fcf', 'wacc', 'term_g', 'g1')} / 1e6"), ["ticker"], pv=3)


@query
def present_value_nopat(spark, d):
    """V2 on normalized operating profit, in millions."""
    df = engines(spark, d).where("nopat_norm > 0 AND roic_dcf > 0 AND wacc - term_g >= 0.015")
    return tidy(with_exprs(df, pv=f"{en.pv_nopat_sql('nopat_norm', 'roic_dcf', 'wacc', 'term_g', 'g1')} / 1e6"), ["ticker"], pv=3)


@query
def dcf_value(spark, d):
    return tidy(engines(spark, d), ["ticker"], dcf_ps=5)


@query
def market_implied_growth(spark, d):
    return tidy(engines(spark, d), ["ticker", "implied_op"], implied_g=5)


@query
def epv_value(spark, d):
    return tidy(engines(spark, d), ["ticker"], epv_ps=5)


@query
def rim_value(spark, d):
    return tidy(engines(spark, d), ["ticker"], rim_ps=5)


@query
def ddm_value(spark, d):
    return tidy(engines(spark, d), ["ticker"], ddm_ps=5)


@query
def archetype_router(spark, d):
    return engines(spark, d).select("ticker", "arch", "eff_arch", F.col("rim_ok").cast("int").alias("rim_ok"))


def live(spark, d):
    """The cross-section before any value is blended."""
    return keep(spark, d, "live", lambda: pipeline.cross_section(
        stage(engines(spark, d).join(b.universe_members(spark, d), "ticker")), assumption_tables(spark)))


@query
def quality_score(spark, d):
    return tidy(live(spark, d), U, quality=0)


@query
def bucket_assign(spark, d):
    return live(spark, d).select(*U, "wbucket")


@query
def warranted_anchors(spark, d):
    anchors, _ = v.warranted_fit(live(spark, d).where(v.FIT_OK), ["universe"])
    return tidy(anchors, ["universe", "scope"], a_y=5, a_g=6, a_m=6, a_r=6)


@query
def warranted_coefs(spark, d):
    _, coefs = v.warranted_fit(live(spark, d).where(v.FIT_OK), ["universe"])
    return tidy(coefs, ["universe", "n"], c_g=4, c_m=4, c_r=4)


@query
def warranted_value(spark, d):
    df = live(spark, d)
    anchors, coefs = v.warranted_fit(df.where(v.FIT_OK), ["universe"])
    return tidy(v.with_warranted(df, anchors, coefs, ["universe"]), U, warr_ps=4)


@query
def reit_anchor(spark, d):
    return tidy(v.with_pffo(live(spark, d)).where("eff_arch = 'reit'"), U, ffo=4)


@query
def engine_gates(spark, d):
    return tidy(board(spark, d), [*U, "implied_op"], dcf_ps=4, epv_ps=4, rim_ps=4, warr_ps=4, ffo=4)


@query
def triangulation(spark, d):
    return tidy(board(spark, d), [*U, "n_methods", "within", "conf"], low=4, mid=4, high=4, upside=4)


@query
def predictability_band(spark, d):
    return tidy(board(spark, d), U, band=4)


@query
def scenario_cone(spark, d):
    return tidy(board(spark, d), U, bear=4, base=4, bull=4, pw=4, exp_base=4, exp_pw=4, ann_pw=4)


@query
def sensitivity_grid(spark, d):
    df = engines(spark, d).where("eff_arch = 'standard'")
    return tidy(v.sensitivity_grid(df, [-0.02, 0.0, 0.02], [-0.01, 0.0, 0.01]), ["ticker", "dg", "dw"], grid_ps=4)


@query
def adr_sanity(spark, d):
    return board(spark, d).unionByName(valued(spark, d).where("why LIKE 'ADR: per-share%'")).where("form = '20-F'").select(
        *U, F.col("adr_bad").cast("int").alias("adr_bad"))


@query
def composite_score(spark, d):
    return tidy(board(spark, d), [*U, "quality"], score=6)


@query
def method_weights(spark, d):
    return tidy(v.method_weights(board(spark, d)), [*U, "method"], value=4, share=6)


@query
def verdicts(spark, d):
    return v.with_verdict(board(spark, d)).select(*U, "verdict", "growth_view", "agreement")


@query
def counter_case(spark, d):
    return v.with_counter_case(board(spark, d)).select(*U, F.array_join("counter_case", "; ").alias("counter_case"))


@query
def excluded_report(spark, d):
    return v.excluded(valued(spark, d))


@query
def multiples(spark, d):
    return tidy(board(spark, d), U, pe=4, evebitda=4, fcfy=5, div_yield=5, nde=4)


@query
def trap_flags(spark, d):
    return board(spark, d).select(*U, F.array_join("flags", "|").alias("flags"))


@query
def percentile_rank(spark, d):
    return tidy(x.with_pct_rank(board(spark, d), "roic", ["universe"], "pr"), U, pr=6)


@query
def winsorize(spark, d):
    return tidy(x.winsorize(board(spark, d), "upside", ["universe"], out="w"), U, w=5)


@query
def sector_zscore(spark, d):
    return tidy(x.sector_z(board(spark, d), "upside", ["universe"], "z"), U, z=5)


@query
def factor_blend(spark, d):
    df = with_exprs(board(spark, d), gap="if(implied_op IS NULL, NULL, g_trail - implied_g)")
    df = x.sector_z_many(df, ["upside", "gap", "roic", "mom"], ["universe"])
    out = x.factor_blend(df, {"V": ["z_upside", "z_gap"], "Q": ["z_roic"], "M": ["z_mom"]}, {"V": 0.25, "Q": 0.25, "M": 0.5}, "blend")
    return tidy(out, U, blend=5)


@query
def rank_blend(spark, d):
    df = with_exprs(board(spark, d), gap="g_trail - implied_g")
    return tidy(x.rank_blend(df, "score", "gap", ["universe"], 0.4, "blend"), U, blend=6)


@query
def sector_medians(spark, d):
    return tidy(x.median_by(board(spark, d), "upside", ["universe", "sector"]), ["universe", "sector", "n_all"], median=5)


@query
def peer_percentile(spark, d):
    cols = ["g_trail", "roic", "om", "nde", "roe_avg", "roe_std", "eq_assets"]
    out = x.peer_percentile(board(spark, d), cols, lower_better=("nde", "roe_std"))
    return tidy(out, U, **{f"{c}_pct": 6 for c in cols})


@query
def peer_strip(spark, d):
    return x.peers(board(spark, d)).select(*U, "peer", "rank")


@query
def axis_bounds(spark, d):
    return tidy(x.axis_bounds(board(spark, d)), ["universe", "off_chart"], x_min=4, x_max=4)


@query
def kpi_strip(spark, d):
    return tidy(x.kpis(board(spark, d)), ["universe", "covered", "undervalued", "pass_quality", "flagged"], median_upside=5)


@query
def screen_filter(spark, d):
    out = sc.screen(board(spark, d), sectors=["Industrials", "Energy", "Financials"], cap="large", min_quality=30, min_conf=2,
                    min_upside=-40, min_momentum=10)
    return out.select(*U)


@query
def screen_presets(spark, d):
    df = board(spark, d)
    parts = [sc.preset(df, name).select(F.lit(name).alias("preset"), *U) for name in sc.PRESETS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def sorted_screen(spark, d):
    """By P/E upwards, where a missing P/E sorts first."""
    return sc.place_screen(board(spark, d), "pe", desc=False).select(*U, "place")


@query
def name_search(spark, d):
    """The first seven hits of each universe."""
    found = [sc.search(board(spark, d).where(F.col("universe") == u), "000012") for u in ("sp1500", "sp500")]
    return found[0].unionByName(found[1]).select(*U, "name")


@query
def ranked_board(spark, d):
    return tidy(sc.ranked_board(board(spark, d)), ["universe", "ticker", "sector", "eff_arch", "conf", "quality"], price=4, mid=4, upside=4, score=6)


@query
def watchlist(spark, d):
    return sc.watchlist(board(spark, d), spark.sql("SELECT explode(array('7', '12', '99', '101')) AS ticker")).select(*U)


@query
def distinct_sectors(spark, d):
    return sc.sectors(board(spark, d))


@query
def archetype_tally(spark, d):
    return sc.archetype_tally(valued(spark, d))


@query
def company_records(spark, d):
    """K1: the nested record per company, flattened again to check its parts."""
    rec = sinks.company_records(board(spark, d))
    return tidy(rec.select("universe", "ticker", F.expr("size(methods)").alias("n_listed"),
                           F.expr("size(filter(methods, m -> m.applicable))").alias("n_applicable"),
                           F.expr("round(scenario.pw, 2)").alias("pw"), F.expr("scenario.expBase").alias("exp_base"), F.expr("capital.roic").alias("roic"),
                           F.expr("capital.reinvest").alias("reinvest"), F.expr("capital.incRoic").alias("inc_roic"),
                           F.expr("array_join(transform(methods, m -> m.note), '|')").alias("notes"), F.expr("array_join(trends.years, ',')").alias("years"),
                           F.expr("get(trends.revenueB, size(trends.revenueB) - 1)").alias("last_rev"),
                           F.array_join("flags", "|").alias("flags"), F.col("roic").alias("roic_now"), "om", "roe", "roe_std", "eq_assets", "fin_currency"),
                ["universe", "ticker", "n_listed", "n_applicable", "flags", "fin_currency", "notes", "years"], pw=2, exp_base=4, roic=4, reinvest=4, inc_roic=4, last_rev=3, roic_now=6, om=6, roe=6, roe_std=6, eq_assets=6)


@query
def run_records(spark, d):
    """K1, meta part: the run's record of each universe, its lists joined as text."""
    out = sinks.run_records(valued(spark, d), assumption_tables(spark)["universes"], RF, TODAY)
    return tidy(with_exprs(out, excluded="array_join(transform(excluded, x -> concat(x.why, '=', x.n)), '; ')",
                           weights="array_join(transform(map_entries(weights), w -> concat(w.key, '=', w.value)), '; ')"),
                ["universe", "name", "as_of", "covered", "n_excluded", "excluded", "weights"], risk_free=4, erp=4, terminal_g=4)


@query
def screen_csv(spark, d):
    return sinks.screen_csv_rows(board(spark, d), "universe")


@query
def coverage_manifest(spark, d):
    return sinks.coverage_manifest(board(spark, d), assumption_tables(spark)["universes"])
