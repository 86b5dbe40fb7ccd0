"""Rank every universe in one job: inputs -> engines -> cross-section -> blend -> score."""
from pyspark.sql import DataFrame, functions as F

from ..assumptions import CFG
from ..functions.exprs import with_exprs
from ..functions.staging import stage
from ..operators import crosssection as x, metrics as m, valuation as v


def company_stage(inputs: DataFrame, rf: float, today: str) -> DataFrame:
    """Everything that depends on one company only.  The history arrays stop here; of them the trend lines of eight years
    and the capital panel go on, a bounded handful of numbers."""
    df = with_exprs(inputs, term_g=f"least({CFG['terminal_growth']}D, {rf}D)")
    df = v.with_effective_archetype(df)
    for step in (v.with_dcf, v.with_implied_growth, v.with_epv, v.with_rim, v.with_ddm, m.with_altman_z, m.with_piotroski, m.trends, m.capital_panel):
        df = step(df)
    std = "if(eff_arch = 'standard', {}, NULL)"
    df = with_exprs(df, altman_z=std.format("altman_z"), piotroski=std.format("piotroski"))
    return v.with_fit_inputs(m.with_stale(df, today)).drop("series", "now")


def cross_section(live: DataFrame, tables: dict) -> DataFrame:
    """Quality scores and anchor buckets."""
    live = stage(x.with_quality(live))
    return stage(x.assign_buckets(live, tables["subsector_overrides"], tables["subsector_by_sic"], v.FIT_OK))


def universe_stage(companies: DataFrame, members: DataFrame, tables: dict) -> DataFrame:
    """Join the universes and add what needs the whole cross-section."""
    floors = F.broadcast(tables["universes"].select("universe", "min_mcap"))
    df = companies.join(members, "ticker").join(floors, "universe", "left")
    df = with_exprs(df, min_mcap="coalesce(min_mcap, 0D)")
    live = cross_section(df.where("why IS NULL"), tables)
    anchors, coefs = v.warranted_fit(live.where(v.FIT_OK), ["universe"])
    live = v.with_pffo(v.with_warranted(live, anchors, coefs, ["universe"]))
    gone = df.where("why IS NOT NULL")
    return live.unionByName(gone, allowMissingColumns=True)


def blend_stage(df: DataFrame, momentum: DataFrame | None = None) -> DataFrame:
    """Gates, band, blend, flags, reasons, score, scenarios and multiples, row by row."""
    if momentum is None:
        df = df.withColumns({"mom": F.lit(None).cast("double"), "mom_pct": F.lit(None).cast("int")})
    else:
        df = df.join(momentum.select("universe", "ticker", "mom", "mom_pct"), ["universe", "ticker"], "left")
    df = v.with_band(v.apply_gates(df))
    df = v.triangulate(df, band="band")
    for step in (m.with_trap_flags, v.adr_guard, v.with_second_exclusion, v.with_score, v.scenarios, m.with_multiples):
        df = step(df)
    return df


def value_universes(companies, members, tables, momentum=None) -> DataFrame:
    """All companies of all universes, valued; `why` holds the reason for those left out.  companies: a written company_stage,
    which several branches read."""
    return blend_stage(stage(universe_stage(companies, members, tables)), momentum)
