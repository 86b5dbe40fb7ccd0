"""Outputs: company records, screen export, upserts, price matrix, manifest (K1, K2, K4, K5, K7)."""
from pyspark.sql import DataFrame, functions as F

from ..assumptions import CFG, WEIGHTS
from ..functions.staging import stage
from ..functions.exprs import with_exprs

# fixed values: the methods as they are listed
METHOD_LIST = [("dcf", "DCF", "dcf_ps"), ("rim", "RIM", "rim_ps"), ("ffo", "P/FFO", "ffo"), ("epv", "EPV (floor)", "epv_ps"),
               ("warranted", "Warranted mult.", "warr_ps"), ("ddm", "DDM", "ddm_ps")]
_NOT_USED = "'not used for this archetype'"
#: What each method's value rests on, or why there is none.
NOTES = {
    "dcf": f"""if(eff_arch <> 'standard', {_NOT_USED}, concat(if(nopat_norm > 0 AND roic_dcf > 0, 'normalized NOPAT less reinvestment of g/ROIC', 'normalized FCF'),
      if(cyclical, ' over 10 years', ''), format_string(', growth %.0f%%, WACC %.1f%%', g1 * 100, wacc * 100)))""",
    "rim": """CASE WHEN rim_ps IS NOT NULL THEN concat('book value and discounted excess ROE', if(arch <> 'standard', ', the anchor here', ''))
      WHEN ffo IS NOT NULL THEN 'replaced by P/FFO' WHEN eff_arch = 'standard' THEN 'for financials and REITs only' ELSE 'book value or ROE not usable' END""",
    "ffo": "if(ffo IS NOT NULL, 'FFO at the median multiple of the covered REITs', 'no positive FFO')",
    "epv": f"CASE WHEN eff_arch <> 'standard' THEN {_NOT_USED} WHEN epv_ps > mid THEN 'no-growth value, above the growth cases' ELSE 'no-growth value, sets the low end only' END",
    "warranted": f"if(eff_arch <> 'standard', {_NOT_USED}, concat('median EV/EBIT of ', wbucket, ', adjusted for growth, margin and ROIC'))",
    "ddm": """CASE WHEN ddm_ps IS NOT NULL THEN format_string('dividend of %.2f a share, discounted at %.1f%%', div / shares, re * 100)
      WHEN coalesce(div, 0D) = 0 THEN 'no dividend' ELSE 'dividend not covered by earnings, or too small' END""",
}


def company_records(board: DataFrame) -> DataFrame:
    """K1: one nested record per ranked company.  P/FFO is listed for REITs only."""
    items = ", ".join(f"named_struct('key', '{k}', 'name', '{n}', 'value', round({c}, 2), 'applicable', {c} IS NOT NULL, 'note', {NOTES[k]})"
                      for k, n, c in METHOD_LIST)
    scen = ("if(pw IS NULL, NULL, named_struct('bear', bear, 'base', base, 'bull', bull, 'pw', pw, 'expBase', exp_base, "
            "'expPW', exp_pw, 'annPW', ann_pw))")
    cap = ("if(eff_arch = 'standard' AND roic_dcf > 0, named_struct('roic', round(cap_roic, 4), 'spread', round(cap_spread, 4), "
           "'reinvest', round(cap_reinvest, 4), 'incRoic', round(cap_inc_roic, 4)), NULL)")
    return with_exprs(
        board, methods=f"filter(array({items}), m -> m.key <> 'ffo' OR eff_arch = 'reit')", scenario=scen, capital=cap,
        archetype="eff_arch", mcapB="round(mcap / 1e9, 1)", negBook="coalesce(equity_now < 0, false)").select(
        "universe", "ticker", "name", "cik", "sector", "archetype", "price", "mcapB", "quality", "low", "mid", "high", "upside",
        "conf", "within", "n_methods", "implied_g", "implied_op", "g_trail", "mom", "mom_pct", "pe", "evebitda", "fcfy", "div_yield",
        "altman_z", "piotroski", "piotroski_n", "nde", "om", "roic", F.col("roe_avg").alias("roe"), "roe_std",
        "eq_assets", "fin_currency", F.col("fin_thru").alias("finThru"), "negBook", "flags", "score", "scenario", "capital", "methods", "trends")


def run_records(valued: DataFrame, universes: DataFrame, rf: float, as_of: str, changes: DataFrame | None = None) -> DataFrame:
    """K1: one record per universe of what the run assumed, covered and left out.

    Exclusions are counted by reason, a list no longer than the reasons; the names stand in valuation.excluded().  changes:
    the digest of snapshots.change_digest with its universe, a few entries of each kind."""
    why = F.regexp_replace("why", r"^(\w+):.*$", "$1")
    counts = valued.groupBy("universe", F.col("why").isNull().alias("ok"), why.alias("why")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("universe").agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("covered"),
        F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("n_excluded"),
        F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("why", "n")))).alias("excluded"))
    weights = F.create_map(*[F.lit(x) for k, v in WEIGHTS.items() for x in (k.lower(), float(v))])
    out = out.join(F.broadcast(universes.select("universe", "name")), "universe", "left").select(
        "universe", "name", F.lit(as_of).alias("as_of"), F.lit(rf).alias("risk_free"), F.lit(CFG["equity_risk_premium"]).alias("erp"),
        F.least(F.lit(CFG["terminal_growth"]), F.lit(rf)).alias("terminal_g"), "covered", "n_excluded", "excluded", weights.alias("weights"))
    if changes is None:
        return out
    lists = changes.groupBy("universe").agg(F.array_sort(F.collect_list(F.struct("kind", "place", "ticker", "detail"))).alias("changes"))
    return out.join(lists, "universe", "left")


def write_records(ranked: DataFrame, path: str) -> None:
    """K1: JSON records, a folder per universe."""
    company_records(ranked).write.mode("overwrite").partitionBy("universe").json(path)


def upsert(old: DataFrame, new: DataFrame, keys, order=None) -> DataFrame:
    """K2: insert or replace by key; the new row wins whole.  Of several new rows for a key the one with the greatest
    `order` column wins, and of equal ones the greatest in all columns."""
    rest = [F.col(c) for c in ([order] if order else []) + [c for c in new.columns if c not in keys]]
    new = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), F.struct(*rest)).alias("r")).select("r.*")
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def write_upsert(path: str, new: DataFrame, keys, partition: str, order=None) -> None:
    """K2 into a table partitioned by one of the keys: only partitions that the new rows touch are read and written."""
    old = new.sparkSession.read.parquet(path)
    touched = old.join(new.select(partition).distinct(), partition, "left_semi")
    # The merged rows are kept elsewhere first, as they replace what they are read from.
    merged = stage(upsert(touched.select(*new.columns), new, keys, order))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


_PCT = "if({0} IS NULL, '', format_string('%.1f%%', {0} * 100))"
_TXT = "coalesce(cast({0} AS string), '')"


def _num(x, places):
    """Shortest plain decimal text, never an exponent."""
    return f"coalesce(regexp_replace(cast(cast(round({x}, {places}) AS decimal(28, {places})) AS string), r'\\.?0+$', ''), '')"


SCREEN_COLUMNS = [  # fixed values: export header and how each column is written
    ("ticker", "ticker"), ("name", "name"), ("sector", "sector"), ("price", _num("price", 2)),
    ("low", _num("low", 2)), ("mid", _num("mid", 2)), ("high", _num("high", 2)),
    ("upside", _PCT.format("upside")), ("confidence", "cast(conf AS string)"), ("quality", "cast(quality AS string)"),
    ("momentumPct", _TXT.format("mom_pct")), ("momentum12_1", _PCT.format("mom")), ("impliedGrowth", _PCT.format("implied_g")),
    ("trailingGrowth", _PCT.format("g_trail")), ("pe", _num("pe", 1)), ("evEbitda", _num("evebitda", 1)),
    ("fcfYield", _PCT.format("fcfy")), ("mcapB", _num("mcap / 1e9", 1)), ("flags", "array_join(flags, '; ')"),
    ("score", _num("score", 4))]


def screen_csv_rows(df: DataFrame, *keep) -> DataFrame:
    """K4: the export's 20 text columns, after the columns to keep as they are."""
    return df.select(*keep, *[F.expr(v).alias(k) for k, v in SCREEN_COLUMNS])


def write_screen_csv(df: DataFrame, path: str) -> None:
    screen_csv_rows(df).write.mode("overwrite").option("header", True).csv(path)


def coverage_manifest(ranked: DataFrame, universes: DataFrame, default="ndx") -> DataFrame:
    """K7: universes that have ranked names, in configured order."""
    n = ranked.groupBy("universe").agg(F.count(F.lit(1)).alias("covered"))
    return (n.join(F.broadcast(universes.select("universe", "name", "rank")), "universe").orderBy("rank")
            .select("universe", "name", "covered", (F.col("universe") == default).cast("int").alias("is_default")))


def align_last_month(daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """The month bar of a ticker's latest day becomes that day's close."""
    last = (daily.where("adjclose IS NOT NULL").groupBy("ticker").agg(F.max_by(F.struct("date", "adjclose"), "date").alias("p"))
            .select("ticker", F.trunc("p.date", "month").alias("month"), F.col("p.adjclose").alias("adjclose")))
    return upsert(monthly.select("ticker", "month", "adjclose"), last, ["ticker", "month"])


def _matrix(prices: DataFrame, members: DataFrame, axis: str) -> DataFrame:
    """One array per (universe, ticker) over the universe's shared axis; the axis is calendar-bounded,
    so each array is too, and no row is made for a gap."""
    rows = prices.where("adjclose IS NOT NULL").join(members, "ticker")
    days = (rows.select("universe", axis).distinct().groupBy("universe")
            .agg(F.array_sort(F.collect_list(axis)).alias("axis")))
    own = rows.groupBy("universe", "ticker").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col(axis), F.expr("if(adjclose >= 5, round(adjclose, 2), round(adjclose, 4))")))).alias("px"))
    return own.join(days, "universe").select("universe", "ticker", "axis", F.expr("transform(axis, a -> px[a])").alias("series"))


def price_matrix(daily: DataFrame, monthly: DataFrame, members: DataFrame, days=420):
    """K5: (daily, monthly) matrices; the daily one covers the days before the newest date."""
    top = daily.agg(F.max("date").alias("_top"))
    recent = daily.join(F.broadcast(top)).where(F.col("date") >= F.date_sub("_top", days)).drop("_top")
    return _matrix(recent, members, "date"), _matrix(align_last_month(recent, monthly), members, "month")
