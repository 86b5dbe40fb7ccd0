"""Ranks, scores and neutral comparisons across companies."""
from pyspark.sql import DataFrame, functions as F

from ..functions import ranks
from ..functions.exprs import with_exprs
from ..functions.staging import stage


def with_pct_rank(df: DataFrame, col: str, by, out: str) -> DataFrame:
    """Share of the pool at or below the value; nulls stay out of the pool."""
    return ranks.with_cume_dist(df, col, list(by), out)


def mean_rank(df: DataFrame, keys, pool, dims: dict) -> DataFrame:
    """Average percentile rank over the dimensions a row has.  All dimensions rank in one pass,
    as long rows keyed by (pool, dimension)."""
    arr = ", ".join(f"named_struct('dim', '{k}', 'val', cast({v} AS double))" for k, v in dims.items())
    long = (df.select(*keys, *[c for c in pool if c not in keys], F.explode(F.expr(f"array({arr})")).alias("p"))
            .select("*", "p.dim", "p.val").drop("p").where("val IS NOT NULL"))
    long = ranks.with_cume_dist(long, "val", [*pool, "dim"], "pr")
    return long.groupBy(*keys).agg(F.avg("pr").alias("mean_rank"))


STANDARD_DIMS = {"om": "om", "roe": "roe_avg", "roic": "roic", "fcfm": "fcf_margin",
                 "lowlev": "if(ebit_now > 0, -(debt_risk - cash) / ebit_now, NULL)"}
BALANCE_DIMS = {"roe": "roe_avg", "stab": "-roe_std", "cap": "eq_assets"}


def with_quality(df: DataFrame, by=("universe",)) -> DataFrame:
    """Mean percentile rank among archetype peers, 0-100; financials and REITs share a pool of
    at least five, else they get no score."""
    df = with_exprs(df, pool="if(eff_arch = 'standard', 'standard', 'balance')")
    std = {f"s_{k}": f"if(pool = 'standard', {v}, NULL)" for k, v in STANDARD_DIMS.items()}
    bal = {f"b_{k}": f"if(pool = 'balance', {v}, NULL)" for k, v in BALANCE_DIMS.items()}
    score = mean_rank(df, [*by, "ticker"], [*by, "pool"], {**std, **bal})
    peers = df.groupBy(*by, "pool").agg(F.count(F.lit(1)).alias("_peers"))
    df = ranks.with_groups(df.join(score, [*by, "ticker"], "left"), peers, [*by, "pool"])
    return with_exprs(df, quality="if(pool = 'standard' OR _peers >= 5, "
                                  "cast(bround(round(100 * mean_rank, 9)) AS int), NULL)").drop("mean_rank", "_peers", "pool")


def assign_buckets(df: DataFrame, overrides: DataFrame, by_sic: DataFrame, fit_ok: str, min_bucket=8,
                   by=("universe",)) -> DataFrame:
    """Override, else SIC (information technology only), else sector; a split bucket with too few
    fitted names goes back to its sector.  Both maps are configuration."""
    df = (df.join(F.broadcast(overrides.select("ticker", F.col("bucket").alias("_o"))), "ticker", "left")
          .join(F.broadcast(by_sic.select("sic", F.col("bucket").alias("_s"))), "sic", "left"))
    df = with_exprs(df, _b="coalesce(_o, if(sector = 'Information Technology', _s, NULL), sector)")
    fitted = df.groupBy(*by, "_b").agg(F.expr(f"count_if({fit_ok})").alias("_n"))
    df = ranks.with_groups(df, fitted, [*by, "_b"], "left")
    return with_exprs(df, wbucket=f"if(_b = sector OR _n >= {min_bucket}, _b, sector)").drop("_o", "_s", "_b", "_n")


def winsorize(df: DataFrame, col: str, by, p=0.05, out=None) -> DataFrame:
    """Values limited to the order statistics at int(p(n-1)) and int((1-p)(n-1))."""
    by = list(by)
    lim = ranks.order_statistics(df, col, by, {
        "_wlo": f"cast(floor({p}D * (n_all - 1)) AS bigint)", "_whi": f"cast(floor({1 - p}D * (n_all - 1)) AS bigint)"}).drop("n_all")
    out = out or col
    return (ranks.with_groups(df, lim, by, "left")
            .withColumn(out, F.expr(f"if({col} IS NULL, NULL, greatest(_wlo, least(_whi, {col})))")).drop("_wlo", "_whi"))


def sector_z(df: DataFrame, col: str, by, out: str, sector="sector", min_n=5) -> DataFrame:
    """Winsorized z-score within sector, by the whole group where the sector is thin."""
    by = list(by)
    w = winsorize(df, col, by, out="_w").withColumn("_sec", F.coalesce(F.col(sector), F.lit("UNKNOWN")))
    sec = w.groupBy(*by, "_sec").agg(F.count("_w").alias("_n"), F.avg("_w").alias("_m"), F.stddev_pop("_w").alias("_sd"))
    grp = w.groupBy(*by).agg(F.avg("_w").alias("_gm"), F.stddev_pop("_w").alias("_gs"))
    w = ranks.with_groups(ranks.with_groups(w, sec, [*by, "_sec"], "left"), grp, by, "left")
    w = with_exprs(w, _gs="coalesce(nullif(_gs, 0D), 1D)")
    z = (f"(_w - if(_n >= {min_n}, _m, _gm)) / if(_n >= {min_n} AND _sd > 1e-12, _sd, _gs)")
    return with_exprs(w, **{out: f"if(_w IS NULL, NULL, greatest(-3D, least(3D, {z})))"}) \
        .drop("_w", "_sec", "_n", "_m", "_sd", "_gm", "_gs")


def sector_z_many(df: DataFrame, cols, by, sector="sector", tie="ticker") -> DataFrame:
    """X5 for several columns in one pass: long rows keyed by column, then a column z_<name> each."""
    by = list(by)
    arr = ", ".join(f"named_struct('leg', '{c}', 'val', cast({c} AS double))" for c in cols)
    long = (df.select(*by, tie, sector, F.explode(F.expr(f"array({arr})")).alias("p"))
            .select(*by, tie, sector, "p.leg", "p.val").where("val IS NOT NULL"))
    z = sector_z(long, "val", [*by, "leg"], "z", sector)
    wide = z.groupBy(*by, tie).agg(*[F.expr(f"max(if(leg = '{c}', z, NULL))").alias(f"z_{c}") for c in cols])
    return df.join(wide, [*by, tie], "left")


def factor_blend(df: DataFrame, legs: dict, weights: dict, out="score") -> DataFrame:
    """Average the legs of each factor, then weight the factors a row has."""
    parts = []
    for f, cols in legs.items():
        arr = f"filter(array({', '.join(cols)}), x -> x IS NOT NULL)"
        mean = f"try_divide(aggregate({arr}, 0D, (a, x) -> a + x), size({arr}))"
        parts.append(f"named_struct('w', cast({weights[f]} AS double), 'v', {mean})")
    arr = f"filter(array({', '.join(parts)}), p -> p.v IS NOT NULL)"
    num = f"aggregate({arr}, 0D, (a, p) -> a + p.w * p.v)"
    den = f"aggregate({arr}, 0D, (a, p) -> a + p.w)"
    return with_exprs(df, **{out: f"coalesce(try_divide({num}, {den}), 0D)"})


def rank_blend(df: DataFrame, score: str, gap: str, by, w, out="score") -> DataFrame:
    """(1 - w) rank(score) + w rank(gap); without a gap the score's rank stands."""
    df = with_pct_rank(with_pct_rank(df, score, by, "_rs"), gap, by, "_rg")
    return with_exprs(df, **{out: f"if(_rg IS NULL, _rs, (1 - {w}) * _rs + {w} * _rg)"}).drop("_rs", "_rg")


def equal_count_buckets(df: DataFrame, key: str, n: int, by, tie="ticker", out="bucket") -> DataFrame:
    """N buckets of equal count, low to high; groups with under n rows give none."""
    by = list(by)
    rows = ranks.with_position(df, key, by, tie, out="_p", total="_l").where(f"_l >= {n}")
    return with_exprs(rows, **{out: f"cast((_p * {n} - 1) DIV _l AS int)"}).drop("_p", "_l")


def neutralize(df: DataFrame, group: str, by, value="fwd", least=3) -> DataFrame:
    """Subtract the group mean; groups under three rows drop out."""
    keys = [*by, group]
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count(value).alias("_c")).where(F.col("_c") >= least)
    return ranks.with_groups(df, stats, keys).withColumn(value, F.col(value) - F.col("_m")).drop("_m", "_c")


def sector_neutral(df: DataFrame, by, value="fwd") -> DataFrame:
    return neutralize(df.withColumn("_g", F.coalesce("sector", F.lit("?"))), "_g", by, value).drop("_g")


def beta_neutral(df: DataFrame, by, n=5, value="fwd", tie="ticker") -> DataFrame:
    """Neutral within beta bands of equal count; groups under 3n rows drop out."""
    rows = ranks.with_position(df, "beta", list(by), tie, out="_p", total="_l").where(f"_l >= {3 * n}")
    rows = with_exprs(rows, _g=f"cast(least({n - 1}, (_p - 1) * {n} DIV _l) AS int)").drop("_p", "_l")
    return neutralize(rows, "_g", by, value).drop("_g")


def tolerant_ranks(df: DataFrame, col: str, by, out="avg_rank") -> DataFrame:
    """X11: average ranks; values closer than 1e-9 relative tie."""
    return ranks.with_tolerant_rank(df, col, list(by), out)


def rank_ic(df: DataFrame, x: str, y: str, by) -> DataFrame:
    """Spearman correlation per group; null under three pairs or without variance.
    Both columns rank in one pass, as long rows keyed by column."""
    by = list(by)
    rows = stage(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")))
    long = rows.select(*by, F.explode(F.array(F.struct(F.lit("x").alias("c"), F.col("_x").alias("v")),
                                              F.struct(F.lit("y").alias("c"), F.col("_y").alias("v")))).alias("p"))
    cells = ranks.tolerant_cells(long.select(*by, F.col("p.c").alias("_c"), F.col("p.v").alias("_v")), "_v", [*by, "_c"])
    for c in ("x", "y"):
        rank = cells.where(F.col("_c") == c).select(*by, F.col("_v").alias(f"_{c}"), F.col("avg_rank").alias(f"_r{c}"))
        rows = rows.join(rank, [*by, f"_{c}"])
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.expr(
        "if(count(1) >= 3, round(try_divide(covar_pop(_rx, _ry), stddev_pop(_rx) * stddev_pop(_ry)), 4), NULL)").alias("ic"))


def median_by(df: DataFrame, col: str, by, out="median") -> DataFrame:
    """X13."""
    return ranks.medians(df, col, list(by), out)


def peer_percentile(df: DataFrame, cols, lower_better=(), by=("universe",)) -> DataFrame:
    """Percentile among sector peers, or among everyone when the sector has under five names;
    null when fewer than five values can be ranked."""
    by = list(by)
    size = df.groupBy(*by, "sector").agg(F.count(F.lit(1)).alias("_n"))
    rows = with_exprs(ranks.with_groups(df, size, [*by, "sector"]), wide="_n < 5")
    arr = ", ".join(f"named_struct('dim', '{c}', 'val', cast({'-' if c in lower_better else ''}{c} AS double))" for c in cols)
    long = (rows.select(*by, "ticker", "sector", "wide", F.explode(F.expr(f"array({arr})")).alias("p"))
            .select(*by, "ticker", "sector", "wide", "p.dim", "p.val").where("val IS NOT NULL"))
    pools = long.withColumn("pool", F.explode(F.array("sector", F.lit("*"))))
    cells = ranks.value_cells(pools, "val", [*by, "dim", "pool"])
    mine = with_exprs(long, pool="if(wide, '*', sector)")
    out = (mine.join(cells, [*by, "dim", "pool", "val"])
           .select(*by, "ticker", "dim", F.expr("if(n_all >= 5, (n_lt + n_eq) / n_all, NULL)").alias("pct")))
    wide = out.groupBy(*by, "ticker").agg(*[F.expr(f"max(if(dim = '{c}', pct, NULL))").alias(f"{c}_pct") for c in cols])
    return df.select(*by, "ticker").join(wide, [*by, "ticker"], "left")


def peers(df: DataFrame, n=5, by=("universe",)) -> DataFrame:
    """The n largest sector peers of each company.  Only the n+1 largest of a sector can be
    anyone's peers, so companies meet those few, not each other."""
    by = list(by)
    top = ranks.with_position(df, "mcap", [*by, "sector"], "ticker", out="place", desc=True)
    top = top.where(f"place <= {n + 1}").select(*by, "sector", F.col("ticker").alias("peer"), "place",
                                                F.col("mcap").alias("peer_mcap"))
    mine = ranks.with_groups(df.select(*by, "sector", "ticker"), top, [*by, "sector"]).where("ticker <> peer")
    self_ = top.select(*by, F.col("peer").alias("ticker"), F.col("place").alias("own"))
    mine = mine.join(self_, [*by, "ticker"], "left")
    return (with_exprs(mine, rank="cast(if(own < place, place - 1, place) AS int)").where(f"rank <= {n}")
            .select(*by, "ticker", "peer", "rank", "peer_mcap"))


def axis_bounds(df: DataFrame, by=("universe",)) -> DataFrame:
    """Robust axis limits from the 2nd and 96th percentiles, and how many names fall outside."""
    by = list(by)
    ix = "least(n_all - 1, greatest(0, cast(floor({}D / 100 * n_all) AS bigint)))"
    lim = ranks.order_statistics(df, "upside", by, {"p2": ix.format(2), "p96": ix.format(96)})
    lim = with_exprs(lim, x_min="greatest(-1D, least(-0.10D, floor((p2 - 0.04D) * 20) / 20D))",
                     x_max="least(2.5D, greatest(0.30D, ceil((p96 + 0.06D) * 20) / 20D))")
    return (ranks.with_groups(df.select(*by, "upside"), lim, by).groupBy(*by).agg(
        F.max("x_min").alias("x_min"), F.max("x_max").alias("x_max"),
        F.expr("count_if(upside > x_max OR upside < x_min)").alias("off_chart")))


def kpis(df: DataFrame, by=("universe",)) -> DataFrame:
    """Headline counts and the upper median of upside."""
    by = list(by)
    mid = ranks.order_statistics(df, "upside", by, {"median_upside": "n_all DIV 2"}).drop("n_all")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("covered"), F.expr("count_if(upside > 0.15)").alias("undervalued"),
        F.expr("count_if(quality >= 70)").alias("pass_quality"),
        F.expr("count_if(size(flags) > 0)").alias("flagged")).join(mid, by)
