"""Valuation methods, their blend and the derived views (V3-V21, Q8 second pass)."""
from pyspark.sql import DataFrame, functions as F

from ..assumptions import CFG, WEIGHTS
from ..functions import engines as en, ranks
from ..functions.exprs import with_exprs
from ..functions.staging import stage
from .metrics import INFO_FLAGS

RIM_OK = "coalesce(book_ps > 0 AND book_ps / price >= 0.15 AND roe_avg <= 0.40, false)"
FIT_OK = "(arch = 'standard' AND ebit_now > 0 AND (mcap + debt - cash) / ebit_now > 0)"


def with_effective_archetype(df: DataFrame) -> DataFrame:
    """V11, second step: a financial whose book says nothing but whose cash flow is clean is standard."""
    return with_exprs(df, rim_ok=RIM_OK, eff_arch=f"""CASE WHEN arch = 'financial' AND NOT {RIM_OK}
      AND base_fcf > 0 AND mcap <> 0 AND base_fcf / mcap <= 0.06 THEN 'standard' ELSE arch END""")


def with_dcf(df: DataFrame) -> DataFrame:
    return with_exprs(df, dcf_ps=en.dcf_sql())


def with_implied_growth(df: DataFrame, base="base_fcf") -> DataFrame:
    """V4: (implied_g, implied_op)."""
    solved = en.implied_growth(base, "wacc", "term_g", F.expr("debt - cash"), "mcap", "nopat_norm", "roic_dcf")
    return df.withColumn("_imp", solved).withColumns(
        {"implied_g": F.col("_imp.g"), "implied_op": F.col("_imp.op")}).drop("_imp")


def with_epv(df: DataFrame) -> DataFrame:
    return with_exprs(df, epv_ps=en.epv_sql())


def with_rim(df: DataFrame) -> DataFrame:
    """V6 with its gate: balance-sheet businesses whose book is usable."""
    return with_exprs(df, rim_ps=f"if(rim_ok AND eff_arch <> 'standard', {en.rim_sql()}, NULL)")


def with_ddm(df: DataFrame) -> DataFrame:
    """V7: a meaningful dividend that earnings (or a REIT's cash) cover."""
    d = "(div / shares)"
    ok = (f"div <> 0 AND {d} / price >= 0.01 AND (eff_arch = 'reit' OR (ni_now > 0 AND div <= ni_now * 1.5)) "
          f"AND {d} > 0 AND re - term_g >= 0.005")
    df = with_exprs(df, _g="greatest(0D, least(0.08D, coalesce(g1, 0D)))")
    return with_exprs(df, ddm_ps=f"if({ok}, {en.pv_fcf_sql(d, 're', 'term_g', '_g')}, NULL)").drop("_g")


FIT_DIMS = {"y": ("ev_ebit", 5, 60), "g": ("fit_g", 0, 0.30), "m": ("fit_m", 0, 0.60), "r": ("fit_r", 0, 0.50)}


def _clamped(c):
    col, lo, hi = FIT_DIMS[c]
    return f"greatest({float(lo)}D, least({float(hi)}D, {col}))"


def warranted_fit(rows: DataFrame, by, bucket="wbucket", min_bucket=3, cap=28.0):
    """V8: median anchors per bucket (and for everyone), then a no-intercept regression of the centered
    multiple on centered growth, margin and ROIC.  rows: by, bucket, ev_ebit, fit_g, fit_m, fit_r.
    Returns (anchors with scope, coefs), both tiny."""
    by = list(by)
    data = with_exprs(rows.select(*by, F.col(bucket).alias("scope"), "ev_ebit", "fit_g", "fit_m", "fit_r"),
                      **{c: _clamped(c) for c in FIT_DIMS}).select(*by, "scope", *FIT_DIMS)
    arr = ", ".join(f"named_struct('dim', '{c}', 'val', {c})" for c in FIT_DIMS)
    long = (data.select(*by, F.explode(F.array("scope", F.lit("*"))).alias("scope"), *FIT_DIMS)
            .select(*by, "scope", F.explode(F.expr(f"array({arr})")).alias("p")).select(*by, "scope", "p.dim", "p.val"))
    med = ranks.medians(long, "val", [*by, "scope", "dim"]).where(f"scope = '*' OR n_all >= {min_bucket}")
    anchors = med.groupBy(*by, "scope").agg(*[F.expr(f"max(if(dim = '{c}', median, NULL))").alias(f"a_{c}") for c in FIT_DIMS])
    anchors = stage(anchors.withColumn("a_y", F.least("a_y", F.lit(cap))))
    c = with_anchors(data, anchors, by, "scope")
    c = with_exprs(c, y="y - a_y", g="g - a_g", m="m - a_m", r="r - a_r")
    pairs = ["gg", "gm", "gr", "mm", "mr", "rr", "gy", "my", "ry"]
    s = c.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(p[0]) * F.col(p[1])).alias(p) for p in pairs])
    # solve the 3x3 normal equations by elimination, one pivot at a time
    s = with_exprs(s, d1="gg")
    s = with_exprs(s, l21="try_divide(gm, d1)", l31="try_divide(gr, d1)")
    s = with_exprs(s, d2="mm - l21 * gm", e32="mr - l31 * gm")
    s = with_exprs(s, l32="try_divide(e32, d2)")
    s = with_exprs(s, d3="rr - l31 * gr - l32 * e32", y2="my - l21 * gy")
    s = with_exprs(s, y3="ry - l31 * gy - l32 * y2")
    s = with_exprs(s, ok="n > 3 AND d1 >= 1e-10 AND d2 >= 1e-10 AND d3 >= 1e-10", br="try_divide(y3, d3)")
    s = with_exprs(s, bm="try_divide(y2 - e32 * br, d2)")
    s = with_exprs(s, bg="try_divide(gy - gm * bm - gr * br, d1)")
    coefs = s.select(*by, "n", *[F.expr(f"if(ok, greatest(0D, {b}), 0D)").alias(f"c_{b[1]}") for b in ("bg", "bm", "br")])
    return anchors, stage(coefs)


def with_anchors(df: DataFrame, anchors: DataFrame, by, bucket) -> DataFrame:
    """Bucket anchors where the bucket has them, else everyone's.  Anchors are a row per bucket."""
    by = list(by)
    own = anchors.where("scope <> '*'").select(*by, F.col("scope").alias(bucket), *[F.col(f"a_{c}").alias(f"_b{c}") for c in FIT_DIMS])
    glob = anchors.where("scope = '*'").select(*by, *[F.col(f"a_{c}").alias(f"_g{c}") for c in FIT_DIMS])
    df = ranks.with_groups(ranks.with_groups(df, own, [*by, bucket], "left"), glob, by, "left")
    df = df.withColumns({f"a_{c}": F.coalesce(f"_b{c}", f"_g{c}") for c in FIT_DIMS})
    return df.drop(*[f"_b{c}" for c in FIT_DIMS], *[f"_g{c}" for c in FIT_DIMS])


def with_warranted(df: DataFrame, anchors: DataFrame, coefs: DataFrame, by, bucket="wbucket", out="warr_ps") -> DataFrame:
    """V9: anchor plus the fitted deviations, as a multiple of EBIT, per share."""
    df = ranks.with_groups(with_anchors(df, anchors, by, bucket), coefs.drop("n"), by, "left")
    mult = ("greatest(4D, least(40D, a_y + " + " + ".join(f"c_{c} * ({_clamped(c)} - a_{c})" for c in "gmr") + "))")
    df = with_exprs(df, _mult=mult)
    return with_exprs(df, **{out: "if(ebit_now > 0 AND shares <> 0, (_mult * ebit_now - debt + cash) / shares, NULL)"}) \
        .drop("_mult", *[f"a_{c}" for c in FIT_DIMS], *[f"c_{c}" for c in "gmr"])


def with_fit_inputs(df: DataFrame) -> DataFrame:
    return with_exprs(df, ev_ebit="if(ebit_now > 0, (mcap + debt - cash) / ebit_now, NULL)", fit_g="g1",
                      fit_m="coalesce(om, 0D)", fit_r="coalesce(roic_dcf, roic, 0D)")


def with_pffo(df: DataFrame, by=("universe",), lo=8.0, hi=20.0, min_n=5) -> DataFrame:
    """Funds from operations at the clamped median multiple of at least five REITs."""
    pool = with_exprs(df.where("eff_arch = 'reit' AND ffo_ps > 0"), pffo="price / ffo_ps").where("pffo > 0")
    med = ranks.medians(pool, "pffo", list(by), "_anchor").where(f"n_all >= {min_n}").drop("n_all")
    df = ranks.with_groups(df, med, by, "left")
    return with_exprs(df, ffo=f"if(eff_arch = 'reit' AND ffo_ps > 0, greatest({lo}D, least({hi}D, _anchor)) * ffo_ps, NULL)",
                      _a="_anchor").withColumn("ffo", F.when(F.col("_anchor").isNotNull(), F.col("ffo"))).drop("_a", "_anchor")


def apply_gates(df: DataFrame) -> DataFrame:
    """Cash-flow methods only for standard names; FFO replaces RIM."""
    gate = {c: f"if(eff_arch = 'standard', {c}, NULL)" for c in ("dcf_ps", "epv_ps", "warr_ps", "implied_g", "implied_op")
            if c in df.columns}
    return with_exprs(df, rim_ps="if(ffo IS NULL, rim_ps, NULL)", **gate)


METHODS = {"DCF": "dcf_ps", "RIM": "rim_ps", "Warranted": "warr_ps", "FFO": "ffo", "DDM": "ddm_ps"}


def triangulate(df: DataFrame, methods=None, weights=None, floor="epv_ps", band=None) -> DataFrame:
    """Weighted mid of the positive methods, range with the floor, agreement 2-5.
    A weight may be a number or a column name."""
    methods, weights = methods or METHODS, weights or WEIGHTS
    arr = ", ".join(f"named_struct('v', {col}, 'w', cast({weights.get(k, 0.10)} AS double))" for k, col in methods.items())
    df = with_exprs(df, _ms=f"filter(array({arr}), m -> m.v > 0)", _fl=f"if({floor} > 0, {floor}, NULL)")
    df = with_exprs(df, n_methods="size(_ms)", mid="""coalesce(try_divide(aggregate(_ms, 0D, (a, m) -> a + m.v * m.w),
      aggregate(_ms, 0D, (a, m) -> a + m.w)), _fl)""")
    df = with_exprs(df, _vs="array_compact(array_append(transform(_ms, m -> m.v), _fl))",
                    within="size(filter(_ms, m -> abs(m.v / mid - 1) <= 0.10))")
    high = "array_max(_vs)" if band is None else f"if({band} > 0, greatest(array_max(_vs), mid * (1 + {band})), array_max(_vs))"
    return with_exprs(df, low="array_min(_vs)", high=f"if(mid IS NULL, NULL, {high})", upside="mid / price - 1",
                      conf="""CASE WHEN n_methods < 2 THEN 2 WHEN within / n_methods >= 0.99 THEN 5
                        WHEN within / n_methods >= 0.66 THEN 4 WHEN within / n_methods >= 0.5 THEN 3 ELSE 2 END""") \
        .drop("_ms", "_fl", "_vs")


def with_band(df: DataFrame) -> DataFrame:
    """How unpredictable the business is."""
    return with_exprs(df, band=f"{CFG['range_base_band']}D + (1 - coalesce(quality, 50) / 100D) * {CFG['range_quality_scale']}D "
                               f"+ if(cyclical, {CFG['range_cyclical_adder']}D, 0D)")


def scenarios(df: DataFrame) -> DataFrame:
    """Bear, base and bull values from shifted drivers, and the weighted expectation."""
    df = with_exprs(df, _u=f"least({CFG['scenario_scale_cap']}D, greatest(1D, band / {CFG['range_base_band']}))")
    df = with_exprs(df, _dg=f"{CFG['scenario_delta_growth']} * _u", _dw=f"{CFG['scenario_delta_wacc']} * _u",
                    _rel=f"least(0.5D, {CFG['scenario_delta_margin']} * _u / greatest(coalesce(nullif(om, 0D), 0.05D), 0.05D))")
    df = with_exprs(df, _wu=f"greatest(wacc - _dw, term_g + {CFG['min_wacc_minus_g'] + 0.005!r}D)", _wd="wacc + _dw",
                    _gu=f"least(g1 + _dg, {CFG['initial_growth_cap'] + 0.10!r}D)", _gd="greatest(g1 - _dg, -0.05D)",
                    _nu="nopat_norm * (1 + _rel)", _nd="nopat_norm * (1 - _rel)")
    df = with_exprs(df, _ok="coalesce(dcf_ps > 0 AND nopat_norm > 0 AND roic_dcf > 0 AND mid > 0 AND price > 0, false)")
    df = with_exprs(df, _bull=f"if(_ok, {en.dcf_profit_sql('_wu', '_gu', '_nu')}, NULL)",
                    _bear=f"if(_ok, {en.dcf_profit_sql('_wd', '_gd', '_nd')}, NULL)")
    df = with_exprs(df, bull=f"if(_ok, greatest(mid, mid * least(coalesce(_bull / dcf_ps, 1D), {CFG['scenario_bull_cap']}D)), NULL)",
                    _bear=f"if(_ok, least(mid, mid * if(_bear IS NULL, 1D, greatest(_bear / dcf_ps, {CFG['scenario_bear_floor']}D))), NULL)")
    wb, w0, wu = CFG["scenario_probs"]
    df = with_exprs(df, bear="if(_ok, greatest(0D, if(epv_ps > 0 AND epv_ps < mid, greatest(_bear, epv_ps), _bear)), NULL)",
                    base="if(_ok, mid, NULL)")
    df = with_exprs(df, pw=f"{wb} * bear + {w0} * base + {wu} * bull")
    return with_exprs(df, exp_base="base / price - 1", exp_pw="pw / price - 1",
                      ann_pw=f"if(pw > 0, pow(pw / price, 1D / {CFG['scenario_converge_yrs']}) - 1, NULL)") \
        .drop("_u", "_dg", "_dw", "_rel", "_wu", "_wd", "_gu", "_gd", "_nu", "_nd", "_bull", "_bear", "_ok")


def sensitivity_grid(df: DataFrame, growths, waccs) -> DataFrame:
    """The same DCF at each pair of shifts; the grid is a short literal list."""
    steps = ", ".join(f"named_struct('dg', {g!r}D, 'dw', {w!r}D)" for g in map(float, growths) for w in map(float, waccs))
    df = df.withColumn("s", F.explode(F.expr(f"array({steps})")))
    df = with_exprs(df, dg="s.dg", dw="s.dw", _g="g1 + s.dg", _w="wacc + s.dw")
    return with_exprs(df, grid_ps=en.dcf_sql(rate="_w", g="_g")).drop("s", "_g", "_w")


ADR_SANE = "coalesce(price > 0 AND mid <> 0 AND mid BETWEEN price / 10 AND price * 10, false)"


def adr_guard(df: DataFrame) -> DataFrame:
    """A foreign filer whose value is ten times off its price is a unit mismatch."""
    return with_exprs(df, adr_bad=f"coalesce(form = '20-F', false) AND NOT {ADR_SANE}")


def with_second_exclusion(df: DataFrame) -> DataFrame:
    """Q8, second pass: reasons known only after valuation."""
    return with_exprs(df, why=f"""CASE WHEN why IS NOT NULL THEN why WHEN mid IS NULL THEN CASE arch
      WHEN 'financial' THEN 'financial: RIM only, and book value/ROE not usable'
      WHEN 'reit' THEN 'reit: unpriceable, no positive FFO base and book unusable'
      ELSE 'no positive FCF/earnings base (GAAP loss-maker)' END
      WHEN form = '20-F' AND NOT {ADR_SANE} THEN 'ADR: per-share value failed the 10x sanity bound' END""")


def excluded(df: DataFrame) -> DataFrame:
    return df.where("why IS NOT NULL").select("universe", "ticker", "why")


def with_score(df: DataFrame) -> DataFrame:
    """Upside x agreement x quality x flag decay; a missing or zero quality counts as 50."""
    info = ", ".join(f"'{f}'" for f in INFO_FLAGS)
    df = with_exprs(df, quality="coalesce(nullif(quality, 0), 50)", _pen=f"size(array_except(flags, array({info})))")
    return with_exprs(df, score="(greatest(-0.5D, least(0.6D, upside)) + 0.5) * (conf / 5D) * (quality / 100D) * pow(0.85D, _pen)").drop("_pen")


def method_weights(df: DataFrame) -> DataFrame:
    """Each applicable method's share of the blend."""
    arr = ", ".join(f"named_struct('method', '{k}', 'value', {c}, 'w', {WEIGHTS[k]}D)" for k, c in METHODS.items())
    df = with_exprs(df, _ms=f"filter(array({arr}), m -> m.value IS NOT NULL)")
    df = with_exprs(df, _tw="aggregate(_ms, 0D, (a, m) -> a + m.w)")
    return (df.select("universe", "ticker", "_tw", F.explode("_ms").alias("m"))
            .select("universe", "ticker", "m.method", "m.value", (F.col("m.w") / F.col("_tw")).alias("share")))


def with_verdict(df: DataFrame) -> DataFrame:
    """Words for the valuation, the implied growth and the agreement."""
    return with_exprs(
        df, verdict="CASE WHEN upside > 0.04 THEN 'Undervalued' WHEN upside < -0.04 THEN 'Overvalued' ELSE 'Fairly valued' END",
        growth_view="""CASE WHEN implied_g IS NULL OR g_trail IS NULL THEN NULL WHEN implied_g > g_trail + 0.04 THEN 'optimistic'
          WHEN implied_g < greatest(-0.3D, g_trail - 0.04) THEN 'pessimistic' ELSE 'roughly in line' END""",
        agreement="CASE WHEN n_methods <= 1 THEN 'Single method' WHEN conf >= 4 THEN 'Strong' WHEN conf >= 3 THEN 'Fair' ELSE 'Wide range' END")


def with_counter_case(df: DataFrame) -> DataFrame:
    """Measured reasons against the model's side of the trade."""
    cheap = [("implied_g < g_trail - 0.04", "implied growth below trailing"), ("mom_pct <= 35", "weak momentum"),
             ("quality < 48", "low quality"), ("n_methods <= 1", "single method"), ("n_methods > 1 AND conf <= 2", "engines disagree")]
    dear = [("implied_g > g_trail + 0.04", "implied growth above trailing"), ("mom_pct >= 65", "strong momentum"), ("quality >= 70", "high quality")]

    def items(rules):
        return "array_compact(array(" + ", ".join(f"CASE WHEN {t} THEN '{label}' END" for t, label in rules) + "))"

    return with_exprs(df, counter_case=f"CASE WHEN upside > 0.04 THEN {items(cheap)} WHEN upside < -0.04 THEN {items(dear)} "
                                       "ELSE cast(array() AS array<string>) END")
