"""Does predicted upside predict forward return?"""
from pyspark.sql import DataFrame, functions as F

from ..functions import ranks
from ..functions.exprs import with_exprs
from . import crosssection as x
from .ledger import session_asof, session_calendar

KEY = ["universe", "model", "session"]
CONF_BANDS = [(1, 2), (3, 3), (4, 5)]  # fixed values
QUALITY_BANDS = [(0, 39), (40, 59), (60, 79), (80, 100)]  # fixed values


def panel_rows(snapshots: DataFrame, prices: DataFrame, sessions: DataFrame, horizon=5) -> DataFrame:
    """Earliest snapshot per (session, ticker) with its forward return where both prices exist; sessions
    whose window is still open are out."""
    snap = session_asof(snapshots.withColumn("day", F.to_date("run_date")), sessions).where("session IS NOT NULL")
    first = snap.groupBy(*KEY, "ticker").agg(
        F.max("pos").alias("pos"), F.min_by(F.struct("upside", "score", "quality", "conf"), "run_date").alias("r"))
    cal = F.broadcast(session_calendar(sessions).select(F.col("session").alias("exit_day"), (F.col("pos") - horizon).alias("pos")))
    px = prices.where("adjclose <> 0").select("ticker", "date", "adjclose")
    rows = first.join(cal, "pos").select(*KEY, "ticker", "pos", "exit_day", "r.*")
    rows = rows.join(px.select("ticker", F.col("date").alias("session"), F.col("adjclose").alias("p0")), ["ticker", "session"], "left")
    rows = rows.join(px.select("ticker", F.col("date").alias("exit_day"), F.col("adjclose").alias("p1")), ["ticker", "exit_day"], "left")
    return with_exprs(rows, fwd="p1 / p0 - 1").drop("p0", "p1")


def calibration_panel(rows: DataFrame, attrs: DataFrame, min_names=30) -> DataFrame:
    """The rows with a forward return, sector and beta, of sessions with enough names."""
    ok = rows.where("fwd IS NOT NULL").join(attrs.select("ticker", "sector", "beta"), "ticker", "left")
    n = ok.groupBy(*KEY).agg(F.count(F.lit(1)).alias("names")).where(f"names >= {min_names}")
    return ok.join(n, KEY)


def ic_by_session(panel: DataFrame) -> DataFrame:
    """W8, per session: rank IC of upside and score, and of upside after sector and beta neutralizing."""
    parts = [("upside", panel, "upside"), ("score", panel, "score"), ("upside_sector_neutral", x.sector_neutral(panel, KEY), "upside"),
             ("upside_beta_neutral", x.beta_neutral(panel, KEY), "upside")]
    long = None
    for label, df, field in parts:
        rows = df.select(*KEY, "ticker", "fwd", F.col(field).alias("pred"), F.lit(label).alias("measure"))
        long = rows if long is None else long.unionByName(rows)
    return x.rank_ic(long, "pred", "fwd", [*KEY, "measure"]).where("ic IS NOT NULL")


def ic_series(per_session: DataFrame) -> DataFrame:
    """Mean IC and hit rate per measure."""
    return per_session.groupBy("universe", "model", "measure").agg(
        F.count(F.lit(1)).alias("sessions"), F.expr("round(avg(ic), 4)").alias("mean_ic"),
        F.expr("round(count_if(ic > 0) / count(1), 3)").alias("hit_rate"))


def independent_windows(panel: DataFrame, horizon=5, needed=12) -> DataFrame:
    """How many sessions lie at least a horizon apart, taken greedily; the list is calendar-sized."""
    pos = panel.select("universe", "model", "pos").distinct().groupBy("universe", "model").agg(F.array_sort(F.collect_list("pos")).alias("ps"))
    pick = (f"aggregate(ps, named_struct('n', 0, 'last', cast(NULL AS int)), (a, p) -> if(a.last IS NULL OR p - a.last >= {horizon}, "
            "named_struct('n', a.n + 1, 'last', p), a)).n")
    return with_exprs(pos, independent=pick, sessions="size(ps)").withColumn("readable", F.col("independent") >= needed).drop("ps")


def decile_table(panel: DataFrame, n=10) -> DataFrame:
    """Forward return by decile of predicted upside over the pooled rows."""
    rows = panel.withColumn("row_id", F.concat_ws("|", F.col("session").cast("string"), "ticker"))
    by = ["universe", "model"]
    rows = x.equal_count_buckets(rows, "upside", n, by, tie="row_id")
    med = ranks.medians(rows.where("fwd IS NOT NULL"), "fwd", [*by, "bucket"], "median_fwd").drop("n_all")
    return (rows.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("upside").alias("mean_upside"), F.avg("fwd").alias("mean_fwd"),
                                            F.avg("beta").alias("mean_beta")).join(med, [*by, "bucket"])
            .withColumn("decile", F.col("bucket") + 1).drop("bucket"))


def ic_by_band(panel: DataFrame, min_names=30) -> DataFrame:
    """Pooled IC inside bands of confidence and quality; thin bands are left out."""
    bands = ", ".join(f"named_struct('field', '{f}', 'lo', {lo}, 'hi', {hi}, 'v', {f})"
                      for f, edges in (("conf", CONF_BANDS), ("quality", QUALITY_BANDS)) for lo, hi in edges)
    rows = (panel.withColumn("b", F.explode(F.expr(f"filter(array({bands}), b -> b.v BETWEEN b.lo AND b.hi)")))
            .select("universe", "model", "upside", "fwd", "b.field", F.expr("concat(b.lo, '-', b.hi)").alias("band")))
    by = ["universe", "model", "field", "band"]
    fwd = rows.groupBy(*by).agg(F.expr("round(avg(fwd), 4)").alias("mean_fwd"), F.count(F.lit(1)).alias("rows")).where(f"rows >= {min_names}")
    return x.rank_ic(rows, "upside", "fwd", by).drop("n").join(fwd, by).withColumnRenamed("rows", "n")


def decile_spread(deciles: DataFrame) -> DataFrame:
    """Forward return of the top decile over the bottom one."""
    ends = deciles.groupBy("universe", "model").agg(F.max_by("mean_fwd", "decile").alias("top"), F.min_by("mean_fwd", "decile").alias("bottom"))
    return with_exprs(ends, spread="round(top, 4) - round(bottom, 4)")


def verdict(ic: DataFrame, deciles: DataFrame, windows: DataFrame, needed=12) -> DataFrame:
    """How much of the raw IC survives neutralizing, and whether the cheap decile is a beta bet.  With fewer
    independent windows than needed nothing is pronounced.  windows: independent_windows of the same panel."""
    by = ["universe", "model"]
    m = ic.groupBy(*by).agg(*[F.expr(f"max(if(measure = '{k}', mean_ic, NULL))").alias(a) for k, a in (
        ("upside", "raw"), ("upside_sector_neutral", "sec"), ("upside_beta_neutral", "bet"))])
    d = deciles.groupBy(*by).agg(F.min_by("mean_beta", "decile").alias("b0"), F.max_by("mean_beta", "decile").alias("b1"))
    m = m.join(d, by, "left").join(windows.select(*by, "independent"), by, "left").join(decile_spread(deciles).select(*by, "spread"), by, "left")

    def part(col, label):
        return (f"CASE WHEN {col} IS NULL THEN '{label}-neutral not measurable' WHEN try_divide({col}, raw) >= 0.5 THEN '{label}-neutral survives' "
                f"ELSE 'mostly a {label} bet' END")

    text = (f"concat_ws('; ', concat(if(raw > 0, 'upside predicts', 'upside anti-predicts'), format_string(' (IC %.4f)', raw)), {part('sec', 'sector')}, {part('bet', 'beta')}, "
            "if(abs(b1 - b0) > 0.15, 'beta gap', NULL), format_string('top-bottom spread %.4f', spread))")
    early = f"concat('not readable: ', coalesce(independent, 0), ' of {needed} independent windows')"
    return with_exprs(m, verdict=f"CASE WHEN coalesce(independent, 0) < {needed} THEN {early} WHEN raw IS NULL THEN 'no measurable IC' ELSE {text} END") \
        .select(*by, "verdict")
