"""Queries over snapshots, the forward ledger and calibration."""
from pyspark.sql import functions as F

from . import bindings as b
from .registry import query, tidy
from ..functions.exprs import with_exprs
from ..functions.staging import keep, new_folder
from ..operators import calibration as cal, crosssection as x, ledger as lg, snapshots as sn


def snaps(spark, d):
    return keep(spark, d, "snapshots", lambda: b.snapshots(spark, d))


def closes(spark, d):
    return keep(spark, d, "session_prices", lambda: b.session_prices(b.daily_prices(spark, d)))


def arrivals(spark, d):
    """All snapshots in three universes: their last day arrives in a new week, in the week of the day before, and again
    on the day itself.  What was there, and what arrives."""
    s = snaps(spark, d)
    top = s.groupBy("model").agg(F.max(F.to_date("run_date")).alias("_top"))
    s = s.join(top, "model").withColumn("universe", F.explode(F.array(F.lit("week"), F.lit("skip"), F.lit("again"))))
    s = with_exprs(s, _new="to_date(run_date) = _top AND (universe <> 'again' OR hour(run_date) >= 12)")
    s = s.withColumn("run_date", F.expr("if(universe = 'week' AND NOT _new, run_date - INTERVAL 7 DAYS, run_date)"))
    return s.where("NOT _new").drop("_new", "_top"), s.where("_new").drop("_new", "_top")


def by_day(out):
    return out.groupBy("universe", "model", F.to_date("run_date").cast("string").alias("day")).agg(
        F.countDistinct("run_date").alias("runs"), F.count(F.lit(1)).alias("n"))


@query
def weekly_gate(spark, d):
    return by_day(sn.append_snapshots(*arrivals(spark, d)))


@query
def snapshot_table(spark, d):
    """K3 into a table partitioned by universe, model and day, read back."""
    old, new = arrivals(spark, d)
    path = new_folder(spark)
    old.withColumn("_day", F.to_date("run_date")).repartition("universe", "model", "_day").write.partitionBy("universe", "model", "_day").parquet(path)
    sn.write_snapshots(path, new)
    return by_day(spark.read.parquet(path))


@query
def change_digest(spark, d):
    s = snaps(spark, d)
    top = s.groupBy("universe", "model").agg(F.max("run_date").alias("run_date"))
    cur = s.join(top, ["universe", "model", "run_date"])
    return sn.change_digest(cur, s).select("model", "kind", "place", "ticker", "detail")


@query
def session_asof(spark, d):
    days = b.daily_prices(spark, d).select("ticker", F.col("date").alias("day"))
    return tidy(lg.session_asof(days, b.sessions(spark, d)), ["ticker", "day", "session"])


@query
def run_collapse(spark, d):
    return tidy(lg.collapse_runs(snaps(spark, d), b.sessions(spark, d)), ["model", "session", "day", "collapsed"])


def baskets(spark, d):
    return keep(spark, d, "baskets", lambda: lg.ledger(snaps(spark, d), closes(spark, d), b.sessions(spark, d)))


@query
def forward_ledger(spark, d):
    return tidy(baskets(spark, d), ["model", "session", "k", "covered", "missing", "age_days", "trading_days"], basket_ret=4, bench_ret=4, excess=4)


@query
def ledger_summary(spark, d):
    rows = lg.ledger_rows(snaps(spark, d), closes(spark, d), b.sessions(spark, d))
    out = lg.ledger_summary(baskets(spark, d), rows, lg.collapse_runs(snaps(spark, d), b.sessions(spark, d)))
    return tidy(out, ["model", "baskets", "oldest_days", "aged", "collapsed", "distinct_baskets"], hit_rate=3, avg_excess=6, avg_overlap=3)


def panel(spark, d):
    return keep(spark, d, "panel", lambda: cal.calibration_panel(
        cal.panel_rows(snaps(spark, d), closes(spark, d), b.sessions(spark, d)), b.user_attrs(spark, d)))


@query
def calibration_panel(spark, d):
    return tidy(panel(spark, d), ["model", "session", "ticker", "sector", "quality", "conf"], upside=6, fwd=6, beta=3)


@query
def panel_dropped(spark, d):
    rows = cal.panel_rows(snaps(spark, d), closes(spark, d), b.sessions(spark, d))
    return tidy(rows.groupBy("model", "session").agg(F.expr("count_if(fwd IS NULL)").alias("dropped"), F.count(F.lit(1)).alias("n")), ["model", "session", "dropped", "n"])


def per_session(spark, d):
    return keep(spark, d, "per_session", lambda: cal.ic_by_session(panel(spark, d)))


@query
def rank_ic(spark, d):
    return tidy(per_session(spark, d).where("measure IN ('upside', 'score')"), ["model", "session", "measure", "n"], ic=3)


@query
def neutral_ic(spark, d):
    return tidy(per_session(spark, d).where("measure LIKE '%neutral'"), ["model", "session", "measure", "n"], ic=3)


@query
def ic_series(spark, d):
    return tidy(cal.ic_series(per_session(spark, d)), ["model", "measure", "sessions"], mean_ic=3, hit_rate=2)


@query
def independent_windows(spark, d):
    out = cal.independent_windows(panel(spark, d), horizon=3, needed=4)
    return out.select("model", "independent", "sessions", F.col("readable").cast("int").alias("readable"))


@query
def decile_table(spark, d):
    return tidy(cal.decile_table(panel(spark, d)), ["model", "decile", "n"], mean_upside=4, mean_fwd=4, median_fwd=4, mean_beta=3)


@query
def ic_by_band(spark, d):
    return tidy(cal.ic_by_band(panel(spark, d)), ["model", "field", "band", "n"], ic=3, mean_fwd=4)


@query
def calibration_verdict(spark, d):
    windows = cal.independent_windows(panel(spark, d), horizon=3, needed=4)
    return cal.verdict(cal.ic_series(per_session(spark, d)), cal.decile_table(panel(spark, d)), windows, needed=4).select("model", "verdict")


@query
def decile_spread(spark, d):
    return tidy(cal.decile_spread(cal.decile_table(panel(spark, d))), ["model"], top=4, bottom=4, spread=4)


@query
def equal_count_buckets(spark, d):
    out = x.equal_count_buckets(panel(spark, d), "score", 7, ["model", "session"])
    return tidy(out, ["model", "session", "ticker", "bucket"])


@query
def beta_bands(spark, d):
    return tidy(x.beta_neutral(panel(spark, d), ["model", "session"]), ["model", "session", "ticker"], fwd=6)


@query
def sector_neutral(spark, d):
    return tidy(x.sector_neutral(panel(spark, d), ["model", "session"]), ["model", "session", "ticker"], fwd=6)


@query
def tolerant_ranks(spark, d):
    """Half of the values carry rounding noise in the last digits, which must not break the ties."""
    noisy = with_exprs(panel(spark, d), v="conf / 3D * (1 + if(cast(ticker AS bigint) % 2 = 0, 1e-15D, 0D)) + floor(upside * 2)")
    return tidy(x.tolerant_ranks(noisy, "v", ["model", "session"]), ["model", "session", "ticker"], avg_rank=1)
