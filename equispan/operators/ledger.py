"""Forward paper-trading ledger."""
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import ranks
from ..functions.asof import asof_join
from ..functions.exprs import with_exprs
from ..functions.staging import stage

RUN = ["universe", "model"]


def session_calendar(sessions: DataFrame) -> DataFrame:
    """Sessions with their place and successor; one row per trading day."""
    w = Window.orderBy("session")
    return sessions.select("session").distinct().select("session", F.row_number().over(w).alias("pos"), F.lead("session").over(w).alias("until"))


def session_asof(df: DataFrame, sessions: DataFrame, day="day") -> DataFrame:
    """The newest session on or before each day; null before the first."""
    return asof_join(df, session_calendar(sessions), day, "session", {"session": "session", "pos": "pos"})


def collapse_runs(snapshots: DataFrame, sessions: DataFrame) -> DataFrame:
    """One run per trading session: the last run of a day, then the earliest day of a session.
    Works on the list of runs, not on their rows."""
    runs = snapshots.select(*RUN, "run_date").distinct().withColumn("day", F.to_date("run_date"))
    days = runs.groupBy(*RUN, "day").agg(F.max("run_date").alias("run_date"))
    days = session_asof(days, sessions).withColumn("session", F.coalesce("session", "day")).drop("pos")
    return days.groupBy(*RUN, "session").agg(
        F.min("day").alias("day"), F.min_by("run_date", "day").alias("run_date"), (F.count(F.lit(1)) - 1).alias("collapsed"))


def ledger_rows(snapshots: DataFrame, prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each kept run's rows with their place by score and the return from its session to the newest close."""
    runs = collapse_runs(snapshots, sessions)
    top = prices.agg(F.max("date").alias("mark_day"))
    px = prices.where("adjclose <> 0").select("ticker", "date", "adjclose")
    mark = px.join(F.broadcast(top), F.col("date") == F.col("mark_day")).select("ticker", F.col("adjclose").alias("exit_px"))
    rows = snapshots.join(runs, [*RUN, "run_date"]).select(*RUN, "session", "run_date", "ticker", "score")
    rows = ranks.with_position(stage(rows), "score", [*RUN, "session"], "ticker", out="place", total="n", desc=True)
    entry = px.select("ticker", F.col("date").alias("session"), F.col("adjclose").alias("entry_px"))
    rows = rows.join(entry, ["ticker", "session"], "left").join(mark, "ticker", "left")
    return with_exprs(rows, held="place <= greatest(10, n DIV 5)", ret="exit_px / entry_px - 1")


def ledger(snapshots: DataFrame, prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per basket: what it held, what it returned, against everyone priced."""
    b = ledger_rows(snapshots, prices, sessions).groupBy(*RUN, "session").agg(
        F.max("run_date").alias("run_date"), F.expr("count_if(held)").alias("k"), F.expr("count_if(held AND ret IS NOT NULL)").alias("covered"),
        F.expr("round(avg(if(held, ret, NULL)), 4)").alias("basket_ret"), F.expr("round(avg(ret), 4)").alias("bench_ret"),
        F.expr("round(avg(if(held, ret, NULL)) - avg(ret), 4)").alias("excess"))
    top = prices.agg(F.max("date").alias("mark_day"))
    cal = session_calendar(sessions)
    last = session_asof(top.withColumn("day", F.col("mark_day")), sessions).select("mark_day", F.col("pos").alias("mark_pos"))
    b = b.join(F.broadcast(cal.select("session", "pos")), "session", "left").join(F.broadcast(last))
    return with_exprs(b, missing="k - covered", age_days="datediff(mark_day, session)", trading_days="mark_pos - pos").drop("pos", "mark_pos", "mark_day")


def ledger_summary(baskets: DataFrame, rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Per model, how the aged baskets did and how much they differ from each other.
    Overlaps count the names that two baskets share; equal baskets share everything."""
    aged = baskets.where("age_days > 0 AND excess IS NOT NULL")
    s = aged.groupBy(*RUN).agg(F.count(F.lit(1)).alias("aged"), F.expr("round(count_if(excess > 0) / count(1), 3)").alias("hit_rate"),
                               F.avg("excess").alias("avg_excess"))
    tot = baskets.groupBy(*RUN).agg(F.count(F.lit(1)).alias("baskets"), F.max("age_days").alias("oldest_days"))
    coll = runs.groupBy(*RUN).agg(F.sum("collapsed").alias("collapsed"))
    held = rows.where("held").join(aged.select(*RUN, "session"), [*RUN, "session"]).select(*RUN, "ticker", "session")
    both = (held.withColumnRenamed("session", "a").join(held.withColumnRenamed("session", "b"), [*RUN, "ticker"]).where("a < b")
            .groupBy(*RUN, "a", "b").agg(F.count(F.lit(1)).alias("common")))
    k = aged.select(*RUN, F.col("session").alias("a"), F.col("k").alias("ka"))
    kb = aged.select(*RUN, F.col("session").alias("b"), F.col("k").alias("kb"))
    pairs = k.join(kb, RUN).where("a < b").join(both, [*RUN, "a", "b"], "left").fillna(0, ["common"])
    pairs = with_exprs(pairs, jac="common / (ka + kb - common)", same="common = ka AND common = kb")
    over = pairs.groupBy(*RUN).agg(F.expr("round(avg(jac), 3)").alias("avg_overlap"))
    dup = pairs.where("same").groupBy(*RUN).agg(F.countDistinct("b").alias("repeats"))
    out = tot.join(s, RUN, "left").join(coll, RUN, "left").join(over, RUN, "left").join(dup, RUN, "left")
    return with_exprs(out, aged="coalesce(aged, 0)", distinct_baskets="coalesce(aged, 0) - coalesce(repeats, 0)").drop("repeats")
