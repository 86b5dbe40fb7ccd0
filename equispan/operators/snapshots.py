"""Append-only snapshots and the change digest."""
from pyspark.sql import DataFrame, functions as F

from ..functions import ranks
from ..functions.exprs import with_exprs
from ..functions.staging import stage
from .metrics import INFO_FLAGS

RUN = ["universe", "model"]


def weekly_gate(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` that may be written: not when their universe and model already have a
    newest run on another day of the same ISO week."""
    last = old.groupBy(*RUN).agg(F.max("run_date").alias("last"))
    week = "extract(YEAROFWEEK FROM {0}) = extract(YEAROFWEEK FROM {1}) AND weekofyear({0}) = weekofyear({1})"
    blocked = f"last IS NOT NULL AND to_date(last) <> to_date(run_date) AND {week.format('last', 'run_date')}"
    return new.join(last, RUN, "left").where(f"NOT coalesce({blocked}, false)").drop("last")


def append_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """K3: old rows plus the admitted new ones; a second run on a day replaces the first."""
    ok = weekly_gate(old, new)
    days = ok.select(*RUN, F.to_date("run_date").alias("_day")).distinct()
    kept = old.withColumn("_day", F.to_date("run_date")).join(days, [*RUN, "_day"], "left_anti").drop("_day")
    return kept.unionByName(ok)


def write_snapshots(path: str, new: DataFrame) -> None:
    """K3 into a table partitioned by universe, model and _day: the admitted rows replace their own days and nothing else
    is written."""
    spark = new.sparkSession
    last = spark.read.parquet(path).select(*RUN, "run_date")
    ok = stage(weekly_gate(last, new).withColumn("_day", F.to_date("run_date")))
    ok.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN, "_day").parquet(path)


def baseline_run(cur: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per universe and model, the newest run of another day that covers at least 80% of the current one."""
    size = cur.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), F.max("run_date").alias("run_now"))
    runs = snapshots.groupBy(*RUN, "run_date").agg(F.count(F.lit(1)).alias("m"))
    ok = runs.join(size, RUN).where("to_date(run_date) <> to_date(run_now) AND m >= 0.8D * n AND run_date < run_now")
    return ok.groupBy(*RUN).agg(F.max("run_date").alias("since"))


def change_digest(cur: DataFrame, snapshots: DataFrame, per_list=12) -> DataFrame:
    """What changed since the baseline run, at most `per_list` entries of each kind."""
    since = baseline_run(cur, snapshots)
    old = snapshots.join(since, RUN).where("run_date = since")
    info = ", ".join(f"'{f}'" for f in INFO_FLAGS)
    pick = ["upside", "conf", "quality", "score", "flags"]
    a = cur.join(since.select(*RUN), RUN).select(*RUN, "ticker", *[F.col(c).alias(f"n_{c}") for c in pick], F.lit(True).alias("is_now"))
    b = old.select(*RUN, "ticker", *[F.col(c).alias(f"o_{c}") for c in pick], F.lit(True).alias("was"))
    j = a.join(b, [*RUN, "ticker"], "full")
    j = with_exprs(j, both="is_now AND was", now_zone="n_upside > 0.15 AND n_quality >= 70", was_zone="o_upside > 0.15 AND o_quality >= 70",
                   gained=f"array_sort(array_except(array_except(n_flags, o_flags), array({info})))",
                   lost=f"array_sort(array_except(array_except(o_flags, n_flags), array({info})))",
                   move="abs(round(n_upside, 3) - round(o_upside, 3))")
    items = [("entered_zone", "both AND now_zone AND NOT was_zone", "''", "n_score"), ("left_zone", "both AND was_zone AND NOT now_zone", "''", "n_score"),
             ("flagged", "both AND size(gained) > 0", "array_join(gained, '|')", "n_score"),
             ("cleared", "both AND size(lost) > 0", "array_join(lost, '|')", "n_score"),
             ("conf_jump", "both AND abs(n_conf - o_conf) >= 2", "concat(o_conf, '>', n_conf)", "n_score"),
             ("big_move", "both AND abs(n_upside - o_upside) >= 0.15", "''", "move"), ("new", "is_now AND was IS NULL", "''", "n_score"),
             ("dropped", "was AND is_now IS NULL", "''", "0D")]
    arr = ", ".join(f"CASE WHEN {t} THEN named_struct('kind', '{k}', 'detail', {d}, 'weight', cast({w} AS double)) END" for k, t, d, w in items)
    rows = j.select(*RUN, "ticker", F.explode(F.expr(f"array_compact(array({arr}))")).alias("c")).select(*RUN, "ticker", "c.*")
    rows = ranks.with_position(stage(rows), "weight", [*RUN, "kind"], "ticker", out="place", desc=True).where(f"place <= {per_list}")
    return rows.select(*RUN, "kind", "place", "ticker", "detail")
