"""Index membership through time."""
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.asof import asof_join

ALIASES = {"FB": "META", "FISV": "FI", "DISCA": "WBD", "RTN": "RTX", "CTRP": "TCOM"}  # fixed values
DUPLICATE_CLASSES = ["GOOG", "FOX", "NWS"]  # fixed values


def _kinds(changes: DataFrame) -> DataFrame:
    """(date, row_no, added, removed) to (ticker, date, step, kind): step orders the undoing within a
    date, rows as listed and a row's addition before its removal."""
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    rows = changes.select("date", "row_no", F.explode(F.expr(
        "array(named_struct('ticker', added, 'kind', 'add'), named_struct('ticker', removed, 'kind', 'remove'))")).alias("c"))
    t = F.trim(F.replace("c.ticker", F.lit("."), F.lit("-")))
    rows = rows.where("c.ticker IS NOT NULL").select(
        F.coalesce(F.try_element_at(alias, t), t).alias("ticker"), "date",
        F.struct("row_no", (F.col("c.kind") == "remove").alias("late")).alias("step"), "c.kind")
    return rows.where(~F.col("ticker").isin(DUPLICATE_CLASSES))


def _listed(tickers: DataFrame) -> DataFrame:
    """Distinct tickers under their present names, without second share classes."""
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    t = F.trim(F.replace("ticker", F.lit("."), F.lit("-")))
    return tickers.select(F.coalesce(F.try_element_at(alias, t), t).alias("ticker")).where(~F.col("ticker").isin(DUPLICATE_CLASSES)).distinct()


def _calendar(dates):
    return "array(" + ", ".join(f"DATE'{x}'" for x in sorted(dates)) + ")"


def membership_asof(current: DataFrame, changes: DataFrame, dates: list) -> DataFrame:
    """B2: members at each date.  The earliest change after a date decides: undoing an addition leaves
    the name out, undoing a removal puts it back; without a later change today's membership stands."""
    cal = _calendar(dates)
    per_day = _kinds(changes).groupBy("ticker", "date").agg(F.max_by("kind", "step").alias("kind"))
    # the newest listed date before a change is the first one, walking back, that it decides
    slot = per_day.withColumn("qdate", F.expr(f"array_max(filter({cal}, q -> q < date))")).where("qdate IS NOT NULL")
    slot = slot.groupBy("ticker", "qdate").agg(F.min_by("kind", "date").alias("kind"))
    cur = _listed(current).withColumn("in_now", F.lit(True))
    names = slot.select("ticker").distinct().join(cur, "ticker", "full")
    spine = names.select("ticker", "in_now", F.explode(F.expr(cal)).alias("qdate")).join(slot, ["ticker", "qdate"], "left")
    ahead = Window.partitionBy("ticker").orderBy("qdate").rowsBetween(0, Window.unboundedFollowing)
    decided = F.first("kind", ignorenulls=True).over(ahead)
    return (spine.withColumn("decided", decided).where("if(decided IS NULL, in_now, decided = 'remove')")
            .select("qdate", "ticker"))


def walkback_anomalies(current: DataFrame, changes: DataFrame, today=None) -> DataFrame:
    """Undone additions of names not in the set and restored names already in it.
    The state before an event comes from the event undone just before: the day's own, or the last
    one of the next later day, so no ticker's whole log meets in one window.  Changes dated after `today` have not
    happened yet and are left out."""
    ev = _kinds(changes if today is None else changes.where(F.col("date") <= F.lit(today).cast("date")))
    day = ev.groupBy("ticker", "date").agg(F.max_by("kind", "step").alias("end_kind"))
    day = day.withColumn("later", F.lag("end_kind").over(Window.partitionBy("ticker").orderBy(F.desc("date")))).drop("end_kind")
    cur = _listed(current).withColumn("in_now", F.lit(True))
    ev = ev.withColumn("prior", F.lag("kind").over(Window.partitionBy("ticker", "date").orderBy("step")))
    ev = ev.join(day, ["ticker", "date"]).join(cur, "ticker", "left")
    before = "CASE coalesce(prior, later) WHEN 'remove' THEN true WHEN 'add' THEN false ELSE coalesce(in_now, false) END"
    ev = ev.withColumn("was_in", F.expr(before))
    return ev.where("(kind = 'add') <> was_in").select("ticker", "date", F.col("step.row_no").alias("row_no"), "kind")


def members_asof(membership: DataFrame, months: DataFrame) -> DataFrame:
    """The newest snapshot dated in or before each month.  Snapshot dates are a short calendar."""
    snaps = membership.select("qdate").distinct().withColumn("qm", F.trunc("qdate", "month"))
    cal = asof_join(months.select("month").distinct(), snaps, "month", "qm", {"qdate": "qdate"}).where("qdate IS NOT NULL")
    return membership.join(F.broadcast(cal), "qdate").select("month", "ticker")
