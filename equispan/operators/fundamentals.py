"""Filing facts to annual, trailing-twelve-month and point-in-time series.

Facts are long rows: cik, ns, tag, unit, start, end, val, filed, form, fp, pos.
"""
from pyspark.sql import DataFrame, Window, functions as F

from ..assumptions import INSTANT_CONCEPTS, WEIGHTED_SHARES_TAG

ANNUAL = "(form LIKE '10-K%' OR form LIKE '20-F%' OR form LIKE '40-F%')"
INTERIM = "(form LIKE '10-Q%' OR form LIKE '10-K%')"
FULL_YEAR = "datediff(end, start) BETWEEN 350 AND 380"


def map_tags(facts: DataFrame, tagmap: DataFrame) -> DataFrame:
    """facts to concepts.  The tag map is configuration: about a hundred fixed rows."""
    return facts.join(F.broadcast(tagmap), ["ns", "tag"])


def reporting_currency(mapped: DataFrame) -> DataFrame:
    """one currency per (cik, ns): USD with five annual revenue points, else the unit with most."""
    points = (mapped.where("concept = 'revenue' AND unit NOT IN ('shares', 'pure') AND NOT contains(unit, '/')")
              .groupBy("cik", "ns", "unit")
              .agg(F.expr(f"count_if({ANNUAL} AND fp = 'FY')").alias("n")))
    return points.groupBy("cik", "ns").agg(F.expr(
        "if(max(if(unit = 'USD', n, 0)) >= 5, 'USD', min_by(unit, struct(-n, unit)))").alias("ccy"))


def select_unit(mapped: DataFrame, ccy: DataFrame) -> DataFrame:
    """the chosen currency if the tag has it, else `shares`, else everything when no currency is known."""
    rows = mapped.join(ccy, ["cik", "ns"], "left")
    have = rows.groupBy("cik", "ns", "tag").agg(
        F.expr("bool_or(unit = ccy)").alias("has_ccy"), F.expr("bool_or(unit = 'shares')").alias("has_shares"))
    return (rows.join(have, ["cik", "ns", "tag"])
            .where("CASE WHEN has_ccy THEN unit = ccy WHEN has_shares THEN unit = 'shares' ELSE ccy IS NULL END")
            .drop("has_ccy", "has_shares"))


def annual_series(picked: DataFrame, guard_span=True) -> DataFrame:
    """newest filing per (concept, fiscal year); ties go to the first tag, then the first position."""
    rows = picked.where(f"{ANNUAL} AND fp = 'FY' AND end IS NOT NULL AND val IS NOT NULL")
    if guard_span:
        rows = rows.where(f"start IS NULL OR {FULL_YEAR}")
    return (rows.groupBy("cik", "ns", "concept", F.year("end").alias("fiscal_year"))
            .agg(F.expr("max_by(val, struct(filed, -tag_rank, -pos))").alias("value")))


def pick_namespace(series: DataFrame, require=("revenue", "net_income")) -> DataFrame:
    """the first namespace that has a required concept speaks for the filer."""
    win = (series.where(F.col("concept").isin(*require)).groupBy("cik")
           .agg(F.expr("if(bool_or(ns = 'us-gaap'), 'us-gaap', 'ifrs-full')").alias("ns")))
    return series.join(win, ["cik", "ns"])


def duration_points(picked: DataFrame) -> DataFrame:
    """interim and annual spans, newest filing per (start, end)."""
    return (picked.where(f"{INTERIM} AND start IS NOT NULL AND end IS NOT NULL AND val IS NOT NULL")
            .groupBy("cik", "ns", "concept", "start", "end")
            .agg(F.expr("max_by(val, struct(filed, -tag_rank, -pos))").alias("value")))


# One step of the walk back from the newest period end to the fiscal-year boundary.
_CANDS = "filter(pts, p -> p.s >= fy_end AND p.e > fy_end AND p.d < 350 AND abs(datediff(p.e, a.at)) <= 5)"
_PICK = f"array_min(transform({_CANDS}, p -> named_struct('o', -p.d, 's', p.s, 'e', p.e, 'v', p.v)))"
_MIRROR = ("array_min(filter(pts, p -> abs(datediff(p.s, w.s) + 365) <= 10 "
           "AND abs(datediff(p.e, w.e) + 365) <= 10))")
_STEP = f"""
CASE WHEN a.done OR a.failed THEN a ELSE transform(array({_PICK}), c ->
  CASE WHEN c IS NULL THEN named_struct('at', a.at, 'links', a.links, 'done', false, 'failed', true)
  ELSE named_struct('at', c.s,
    'links', concat(a.links, array(named_struct('s', c.s, 'e', c.e, 'v', c.v))),
    'done', abs(datediff(c.s, fy_end)) <= 10, 'failed', false) END)[0] END"""
_START = ("named_struct('at', latest_end, 'links', cast(array() AS array<struct<s:date,e:date,v:double>>), "
          "'done', false, 'failed', false)")


def ttm(points: DataFrame) -> DataFrame:
    """last full year + periods since - the same periods a year earlier; any gap gives the full year.

    Only spans that end within 800 days before the fiscal-year end or later can take part, so the
    array per (cik, concept) holds a few distinct calendar spans however many filings repeat them.
    """
    keys = ["cik", "ns", "concept"]
    fy = (points.where(FULL_YEAR).groupBy(*keys)
          .agg(F.expr("max_by(struct(end, value), struct(end, -datediff(start, DATE'1900-01-01')))").alias("fy")))
    near = points.join(fy, keys).where("end >= date_sub(fy.end, 800)")
    rows = near.groupBy(*keys).agg(
        F.any_value("fy").alias("fy"),
        F.expr("array_sort(collect_list(named_struct('s', start, 'e', end, 'v', value, "
               "'d', datediff(end, start))))").alias("pts"))
    rows = rows.select(*keys, "pts", F.col("fy.end").alias("fy_end"), F.col("fy.value").alias("fy_value"))
    rows = rows.withColumn("latest_end", F.expr(
        "array_max(transform(filter(pts, p -> p.s >= fy_end AND p.e > fy_end AND p.d < 350), p -> p.e))"))
    rows = rows.withColumn("walk", F.expr(f"aggregate(sequence(1, 8), {_START}, (a, i) -> {_STEP})"))
    rows = rows.withColumn("mirror", F.expr(f"transform(walk.links, w -> {_MIRROR}.v)"))
    rows = rows.withColumn("ok", F.expr("walk.done AND NOT exists(mirror, m -> m IS NULL)"))
    add = ("aggregate(zip_with(walk.links, mirror, (w, m) -> w.v - m), 0D, (a, v) -> a + v)")
    return rows.select(
        *keys, F.expr(f"if(ok, fy_value + {add}, fy_value)").alias("value"),
        F.expr("if(ok, array_max(transform(walk.links, w -> w.e)), fy_end)").alias("thru"),
        F.expr("if(ok, 'ttm', 'fy')").alias("basis"))


def freshest_instant(picked: DataFrame) -> DataFrame:
    """F8: newest balance-sheet point per concept; ties keep the first tag and position."""
    return (picked.where(f"({INTERIM} OR {ANNUAL}) AND end IS NOT NULL AND val IS NOT NULL")
            .groupBy("cik", "ns", "concept")
            .agg(F.expr("max_by(struct(val, end), struct(end, filed, -tag_rank, -pos))").alias("p"))
            .select("cik", "ns", "concept", F.col("p.val").alias("value"), F.col("p.end").alias("thru")))


def financials_now(picked: DataFrame) -> DataFrame:
    """freshest instants for balance concepts, TTM for flows; `shares` is left to current_shares."""
    instant = F.col("concept").isin(INSTANT_CONCEPTS)
    rows = picked.where("concept <> 'shares'")
    inst = freshest_instant(rows.where(instant)).withColumn("basis", F.lit("instant"))
    return inst.unionByName(ttm(duration_points(rows.where(~instant))))


def to_usd(series: DataFrame, ccy: DataFrame, fx: DataFrame, keys=("cik", "ns")) -> DataFrame:
    """money to USD; an unknown rate empties the money series, share counts stay as filed."""
    out = series.join(ccy, list(keys), "left").join(F.broadcast(fx), "ccy", "left")
    rate = "CASE WHEN ccy IS NULL OR ccy = 'USD' OR concept = 'shares' THEN 1D ELSE rate END"
    return out.withColumn("value", F.expr(f"value * {rate}")).where("value IS NOT NULL").drop("rate")


# fixed values: share-count tags and the source each stands for
SHARE_TAGS = {"EntityCommonStockSharesOutstanding": "dei", "CommonStockSharesOutstanding": "pit",
              "CommonStockSharesIssued": "pit", WEIGHTED_SHARES_TAG: "wab"}


def current_shares(facts: DataFrame) -> DataFrame:
    """freshest share count that is not zero; a count under 0.6 of the weighted average gives way to it."""
    src = F.create_map(*[F.lit(x) for kv in SHARE_TAGS.items() for x in kv])
    newest = (facts.where(F.col("tag").isin(*SHARE_TAGS)).where(
        "(ns = 'dei') = (tag = 'EntityCommonStockSharesOutstanding') AND end IS NOT NULL AND val <> 0")
        .groupBy("cik", "tag").agg(F.expr("max_by(struct(end, val), struct(end, filed, -pos))").alias("p"))
        .select("cik", src[F.col("tag")].alias("src"), "p.end", "p.val"))
    best = newest.groupBy("cik").agg(
        F.expr("max_by(struct(val, src), struct(end, val, src))").alias("w"),
        F.expr("max(if(src = 'wab', val, NULL))").alias("wab"))
    return best.select("cik", F.expr(
        "if(wab <> 0 AND w.src <> 'wab' AND w.val < 0.6D * wab, wab, w.val)").alias("shares_out"))


def filer_form(facts: DataFrame) -> DataFrame:
    """any 10-K makes a domestic filer, else 20-F/40-F a foreign one."""
    return facts.groupBy("cik").agg(F.expr(
        "CASE WHEN bool_or(form LIKE '10-K%') THEN '10-K' "
        "WHEN bool_or(form LIKE '20-F%' OR form LIKE '40-F%') THEN '20-F' END").alias("form"))


def pit_vintages(picked: DataFrame, guard_span=False) -> DataFrame:
    """every annual vintage (fiscal year, filed); the first tag wins a collision."""
    rows = picked.where(f"{ANNUAL} AND fp = 'FY' AND end IS NOT NULL AND filed IS NOT NULL AND val IS NOT NULL")
    if guard_span:
        rows = rows.where(f"start IS NULL OR {FULL_YEAR}")
    return (rows.groupBy("cik", "ns", "concept", F.year("end").alias("fy"), "filed")
            .agg(F.expr("min_by(struct(end, val), struct(tag_rank, pos))").alias("p"))
            .select("cik", "ns", "concept", "fy", "filed", F.col("p.end").alias("end_date"),
                    F.col("p.val").alias("value")))


def _calendar(dates: DataFrame) -> DataFrame:
    """The distinct dates with their number from 1, the one before, and how many there are; a few hundred rows."""
    order = Window.orderBy("qdate")
    return dates.select("qdate").distinct().select(
        "qdate", F.row_number().over(order).alias("pos"), F.lag("qdate").over(order).alias("prev"),
        F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_dates"))


def _visible_from(pit: DataFrame, dates: DataFrame, extra) -> DataFrame:
    """Rows stamped with the first date they are visible on.  Each day up to the last date has exactly one, so this is
    an equality join with a table of days, which is as long as the calendar's span; filings start in 1900."""
    days = _calendar(dates).select("qdate", "pos", "n_dates", F.explode(F.expr(
        "sequence(coalesce(date_add(prev, 1), least(qdate, DATE'1900-01-01')), qdate)")).alias("filed"))
    return pit.join(F.broadcast(days), "filed").select("qdate", "pos", "n_dates", *extra)


def _asked(members: DataFrame, dates: DataFrame) -> DataFrame:
    """The numbers of the dates that each ticker is asked for, as one array no longer than the calendar."""
    cal = F.broadcast(_calendar(dates).select("qdate", "pos"))
    return members.join(cal, "qdate").groupBy("ticker").agg(F.collect_set("pos").alias("_asked"))


def _spread(cover: DataFrame, keys, dates: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Rows (keys, pos, n_dates, ...) repeated for each date up to the next row of the same keys, as d; with `asked`
    only for the dates that the row's ticker is asked for."""
    until = F.coalesce(F.lead("pos").over(Window.partitionBy(*keys).orderBy("pos")), F.col("n_dates") + 1)
    rows = cover.withColumn("_until", until)
    if asked is None:
        spots = F.expr("sequence(cast(pos AS int), cast(_until - 1 AS int))")
    else:
        rows, spots = rows.join(asked, "ticker"), F.expr("filter(_asked, p -> p >= pos AND p < _until)")
    rows = rows.withColumn("pos", F.explode(spots)).drop("_until", "_asked")
    cal = _calendar(dates).select("pos", F.col("qdate").alias("d"))
    return rows.join(F.broadcast(cal), "pos")


def series_asof(pit: DataFrame, dates: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """per date, the newest value filed on or before it for each fiscal year.

    Vintages fold to one per (series, first visible date) before any history is spread over
    the calendar, and each then covers the dates up to its successor.  With members (qdate, ticker) only
    their rows are read: other tickers' filings go before the first shuffle, other dates are never made.  That shuffle is
    by ticker and serves every step, so what is spread stays where its ticker is.
    """
    keys = ["ticker", "concept", "fy"]
    asked = None if members is None else _asked(members, dates)
    pit = pit if asked is None else pit.join(asked.select("ticker"), "ticker", "left_semi").repartition("ticker")
    first = (_visible_from(pit, dates, [*keys, "filed", "value"]).groupBy("pos", "n_dates", *keys)
             .agg(F.max_by("value", "filed").alias("value")))
    return _spread(first, keys, dates, asked).select(F.col("d").alias("qdate"), *keys, "value")


def shares_asof(pit: DataFrame, splits: DataFrame, dates: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """share count of the latest period end filed by the date, on today's split basis; of members only, if given."""
    rows = pit.where("concept = 'shares_wab'")
    asked = None if members is None else _asked(members, dates)
    rows = rows if asked is None else rows.join(asked.select("ticker"), "ticker", "left_semi").repartition("ticker")
    first = (_visible_from(rows, dates, ["ticker", "end_date", "filed", "value"]).groupBy("pos", "n_dates", "ticker")
             .agg(F.expr("max_by(struct(end_date, value), struct(end_date, -datediff(filed, DATE'1900-01-01')))")
                  .alias("p")))
    run = Window.partitionBy("ticker").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct("p.end_date", (-F.col("pos")).alias("o"), "p.value"))
    held = _spread(first.withColumn("p", best.over(run)), ["ticker"], dates, asked).select(
        F.col("d").alias("qdate"), "ticker", "p.end_date", "p.value")
    ends = held.select("ticker", "end_date").distinct()
    mult = (ends.join(splits, "ticker").where("sdate > end_date").groupBy("ticker", "end_date")
            .agg(F.product("factor").alias("mult")))
    return held.join(mult, ["ticker", "end_date"], "left").select(
        "qdate", "ticker", "end_date", F.expr("value * coalesce(mult, 1D)").alias("shares"))
