"""Exact ranks over groups too large for one task.

A plain window over a whole universe sorts it in one task.  Here every step works on slices:

1. rows are counted per distinct value (combined map-side), which folds ties;
2. each value goes to a slice by a fixed monotone function of the value, so slices are in
   value order whatever the data; a crowded slice is split between its own bounds, and its
   crowded pieces again between theirs, until none is left;
3. slice totals are few, so their running sum is one short window per group;
4. a window inside each slice finishes the count.

All of it depends only on the values, so a lost executor recomputes the same answer.
Group columns must not be null.
"""
from pyspark.sql import DataFrame, Window, functions as F

from .staging import stage

SLICE_TARGET = 100_000


def _slice_of(v):
    """Eight slices for each power of two, on both sides of zero: within one, values are of the same size."""
    return F.when(v == 0, 0).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v)) * 8) + 9000)).cast("long")


def _split(x, lo, hi, n):
    """Which of n equal parts of [lo, hi] x falls in."""
    part = F.floor(F.try_divide(x - lo, hi - lo) * n).cast("long")
    return F.coalesce(F.least(part, n - 1), F.lit(0))


def with_groups(df, groups, by, how="inner"):
    """df with the columns of groups, a table of one row a group of the cross-section (universe, sector, quarter).

    A shuffle by such a group would bring all of its rows to one task, and adaptive execution keeps that shuffle where the
    small side fills few partitions; so the rows stay where they are and the table goes to them."""
    return df.join(F.broadcast(groups), list(by), how)


def _before(order):
    return order.rowsBetween(Window.unboundedPreceding, -1)


def _crowds(df, target):
    """Whether a frame may hold more rows than fit one slice, by the optimizer's estimate of its size and its width per row.

    Files are compressed, so the estimate is taken fourfold.  Only then is it worth a job to look at the slices; the answers
    are the same either way."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 4 * size > target * (8 + df._jdf.schema().defaultSize())


def _pieces(cells, slices, value, key):
    """Cells with a new _s: the least value of their piece of the slice (_d values between _lo and _hi)."""
    cells = cells.join(slices.select(*key, "_lo", "_hi", "_parts"), key).withColumn(
        "_p", _split(F.col(value), F.col("_lo"), F.col("_hi"), F.col("_parts")))
    least = cells.groupBy(*key, "_p").agg(F.min(value).alias("_to"))
    return cells.join(least, [*key, "_p"]).withColumn("_s", F.col("_to")).drop("_lo", "_hi", "_parts", "_p", "_to")


def _refined(cells, value, by, target):
    """Cells whose slices (_b, _s) hold at most target values each, and those slices.

    Splitting takes the least and the greatest value of a slice apart, so each round makes progress on any data; it goes on
    only with the crowded slices' cells."""
    key = [*by, "_b", "_s"]
    cells = stage(cells.withColumn("_s", F.lit(0.0)))
    done_cells = done = None
    while True:
        slices = stage(cells.groupBy(*key).agg(
            F.count(F.lit(1)).alias("_d"), F.sum("n_eq").alias("_m"), F.min(value).alias("_lo"), F.max(value).alias("_hi")))
        fine = slices.where(F.col("_d") <= target).select(*key, "_m")
        done = fine if done is None else done.unionByName(fine)
        crowded = slices.where(F.col("_d") > target).withColumn("_parts", F.greatest(F.lit(16), F.ceil(4 * F.col("_d") / target)).cast("long"))
        kept = cells.join(fine.select(*key), key, "left_semi")
        done_cells = kept if done_cells is None else done_cells.unionByName(kept)
        if crowded.isEmpty():
            return done_cells, done
        cells = stage(_pieces(cells, crowded, value, key).select(*by, value, "n_eq", "_b", "_s"))


def value_cells(df: DataFrame, value: str, by: list[str], target=SLICE_TARGET) -> DataFrame:
    """One row per (group, distinct value): n_eq rows here, n_lt rows below, n_all in the group,
    with the slice (_b, _s) the value lies in, of at most about target values."""
    cells = (df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_eq"))
             .withColumn("_b", _slice_of(F.col(value))))
    if _crowds(df.select(*by, value), target):
        cells, slices = _refined(cells, value, by, target)
    else:
        cells = cells.withColumn("_s", F.lit(0.0))
        slices = cells.groupBy(*by, "_b", "_s").agg(F.sum("n_eq").alias("_m"))
    inner = slices.withColumn("_soff", F.coalesce(F.sum("_m").over(_before(Window.partitionBy(*by, "_b").orderBy("_s"))), F.lit(0)))
    outer = slices.groupBy(*by, "_b").agg(F.sum("_m").alias("_m")).select(
        *by, "_b", F.coalesce(F.sum("_m").over(_before(Window.partitionBy(*by).orderBy("_b"))), F.lit(0)).alias("_off"),
        F.sum("_m").over(Window.partitionBy(*by)).alias("n_all"))
    cells = cells.join(inner.select(*by, "_b", "_s", "_soff").join(outer, [*by, "_b"]), [*by, "_b", "_s"])
    local = _before(Window.partitionBy(*by, "_b", "_s").orderBy(value))
    return cells.withColumn("n_lt", F.col("_off") + F.col("_soff") + F.coalesce(F.sum("n_eq").over(local), F.lit(0))) \
        .select(*by, value, "n_eq", "n_lt", "n_all", "_b", "_s")


_PLAIN = ("string", "double", "float", "int", "bigint", "date", "boolean")


def _attach(df, cells, value, by, cols):
    """Rows without a value find no cell; they are dealt by their other columns instead of meeting at one null key."""
    dealt = F.xxhash64(*[c for c, t in df.dtypes if t in _PLAIN])
    df = df.withColumn("_key", F.struct(F.col(value).alias("v"), F.when(F.col(value).isNull(), dealt).otherwise(F.lit(0)).alias("n")))
    key = F.struct(F.col(value).alias("v"), F.lit(0).cast("bigint").alias("n")).alias("_key")
    return df.join(cells.select(*by, key, *cols), [*by, "_key"], "left").select(*[c for c in df.columns if c != "_key"], *cols)


def with_cume_dist(df, value, by, out, target=SLICE_TARGET):
    """Share of the group's non-null values at or below this one; null stays null."""
    cells = value_cells(df, value, by, target).withColumn(out, (F.col("n_lt") + F.col("n_eq")) / F.col("n_all"))
    return _attach(df, cells, value, by, [out])


def _text_order(col, skip):
    """A number that never decreases as the text grows: six bytes, base 256, after the signs all texts begin with."""
    raw = F.rpad(F.substr(col, skip + 1, F.lit(6)), 6, "\0").cast("binary")
    return F.conv(F.hex(F.substring(raw, 1, 6)), 16, 10).cast("double")


def with_position(df, value, by, tie, out="position", total="n_all", desc=False, target=SLICE_TARGET):
    """1-based place of each non-null row ordered by (value, tie), and the group size.
    ``tie`` is a text column, unique within a group; it always runs upwards."""
    rows = df.where(F.col(value).isNotNull())
    if desc:
        rows = rows.withColumn(value, -F.col(value))
    cells = stage(value_cells(rows, value, by, target).select(
        *by, value, "n_lt", F.col("n_all").alias(total), F.ceil(F.col("n_eq") / target).cast("long").alias("_tparts")))
    # A hot value is split by its ties between their own bounds; what all of them begin with tells nothing.  Hot values are few,
    # at most one for each `target` rows, so they go to the rows.
    key = [*by, value]
    hot = cells.where("_tparts > 1").select(*key, "_tparts")
    span = with_groups(rows.select(*key, tie), hot, key).groupBy(*key, "_tparts").agg(F.min(tie).alias("_a"), F.max(tie).alias("_z"))
    same = "size(filter(sequence(0, least(length(_a), length(_z))), i -> left(_a, i) = left(_z, i))) - 1"
    span = span.withColumn("_skip", F.expr(same)).select(
        *key, "_tparts", "_skip", _text_order(F.col("_a"), F.col("_skip")).alias("_tlo"), _text_order(F.col("_z"), F.col("_skip")).alias("_thi"))
    span = stage(span)

    def parted(df):
        df = with_groups(df, span, key, "left")
        part = _split(_text_order(F.col(tie), F.col("_skip")), F.col("_tlo"), F.col("_thi"), F.col("_tparts"))
        return df.withColumn("_ts", F.when(F.col("_tparts") > 1, part).otherwise(F.lit(0))).drop("_tlo", "_thi", "_skip")

    head = parted(rows.select(*key, tie)).where("_tparts > 1").groupBy(*key, "_ts").agg(F.count(F.lit(1)).alias("_tm"))
    head = head.withColumn("_toff", F.sum("_tm").over(_before(Window.partitionBy(*key).orderBy("_ts")))).drop("_tm")
    # One shuffle, by value and part, serves the join and the count inside a part.
    cells = cells.withColumn("_ts", F.explode(F.expr("sequence(0L, _tparts - 1)"))).drop("_tparts")
    rows = with_groups(parted(rows).drop("_tparts").join(cells, [*key, "_ts"]), head, [*key, "_ts"], "left")
    local = Window.partitionBy(*key, "_ts").orderBy(tie)
    rows = rows.withColumn(out, F.col("n_lt") + F.coalesce("_toff", F.lit(0)) + F.row_number().over(local))
    if desc:
        rows = rows.withColumn(value, -F.col(value))
    return rows.drop("n_lt", "_ts", "_toff")


def order_statistics(df, value, by, picks: dict, target=SLICE_TARGET):
    """One row per group with the value at each 0-based index; an index is SQL over n_all."""
    cells = value_cells(df, value, by, target)
    aggs = [F.max(F.when(F.expr(f"n_lt <= ({ix}) AND ({ix}) < n_lt + n_eq"), F.col(value))).alias(name)
            for name, ix in picks.items()]
    return cells.groupBy(*by).agg(F.max("n_all").alias("n_all"), *aggs)


def medians(df, value, by, out="median", target=SLICE_TARGET):
    """Exact median per group: mean of the two middle values."""
    stats = order_statistics(df, value, by, {"_lo": "(n_all - 1) DIV 2", "_hi": "n_all DIV 2"}, target)
    return stats.select(*by, ((F.col("_lo") + F.col("_hi")) / 2).alias(out), "n_all")


def tolerant_cells(df, value, by, rel=1e-9, abs_=1e-15, target=SLICE_TARGET):
    """Average rank per distinct value, where neighbours closer than the tolerance tie."""
    cells = stage(value_cells(df, value, by, target))
    sl = [*by, "_b", "_s"]
    local = Window.partitionBy(*sl).orderBy(value)
    order = Window.partitionBy(*by).orderBy("_b", "_s")
    ends = (cells.groupBy(*sl).agg(F.max(value).alias("_top"))
            .select(*sl, F.lag("_top").over(order).alias("_below")))
    v, prev = F.col(value), F.coalesce(F.lag(value).over(local), F.col("_below"))
    cells = cells.join(ends, sl).withColumn("_prev", prev)
    close = F.abs(v - F.col("_prev")) <= F.greatest(
        F.lit(rel) * F.greatest(F.abs(v), F.abs(F.col("_prev"))), F.lit(abs_))
    cells = cells.withColumn("_start", F.when(F.col("_prev").isNull() | ~close, F.col("n_lt")))
    runs = cells.groupBy(*sl).agg(F.max("_start").alias("_last"), F.min("_start").alias("_first"))
    runs = runs.select(
        *sl, F.max("_last").over(_before(order)).alias("_open"),
        F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    cells = cells.join(runs, sl)
    start = F.coalesce(F.max("_start").over(local.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open"))
    end = F.coalesce(F.min("_start").over(local.rowsBetween(1, Window.unboundedFollowing)),
                     F.col("_next"), F.col("n_all"))
    return cells.withColumn("avg_rank", (start + end + 1) / 2).select(*by, value, "avg_rank", "n_all")


def with_tolerant_rank(df, value, by, out, target=SLICE_TARGET):
    cells = tolerant_cells(df, value, by, target=target).withColumnRenamed("avg_rank", out)
    return _attach(df, cells, value, by, [out])
