"""As-of join: each row gets the newest row of another table at or before its time, by equality joins only.

Rows of one time share one answer, so only distinct times are looked up.  They are put among the other table's times,
cut into slices by a fixed monotone function, and read forward inside each slice; what a slice begins with is carried over
from the slices before by a table of one row a slice.  The answers are joined back by equality.  A key with most of the
rows costs a task no more than one slice of its distinct times.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def year_of(t: Column) -> Column:
    return F.year(t)


def asof_join(df: DataFrame, other: DataFrame, time: str, other_time: str, values: dict[str, str], by: tuple[str, ...] = (),
              slice_of=year_of) -> DataFrame:
    """df with columns `values` (name to SQL of other) of the row of `other` that is the newest at or before `time`.

    `by`: columns that must be equal, null for no one.  Several rows of other at one time count as their greatest values.
    Rows without time, key or earlier row get nulls; no row is lost or repeated.
    """
    packed = F.struct(*[F.expr(v).alias(k) for k, v in values.items()])
    marks = other.select(*by, F.col(other_time).alias("_t"), packed.alias("_v"))
    spots = df.select(*by, F.col(time).alias("_t"), F.lit(None).cast(marks.schema["_v"].dataType).alias("_v"))
    line = marks.unionByName(spots).where("_t IS NOT NULL").groupBy(*by, "_t").agg(F.max("_v").alias("_v")).withColumn("_slice", slice_of(F.col("_t")))
    part = [*by, "_slice"]
    # Running first and joining later would sort twice: a slice's last value is read off its own rows.
    ends = line.groupBy(*part).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*part, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    forward = Window.partitionBy(*part).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    read = line.select(*part, "_t", F.last("_v", ignorenulls=True).over(forward).alias("_v")).join(ends, part)
    found = read.select(*by, F.col("_t").alias(time), F.coalesce("_v", "_carried").alias("_v"))
    return df.join(found, [*by, time], "left").select(*[df[c] for c in df.columns], *[F.col("_v")[k].alias(k) for k in values])
