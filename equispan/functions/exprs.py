"""Small SQL-expression builders shared by the operators.

A company's history travels as one ``series`` column: an array of structs ordered by ``fy``
with one field per concept.  A ticker has one entry per fiscal year, so the array is short,
and every per-company metric is a projection over it: no shuffle per metric.
"""
from pyspark.sql import functions as F


def overlap(*fields, arr="series"):
    """The years in which every field is present, oldest first."""
    cond = " AND ".join(f"x.{f} IS NOT NULL" for f in fields)
    return f"filter({arr}, x -> {cond})"


def last_n(arr, n):
    return f"slice({arr}, greatest(size({arr}) - ({n}) + 1, 1), {n})"


def mean_of(arr, value, where="true"):
    """Mean of value(x) over the entries that pass the test; null when there are none."""
    return (f"aggregate(transform(filter({arr}, x -> {where}), x -> {value}), "
            "named_struct('s', 0D, 'n', 0L), "
            "(a, v) -> named_struct('s', a.s + v, 'n', a.n + 1L), a -> try_divide(a.s, a.n))")


def moments(values):
    """Count, mean and squared deviations of an array of doubles in one pass."""
    return (f"aggregate({values}, named_struct('n', 0L, 'm', 0D, 'q', 0D), (a, v) -> "
            "named_struct('n', a.n + 1L, 'm', a.m + (v - a.m) / (a.n + 1), "
            "'q', a.q + (v - a.m) * (v - a.m) * a.n / (a.n + 1)), a -> a)")


def latest(field, arr="series"):
    """Value of the newest year that has the field."""
    return f"get(reverse(filter({arr}, x -> x.{field} IS NOT NULL)), 0).{field}"


def clamp(x, lo, hi):
    """x limited to [lo, hi]; null stays null (greatest/least alone would drop the null)."""
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({lo}, least({hi}, {x})) END"


def e(text):
    return F.expr(text)


def with_exprs(df, **cols):
    """Add columns from SQL text, all seeing the columns of df."""
    return df.withColumns({k: F.expr(v) for k, v in cols.items()})
