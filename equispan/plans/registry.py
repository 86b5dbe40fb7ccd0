"""Named queries: each takes (spark, sf_dir) and returns a DataFrame over the sample tables."""
from pyspark.sql import functions as F

QUERIES = {}
# Money columns named *_m are in units of 999,983: a prime, so that no rounded value is an exact
# half, where two engines may round differently.


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tidy(df, keep, **rounded):
    """Plain output columns: dates as text, doubles rounded to the named places."""
    types = dict(df.dtypes)
    cols = [F.col(c).cast("string").alias(c) if types[c] in ("date", "timestamp", "timestamp_ntz") else F.col(c)
            for c in keep]
    return df.select(*cols, *[F.round(F.col(c).cast("double"), n).alias(c) for c, n in rounded.items()])
