"""As-of joins and name containment against brute force, whatever the partitions and however hot a key."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from equispan.functions.asof import asof_join
from equispan.operators import entities as en, ledger as lg

DAY = datetime.date(1999, 11, 20)


def day(n):
    return DAY + datetime.timedelta(days=n)


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_asof_equals_brute_force(spark, partitions):
    rnd = random.Random(3)
    keys = ["hot"] * 8 + ["a", "b", None]
    left = [(k, rnd.choice(keys), rnd.choice([None, *(day(rnd.randrange(900)) for _ in range(9))])) for k in range(3000)]
    right = [(rnd.choice(["hot", "a", "a", None]), day(rnd.randrange(40, 800)), rnd.randrange(5)) for _ in range(60)]
    df = spark.createDataFrame(left, "id int, ticker string, day date")
    other = spark.createDataFrame(right, "ticker string, since date, v int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.id: (r.s, r.w) for r in asof_join(df, other, "day", "since", {"s": "since", "w": "v * 2"}, ("ticker",)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(left)
    for k, ticker, t in left:
        best = max(((s, 2 * v) for x, s, v in right if x == ticker is not None and t is not None and s <= t), default=(None, None))
        assert got[k] == best


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sessions_without_nested_loops(spark):
    sessions = spark.createDataFrame([(day(n),) for n in range(0, 800, 3)], "session date")
    df = spark.createDataFrame([(n, day(n - 5)) for n in range(900)], "id int, day date")
    out = lg.session_asof(df, sessions)
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
    for r in out.collect():
        pos = min((r.id - 5) // 3, 266)
        assert (r.session, r.pos) == ((day(3 * pos), pos + 1) if r.id >= 5 else (None, None))


@pytest.mark.parametrize("hot", [3, 100_000])
def test_name_containment_equals_brute_force(spark, hot):
    rnd = random.Random(11)
    words = ["AMERICA", "AMERI", "NORTH", "X", "AB", "ABABAB", "ZULU", "OMEGA"]
    known = {f"UNITED {' '.join(rnd.choices(words, k=rnd.randint(0, 3)))}".strip() for _ in range(80)} | {"ABABABABAB", "AB", "Q"}
    bears = [(n, f"{c:03d}") for n in sorted(known) for c in rnd.sample(range(90), rnd.randint(1, 2))]
    keys = {"UNITED", "UNITED AMERICA", "AMERICA", "BABABA", "ABABABA", "AB", "X", "Z", "OMEGA ZULU", "NOWHERE", "D AMER", "Q", "UNITED "} | {
        n[a:a + k] for n in sorted(known)[:40] for a, k in ((0, 9), (3, 7), (5, 4)) if n[a:a + k]}
    filers = spark.createDataFrame(bears, "known string, cik string").groupBy("known").agg(F.min("cik").alias("lo"), F.max("cik").alias("hi"))
    got = {r.key: (r.lo, r.hi) for r in en.containing_names(spark.createDataFrame([(k,) for k in keys], "key string"), filers, hot).collect()}
    want = {}
    for k in keys:
        ciks = [c for n, c in bears if k in n]
        if ciks:
            want[k] = (min(ciks), max(ciks))
    assert got == want
