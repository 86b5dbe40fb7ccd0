"""The sliced ranks against brute force, with slices so small that every split path runs."""
import random

import pytest

from equispan.functions import ranks

TARGETS = [2, 100_000]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = []
    for i in range(400):
        v = rnd.choice([None, 1.0, 1.0, 1.0, rnd.gauss(0, 1), rnd.gauss(100, 0.01), rnd.gauss(0, 1e6)])
        data.append((rnd.choice("ab"), f"t{i:03d}", v))
    return data, spark.createDataFrame(data, "g string, t string, v double")


@pytest.mark.parametrize("target", TARGETS)
def test_cume_dist(rows, target):
    data, df = rows
    out = {r.t: r.p for r in ranks.with_cume_dist(df, "v", ["g"], "p", target).collect()}
    for g, t, v in data:
        pool = [x for h, _, x in data if h == g and x is not None]
        want = None if v is None else sum(x <= v for x in pool) / len(pool)
        assert out[t] == want


@pytest.mark.parametrize("target", TARGETS)
@pytest.mark.parametrize("desc", [False, True])
def test_position_with_ties(rows, target, desc):
    data, df = rows
    out = {r.t: (r.position, r.n_all) for r in ranks.with_position(df, "v", ["g"], "t", desc=desc, target=target).collect()}
    for g in "ab":
        pool = sorted(((-v if desc else v), t) for h, t, v in data if h == g and v is not None)
        assert [out[t] for _, t in pool] == [(i + 1, len(pool)) for i in range(len(pool))]


@pytest.mark.parametrize("target", TARGETS)
def test_median(rows, target):
    import statistics
    data, df = rows
    out = {r.g: r.median for r in ranks.medians(df, "v", ["g"], target=target).collect()}
    for g in "ab":
        assert out[g] == statistics.median(x for h, _, x in data if h == g and x is not None)


@pytest.mark.parametrize("target", TARGETS)
def test_tolerant_ties(spark, target):
    values = [0.005, 0.005 + 4e-18, 0.005 - 2e-18, -0.005, -0.005 + 1e-18]
    df = spark.createDataFrame([("g", x) for x in values], "g string, v double")
    got = sorted(r.r for r in ranks.with_tolerant_rank(df, "v", ["g"], "r", target).collect())
    assert got == [1.5, 1.5, 4.0, 4.0, 4.0]


def test_average_ranks(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (5, 5, 1, 9)], "g string, v double")
    assert sorted(r.r for r in ranks.with_tolerant_rank(df, "v", ["g"], "r").collect()) == [1.0, 2.5, 2.5, 4.0]


@pytest.mark.parametrize("prefix", ["2024-0{}-{}|n", "00000{}{}"])
def test_ties_that_begin_alike_are_split(spark, prefix):
    keys = [prefix.format(k % 9 + 1, f"{k:03d}") for k in range(300)]
    df = spark.createDataFrame([("a", t, 5.0) for t in keys] + [("a", "z", 4.0)], "g string, t string, v double")
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        out = {r.t: r.position for r in ranks.with_position(df, "v", ["g"], "t", target=10).collect()}
        assert out == {t: k + 2 for k, t in enumerate(sorted(keys))} | {"z": 1}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def tail(kind):
    if kind == "bunched":
        return [1 + k * 1e-12 for k in range(700)]
    if kind == "bunched with far ends":
        return [1 + k * 1e-15 for k in range(0, 3000, 5)] + [1.08, 1.0 + 1e-6, -3e300, 5e-324, -5e-324, 0.0]
    return [s * 1.7 ** k * 10.0 ** -200 for k in range(0, 1300, 2) for s in (1, -1)] + [float(k) for k in range(300)]


@pytest.mark.parametrize("kind", ["bunched", "bunched with far ends", "heavy tail"])
def test_no_slice_is_crowded(spark, kind):
    values = list(dict.fromkeys(tail(kind)))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([("g", v) for v in values for _ in range(1 + (v > 1))], "g string, v double")
    cells = ranks.value_cells(df, "v", ["g"], target=20).collect()
    sizes = {}
    for r in cells:
        sizes[r._b, r._s] = sizes.get((r._b, r._s), 0) + 1
    assert max(sizes.values()) <= 20
    below = 0
    for r in sorted(cells, key=lambda r: r.v):
        assert (r.n_lt, r.n_all) == (below, df.count() if below == 0 else r.n_all)
        below += r.n_eq
    assert len(cells) == len(values)
