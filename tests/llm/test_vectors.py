import numpy as np
import pytest

from equispan.llm.queries import op11_embedding_near_dedup
from equispan.llm.vectors import near_vectors, quantise, tile_links

SCHEMA = "vec_id long, embedding array<float>, label int, m long, n_links string"


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def expected(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) by all pairs; rows: (vec_id, vector)."""
    n = len(rows)
    linked = [[] for _ in rows]
    for d in {len(v) for _, v in rows if usable(v)}:
        at = [k for k, (_, v) in enumerate(rows) if usable(v) and len(v) == d]
        x = np.array([rows[k][1] for k in at], np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                linked[at[a]].append(at[b])
    out, seen = [None] * n, [False] * n
    for k in range(n):
        if seen[k]:
            continue
        group, todo, seen[k] = [], [k], True
        while todo:
            i = todo.pop()
            group.append(i)
            for j in linked[i]:
                if not seen[j]:
                    seen[j] = True
                    todo.append(j)
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            least = min(ids) if ids else None
            out[i] = (rows[i][0], len(linked[i]), least, rows[i][0] == least)
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


def clustered(rng, sizes, d, spread):
    out = []
    for n in sizes:
        c = rng.normal(size=d)
        c /= np.linalg.norm(c)
        out += [(c + rng.normal(size=d) * spread / np.sqrt(d)).astype(np.float32).tolist() for _ in range(n)]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(op11_embedding_near_dedup(spark, d)) == expected(rows)


def test_groups_over_many_tiles(spark):
    rng = np.random.default_rng(5)
    v = clustered(rng, [900, 60, 40, 3, 2] + [1] * 200, 24, 0.22)
    rows = [(int(k), x) for k, x in zip(rng.permutation(len(v)), v, strict=True)]
    want = expected(rows)
    assert 0 < sum(not r[3] for r in want) < len(want)
    assert got(near_vectors(frame(spark, rows), tiles=9)) == want
    assert got(near_vectors(frame(spark, rows), pivots=1, tiles=1)) == want


def test_edges(spark):
    a, b = [1.0, 0.0, 2.0], [1.0, 0.1, 2.0]
    rows = [(1, a), (1, a), (None, a), (4, [x * 3 for x in a]), (5, b), (6, None), (7, []), (8, [0.0, 0.0, 0.0]), (9, [1.0, None, 2.0]),
            (10, [float("nan"), 1.0, 1.0]), (11, [float("inf"), 0.0, 0.0]), (12, [1.0]), (13, [2.0]), (14, [-1.0]),
            (None, [5.0, 5.0]), (None, None), (15, [1e-38, 0.0, 2e-38]), (16, [0.0, -0.0, 1.0]), (17, [0.0, 0.0, 1.0])]
    assert got(near_vectors(frame(spark, rows))) == expected(rows)
    assert got(near_vectors(frame(spark, []))) == []
    assert got(near_vectors(frame(spark, [(6, None)]))) == [(6, 0, 6, True)]


@pytest.mark.parametrize("d", [2, 64, 3000])
def test_bounds_hold_and_tiles_are_exact(d):
    rng = np.random.default_rng(d)
    x = np.array(clustered(rng, [60, 50, 40], d, 0.3), np.float64)
    y = np.array(clustered(rng, [30], d, 0.3), np.float64)
    y[:10] = x[:10] * 2 + rng.normal(size=(10, d)) * 0.3 * np.linalg.norm(x[0]) / np.sqrt(d)
    u, w = (z / np.linalg.norm(z, axis=1)[:, None] for z in (x, y))
    (q, s, e), (p, t, f) = quantise(u), quantise(w)
    near = (q.astype(int) @ p.astype(int).T) * s[:, None] * t
    assert (np.abs(u @ w.T - near) <= e[:, None] + f * (1 + e.max()) + 1e-12).all()
    for threshold in (0.5, 0.9, 0.95):
        pairs = {(int(i), int(j)) for a, b in tile_links(x, y, threshold) for i, j in zip(a, b, strict=True)}
        assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ w.T >= threshold), strict=True)}
        pairs = {(int(i), int(j)) for a, b in tile_links(x, None, threshold) for i, j in zip(a, b, strict=True)}
        assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= threshold), strict=True) if i < j}
