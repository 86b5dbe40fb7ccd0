"""Embedding near-duplicates: links between all vectors with a cosine of `threshold` or more, exactly.

Equal vectors fold to one row with a count.  The rest are sorted by their nearest of a few pivots, numbered and cut into
tiles.  Every two tiles meet, unless the ranges of their angles to some pivot are further apart than the threshold's angle
(the angle between vectors is never less than the difference of their angles to a third one).  A meeting quantises both
tiles to int8, multiplies them, and bounds each product's error by the vectors' own quantisation errors e and f:
|x.y - x'.y'| <= e |y| + f |x'|, as x = x' + (rest of norm e), y = y' + (rest of norm f).  Pairs certainly above the
threshold are links, those certainly below are none, and only the others are recomputed in double precision.

All pairs are compared, in blocks, but never emitted: a meeting hands on, for each vector with links, their number and one
edge of a spanning star.  Meetings are of equal size however the vectors are grouped, and memory is bounded by two tiles.
The work grows with the square of the number of distinct vectors where the pivots tell no tiles apart.

Vectors that are null, empty, all zero or hold null or non-finite components link with nothing; vectors of different
lengths neither.  Repeated vec_ids are vectors of their own; a null vec_id never names a component, and its component is
null where no linked vector has an id.  kept compares vec_id and component_id, nulls being equal.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .shared import components, cut, written

THRESHOLD = 0.95
#: Vectors to which angles are taken, the first by hash: a bounded sample that only affects how many tiles are skipped.
PIVOTS = 16
#: Tiles aimed at, rows and bytes (as doubles) of a tile at most.
TILES, TILE_ROWS, TILE_BYTES = 24, 16384, 32 << 20
#: Rows multiplied at once with a whole tile.
STRIP = 512
#: More than what rounding adds to bounds in single precision, to angles, and to products in double precision.
SLACK32, SLACK_ANGLE = 2e-6, 1e-6


def comparable(c: Column) -> Column:
    """Whether a vector has a direction: not null nor empty, all components finite, one of them not zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) for each length of vectors in a list column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, values[starts[rows][:, None] + np.arange(d)]


def _angles(pivots: list[list[float]]):
    by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
    for k, p in enumerate(pivots):
        by_length.setdefault(len(p), []).append((k, _unit(np.array([p], np.float64))[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(pivots)))
            for rows, x in _matrices(batch.column("embedding")):
                known = by_length.get(x.shape[1], ())
                if known:
                    out[np.ix_(rows, [k for k, _ in known])] = np.arccos(np.clip(_unit(x) @ np.stack([p for _, p in known], axis=1), -1, 1))
            near = np.argmin(out, axis=1) if len(pivots) else np.zeros(len(out), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.FixedSizeListArray.from_arrays(out.ravel(), len(pivots)).cast(pa.list_(pa.float64())),
                 pa.array(near.astype(np.int32)), pa.array(out[np.arange(len(out)), near])],
                names=[*batch.schema.names, "_angles", "_pivot", "_angle"])
    return run


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Link rows a and b in place; a label is the smallest row of its group."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(nearer := label[label], label):
            label[:] = nearer


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, scale, and the norm of what quantising lost, of each unit vector."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    lost = x - q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt(np.einsum("ij,ij->i", lost, lost))


def _products(q: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: sums of 1024 of them fit in the whole numbers of single precision."""
    out = q[:, :1024].astype(np.float32) @ other[:, :1024].astype(np.float32).T
    for k in range(1024, q.shape[1], 1024):
        out += q[:, k:k + 1024].astype(np.float32) @ other[:, k:k + 1024].astype(np.float32).T
    return out


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of x, j of y) linked, strip by strip; with y None those of x with each other, i < j."""
    one = _unit(x)
    two = one if y is None else _unit(y)
    q, scale, lost = quantise(one)
    p, width, gone = (q, scale, lost) if y is None else quantise(two)
    # The sum of several products of 1024 each is rounded in single precision.
    slack = SLACK32 * max(1, one.shape[1] // 1024)
    most = 1 + float(lost.max(initial=0))
    for s in range(0, len(one), STRIP):
        e = min(s + STRIP, len(one))
        upper = _products(q[s:e], p) * scale[s:e, None].astype(np.float32) * width.astype(np.float32)
        upper += lost[s:e, None].astype(np.float32)
        upper += (gone * most).astype(np.float32)
        i, j = np.nonzero(upper >= np.float32(threshold - slack))
        if y is None:
            later = i + s < j
            i, j = i[later], j[later]
        if not len(i):
            continue
        sure = upper[i, j] - 2 * (lost[i + s] + gone[j] * most) >= threshold + slack
        link = sure.copy()
        open_ = np.flatnonzero(~sure)
        step = max(1, (8 << 20) // (16 * one.shape[1]))
        for k in range(0, len(open_), step):
            at = open_[k:k + step]
            link[at] = np.einsum("ij,ij->i", one[i[at] + s], two[j[at]]) >= threshold
        if link.any():
            yield i[link] + s, j[link]


def _meet(threshold: float):
    def meeting(side: np.ndarray, at: np.ndarray, copies: np.ndarray, vectors: pa.ListArray) -> pa.RecordBatch | None:
        links, label = np.zeros(len(at)), np.arange(len(at))
        for rows, x in _matrices(vectors):
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            alone = not (side == 1).any()
            if not len(left) or not (alone or len(right)):
                continue
            for i, j in tile_links(x[side[rows] == 0], None if alone else x[side[rows] == 1], threshold):
                i, j = left[i], (left if alone else right)[j]
                links += np.bincount(i, copies[j], len(at)) + np.bincount(j, copies[i], len(at))
                merge(label, i, j)
        some = np.flatnonzero(links)
        if len(some):
            return pa.RecordBatch.from_arrays([pa.array(at[some]), pa.array(at[label[some]]), pa.array(links[some].astype(np.int64))],
                                              names=["node", "root", "n"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def ended() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                cols = [t[c].to_numpy() for c in ("side", "_at", "m")]
                held.clear()
                out = meeting(*cols, t["embedding"].combine_chunks())
                if out is not None:
                    yield out

        for batch in batches:
            key = batch.column("pair").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else []
            for a, b in zip(edges, edges[1:], strict=False):
                if held and key[a] != now:
                    yield from ended()
                now = key[a]
                held.append(batch.slice(a, b - a))
        yield from ended()
    return run


def _meetings(rows: DataFrame, tiles: int, threshold: float) -> DataFrame:
    """(pair, tile, side) of the tiles that have to meet."""
    spans = rows.select("tile", F.posexplode("_angles").alias("p", "a")).groupBy("tile", "p").agg(
        F.min("a").alias("lo"), F.max("a").alias("hi"))
    spans = cut(spans.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("p", "lo", "hi"))).alias("spans")))
    pairs = rows.sparkSession.range(tiles).select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(tiles - 1))).alias("j"))
    far = F.lit(float(np.arccos(threshold)) + SLACK_ANGLE)
    apart = F.exists(F.arrays_zip("s", "t"), lambda z: (z["s"]["lo"] > z["t"]["hi"] + far) | (z["t"]["lo"] > z["s"]["hi"] + far))
    pairs = pairs.join(spans.toDF("i", "s"), "i").join(spans.toDF("j", "t"), "j").where(~F.coalesce(apart, F.lit(False)))
    both = F.array(F.struct(F.col("i").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("j").alias("tile"), F.lit(1).alias("side")))
    met = F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)
    return pairs.select((F.col("i") * tiles + F.col("j")).alias("pair"), F.inline(met))


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                 pivots: int = PIVOTS, tiles: int = TILES) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector."""
    kind = dict(vectors.dtypes)[vector]
    value = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), value.alias("embedding")).withColumn("_good", comparable(F.col("embedding")))
    good = rows.where("_good").select("vec_id", "embedding")
    classes = written(good.groupBy("embedding").agg(F.count("*").alias("m"), F.min("vec_id").alias("least")))
    count, widest = classes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    nothing = rows.where("not _good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if count:
        chosen = [r[0] for r in classes.orderBy(F.xxhash64("embedding"), "embedding").limit(pivots).select("embedding").collect()]
        angled = classes.withColumn("_length", F.size("embedding"))
        types = ", ".join(f"{n} {t}" for n, t in angled.dtypes)
        angled = angled.mapInArrow(_angles(chosen), f"{types}, _angles array<double>, _pivot int, _angle double")
        size = min(TILE_ROWS, max(256, TILE_BYTES // (8 * widest)), max(256, -(-count // tiles)))
        angled = numbered(angled, "_length", "_pivot", "_angle").withColumn("tile", F.expr(f"_at div {size}"))
        met = _meetings(angled, -(-count // size), threshold)
        dealt = angled.select("tile", "_at", "m", "embedding").join(met, "tile").repartition("pair").sortWithinPartitions("pair", "side", "_at")
        found = written(dealt.select("pair", "side", "_at", "m", "embedding").mapInArrow(_meet(threshold), "node long, root long, n long"))
        links = found.groupBy(F.col("node").alias("_at")).agg(F.sum("n").alias("n"))
        roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
        known = angled.select("_at", "embedding", "m", "least").join(links, "_at", "left").join(
            roots.select(F.col("node").alias("_at"), "root"), "_at", "left").withColumn("root", F.coalesce("root", "_at"))
        named = known.groupBy("root").agg(F.min("least").alias("component_id"))
        known = known.join(named, "root").select(
            "embedding", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
        nothing = good.join(known, "embedding").select("vec_id", "n_links", "component_id").unionByName(nothing)
    return nothing.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
