"""SimHash near-duplicates: fingerprints of word shingles, linked where at most `radius` of 64 bits differ.

Equal fingerprints fold to one row before any comparison.  The rest meet by blocks: the 64 bits are cut into radius + 2
blocks, and two fingerprints within the radius agree on at least two of them, so every pair of blocks is a key.  Rows of
one key are compared bit-sliced: plane b holds bit b of all rows, a shifted plane is xor-ed with itself, and carry-save
counters add up the differing bits of 64 pairs in each machine word; a stretch is abandoned once all its pairs are past
the radius.  A unit of comparison hands on a spanning star for each of its groups, never all pairs.

A key with more than `unit` rows is dealt to several units.  Rows are first compared within their unit; components are
formed; after that only rows outside the key's most frequent component still have to meet the key's other rows.  Nothing
is capped, and one large group of near copies costs rows in proportion.

Nulls and empty texts have fingerprint zero, linked like any other.  Repeated doc_ids share a class with all their rows;
a null doc_id never names a class.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import lower_ascii, slices, word_bounds
from .shared import components, cut

SHINGLE, SEED, RADIUS, UNIT = 4, 42, 4, 2048
_BATCH = 1 << 16


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text: a bit is set where more than half of the shingles' hashes have it."""
    low = lower_ascii(data)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    starts, ends, first = word_bounds(inside, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    # The words of each text joined by single spaces.
    length = ends - starts
    at = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
    joined = np.full(int((length + 1).sum()), 32, np.uint8)
    joined[np.repeat(at - starts, length) + np.flatnonzero(inside)] = low[inside]
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    begin = np.concatenate(([0], np.cumsum(count)))
    word = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    final = word + np.repeat(np.minimum(words, size), count) - 1
    view, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(at[word].tolist(), (at[final] + length[final]).tolist(), strict=True)),
                    np.uint64, len(word))
    some = np.flatnonzero(count)
    for b in range(64):
        ones = np.add.reduceat(((h >> np.uint64(b)) & np.uint64(1)).astype(np.int64), begin[:-1][some])
        out[some] |= (2 * ones > count[some]).astype(np.uint64) << np.uint64(b)
    return out


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Documents' doc_id and _fp, the 64-bit fingerprint as a signed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(fingerprints_of(data, offsets, size).view(np.int64))],
                    names=["doc_id", "_fp"])
    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, _fp long")


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking rows a and b; a label is the smallest row of its group."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            nearer = label[label]
            if np.array_equal(nearer, label):
                break
            label = nearer


def _within(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the pairs (i, i + shift) that are valid and differ in at most `radius` bits."""
    q, r = divmod(shift, 64)
    width = len(valid)
    near, far = planes[:, :width], planes[:, q:q + width]
    n = radius.bit_length()
    counters = [np.zeros(width, np.uint64) for _ in range(n)]
    over = ~valid
    beyond = planes[:, q + 1:q + 1 + width] if r else None
    for b in range(64):
        other = (far[b] >> np.uint64(r)) | (beyond[b] << np.uint64(64 - r)) if r else far[b]
        carry = near[b] ^ other
        for k in range(n):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over = over | carry  # counted past what the counters hold
        if b % 8 == 7:
            # Counters greater than the radius, compared from the highest bit.
            more, same = np.zeros(width, np.uint64), ~np.zeros(width, np.uint64)
            for k in range(n - 1, -1, -1):
                if radius >> k & 1:
                    same = same & counters[k]
                else:
                    more = more | (same & counters[k])
                    same = same & ~counters[k]
            over = over | more
            if not (~over).any():
                break
    return ~over


def _packed(bits: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(bits, bitorder="little")
    out[:len(packed)] = packed
    return out.view("<u8")


def link_units(unit: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The smallest linked row of each row, comparing all rows of equal `unit`, which stand together."""
    label = np.arange(len(fp))
    rows = label.copy()
    shift, rebuild = 1, True
    while True:
        if rebuild:
            # Units no longer than the shift, and units that are one group already, are done.
            starts = np.flatnonzero(np.concatenate(([True], unit[rows][1:] != unit[rows][:-1]))) if len(rows) else rows
            if not len(starts):
                return label
            size = np.diff(np.concatenate((starts, [len(rows)])))
            apart = np.maximum.reduceat(label[rows], starts) != np.minimum.reduceat(label[rows], starts)
            rows = rows[np.repeat((size > shift) & apart, size)]
            if not len(rows):
                return label
            u, f = unit[rows], fp[rows]
            width = -(-len(rows) // 64)
            planes = np.zeros((64, width + 2), np.uint64)
            for b in range(64):
                planes[b, :width] = _packed(((f >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), width)
        if shift < len(rows):
            pairs = u[:-shift] == u[shift:]
            short = -(-len(pairs) // 64)
            close = _within(planes, shift, _packed(pairs, short), radius)
            found = np.flatnonzero(np.unpackbits(close.view(np.uint8), bitorder="little")[:len(pairs)])
            if len(found):
                label = _join(label, rows[found], rows[found + shift])
        shift += 1
        rebuild = shift < 8 or shift % 32 == 0 or shift >= len(rows)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(unit, fp):
            fp = fp.view(np.uint64)
            label = link_units(unit, fp, radius)
            linked = np.flatnonzero(label != np.arange(len(fp)))
            edges = np.unique(np.stack((fp[label[linked]].view(np.int64), fp[linked].view(np.int64))), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in range(4)))
            if sum(len(x[0]) for x in held) < _BATCH:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            if not len(change):
                held = [tuple(cols)]
                continue
            unit = np.searchsorted(change, np.arange(change[-1]), "right")
            yield stars(unit, cols[3][:change[-1]])
            held = [tuple(c[change[-1]:] for c in cols)]
        if held:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            yield stars(np.searchsorted(change, np.arange(len(cols[0])), "right"), cols[3])
    return run


def _stars(units: DataFrame, radius: int) -> DataFrame:
    """Spanning stars of rows (_key, _i, _j, _fp) within units (_key, _i, _j)."""
    units = units.repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j", "_fp")
    return units.select("_key", "_i", "_j", "_fp").mapInArrow(_compare(radius), "a long, b long").distinct()


def links(prints: DataFrame, radius: int = RADIUS, unit: int = UNIT) -> DataFrame:
    """(node, root) for each of the distinct fingerprints (_fp) that is within the radius of another one."""
    blocks = radius + 2
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for n, pair in enumerate(combinations(range(blocks), 2)):
        key = F.lit(n).cast("long")
        for k in pair:
            width = cuts[k + 1] - cuts[k]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("_fp", cuts[k]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    keyed = prints.select("_fp", F.explode(F.array(*keys)).alias("_key"))
    counts = keyed.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1")
    met = cut(keyed.join(counts, "_key").withColumn("_c", F.ceil(F.col("_n") / unit).cast("int")))
    own = met.select("_key", F.pmod(F.xxhash64("_fp"), F.col("_c")).cast("int").alias("_i"), F.lit(0).alias("_j"), "_fp")
    edges = _stars(own, radius)
    hot = met.where("_c > 1")
    if hot.isEmpty():
        return components(edges)
    roots = components(edges)
    hot = hot.join(roots.select(F.col("node").alias("_fp"), "root"), "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    sizes = hot.groupBy("_key", "root").agg(F.count("*").alias("_m"))
    main = sizes.groupBy("_key").agg(F.max_by("root", F.struct("_m", "root")).alias("_main"),
                                     (F.sum("_m") - F.max("_m")).alias("_rest"))
    hot = cut(hot.join(main, "_key").where("_rest > 0").withColumn("_d", F.ceil(F.col("_rest") / unit).cast("int")))
    all_rows = hot.select("_key", F.pmod(F.xxhash64("_fp"), F.col("_c")).cast("int").alias("_i"),
                          F.explode(F.sequence(F.lit(0), F.col("_d") - 1)).alias("_j"), "_fp")
    others = hot.where("root <> _main").select(
        "_key", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("_i"),
        F.pmod(F.xxhash64("_fp"), F.col("_d")).cast("int").alias("_j"), "_fp")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(
        _stars(all_rows.union(others).distinct(), radius)))


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = RADIUS, unit: int = UNIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable, of each document."""
    prints = cut(fingerprints(docs, text))
    classes = prints.groupBy("_fp").agg(F.min("doc_id").alias("_least"))
    roots = links(classes.select("_fp"), radius, unit)
    classes = classes.join(roots, classes["_fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "_fp"))
    least = classes.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = classes.join(least, "root").select("_fp", "component_id")
    return prints.join(classes, "_fp").select(
        "doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def with_fingerprint(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """All columns of docs and _fp."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(at)):
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, end - first).columns, pa.array(fingerprints_of(data, offsets, size).view(np.int64))],
                    names=[*batch.schema.names, "_fp"])
    return docs.mapInArrow(run, docs.withColumn("_fp", F.lit(0).cast("long")).schema)


def one_of_each_group(docs: DataFrame, text: str = "text", radius: int = RADIUS, unit: int = UNIT) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id and, of its texts, the smallest fingerprint.

    Rows of one doc_id whose texts are no near duplicates are groups of their own.  Rows without doc_id can't be named: they
    link nothing and all stay.  Of equal rows one stays, whichever.
    """
    named = docs.where("doc_id is not null")
    prints = cut(fingerprints(named, text))
    roots = links(prints.select("_fp").distinct(), radius, unit)
    joined = prints.join(roots, prints["_fp"] == roots["node"], "left")
    stay = cut(joined.groupBy(F.coalesce("root", "_fp")).agg(F.min(F.struct("doc_id", "_fp")).alias("s")).select("s.*"))
    several = cut(prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    rest = named.join(stay.select("doc_id").distinct(), "doc_id", "left_semi")
    lone = rest.join(several, "doc_id", "left_anti")
    # Only rows that share a doc_id need their fingerprint again to be told apart.
    shared = with_fingerprint(rest.join(several, "doc_id", "left_semi"), text).join(stay, ["doc_id", "_fp"], "left_semi")
    one = Window.partitionBy("doc_id", "_fp").orderBy(F.xxhash64(text))
    shared = shared.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return lone.select(*docs.columns).unionByName(shared.select(*docs.columns)).unionByName(docs.where("doc_id is null"))
