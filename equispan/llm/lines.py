"""Fuzzy line deduplication by MinHash.

Lines are what newlines separate; blank ones are never judged.  Similarity is that of the sets of runs of five code points
(a shorter line is its own run).  Signatures of lines with up to FEW different runs of five, short or repetitive ones, are
taken from these runs; two such lines at the threshold share no key in two of ten thousand cases.  Those of other lines are
taken from runs of nine, which unrelated lines seldom share; lines near FEW have both, so that similar ones always have one
kind in common.  A signature has 36 minima, by 36 permutations in lines of up to 90 different runs and by 36 bins of one hash in lines
of 60 or more (in between by both).  Twelve bands of three minima are the keys that similar lines meet by.  Of two lines that
share 0.7 of their runs of nine, six in a thousand share no key; at 0.8 it is three in ten thousand.  Single signs changed
all over a line leave 0.65 to 0.7 of the runs of nine where 0.8 of the runs of five are left: there it is up to two in a hundred.

Rows of one key stream by in order; the first, the most frequent in its part of the input, is the centre, and every other
line of the key is compared to it by the exact Jaccard similarity of all shingles.  Components are formed; the key's lines
that are not in its centre's component then meet all others of the key, but for those that set sizes and bitmaps rule out,
and components are formed again.  So no group makes all its pairs, yet none goes uncompared.

Of each component, identical lines included, the first line by (doc_id, line number) stays, null doc_ids first.  Rows of
equal doc_id and text count as one document and get the same result.  A null text is an empty one.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix64, slices, sorted_distinct, span_hashes, window_hashes
from .shared import components, cut, written

SIMILARITY, SHINGLE, KEY_SHINGLE = 0.8, 5, 9
FEW = 26
BANDS, ROWS = 12, 3
SHORT, LONG = 90, 60
WORDS = 32
#: A filter of wanted lines takes 16 bits for each, and is left out where it would take more than this.
FILTER_BITS = 1 << 28
_NONE = ~np.uint64(0)


class _Lines:
    """The lines of a slice of texts that are not blank: where they stand, in bytes and in code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        breaks = np.flatnonzero(data == 10)
        starts = sorted_distinct(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks + 1)))
        # A break at the end of a text begins an empty line, and one begun by it is the next text's first: both in order.
        starts = starts[starts < n]
        text = np.searchsorted(offsets, starts, "right") - 1
        ends = np.minimum(np.append(breaks, n)[np.searchsorted(breaks, starts)], offsets[text + 1])
        ink = np.concatenate(([0], np.cumsum(data != 32)))
        some = ink[ends] - ink[starts] > 0
        self.start, self.end, self.text = starts[some], ends[some], text[some]
        before = np.concatenate(([0], np.cumsum(data == 10)))
        self.number = before[self.start] - before[offsets[self.text]]
        self.id = span_hashes(data, self.start, self.end)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.first, self.last = points[self.start], points[self.end]
        self.codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def shingle_hashes(codes: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the spans of code points, span by span, and where each span's begin."""
    words = mix64(codes.astype(np.uint64) + np.uint64(1))
    full = window_hashes(words, length)
    size = last - first
    count = np.maximum(size - length + 1, 1)
    begin = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(first - begin[:-1], count) + np.arange(begin[-1])
    out = full[np.minimum(at, max(len(full) - 1, 0))] if len(full) else np.zeros(len(at), np.uint64)
    for k in np.flatnonzero(size < length):
        out[begin[k]] = window_hashes(words[first[k]:last[k]], int(size[k]))[0] ^ np.uint64(size[k])
    return out, begin


def _bands(least: np.ndarray, kind: int) -> np.ndarray:
    """Keys of rows of minima; a band of empty bins only is _NONE."""
    least = least.reshape(-1, BANDS, ROWS)
    key = np.zeros(least.shape[:2], np.uint64) + np.arange(kind * BANDS, (kind + 1) * BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + least[:, :, k])
    return np.where((least == _NONE).all(axis=2), _NONE, key)


def _minima(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The least value of each span of hashes under each permutation."""
    least = np.empty((len(begin) - 1, BANDS * ROWS), np.uint64)
    rng = np.random.default_rng(9)
    for k, (a, b) in enumerate(rng.integers(0, 1 << 64, (BANDS * ROWS, 2), np.uint64)):
        least[:, k] = np.minimum.reduceat(h * (a | np.uint64(1)) + b, begin[:-1])
    return least


def _few(codes: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines of at most `most` different shingles, these shingles' hashes, and where each line's begin."""
    size = last - first
    maybe = size - length + 1 <= most
    rest = np.flatnonzero(~maybe)
    if len(rest):
        # The number of places hit is no more than that of different shingles.
        h, begin = shingle_hashes(codes, first[rest], last[rest], length)
        hit = np.zeros((len(rest), 256), bool)
        hit[np.repeat(np.arange(len(rest)), np.diff(begin)), (h & np.uint64(255)).astype(np.int64)] = True
        maybe[rest[hit.sum(axis=1) <= most]] = True
    at = np.flatnonzero(maybe)
    h, begin = shingle_hashes(codes, first[at], last[at], length)
    line = np.repeat(np.arange(len(at)), np.diff(begin))
    order = np.lexsort((h, line))
    h, line = h[order], line[order]
    own = np.concatenate(([True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])))[:len(h)]
    h, line = h[own], line[own]
    count = np.bincount(line, minlength=len(at))
    few = count <= most
    return at[few], h[few[line]], np.concatenate(([0], np.cumsum(count[few])))


def keys_of(codes: np.ndarray, first: np.ndarray, last: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Rows of band keys of lines, by permutations, by bins and by permutations of short shingles; _NONE where a line has no such key."""
    out = np.full((len(first), 3 * BANDS), _NONE)
    size, bins = last - first - KEY_SHINGLE + 1, BANDS * ROWS
    few, h, begin = _few(codes, first, last, SHINGLE, FEW)
    nine = np.ones(len(first), bool)
    if len(few):
        out[few, 2 * BANDS:] = _bands(_minima(h, begin), 2)
        # A line similar to one of more than FEW different shingles has more than this share of FEW.
        nine[few[np.diff(begin) <= similarity * FEW]] = False
    # By different runs, not by length: a periodic line can be similar to a much longer one.
    rest = np.flatnonzero(nine)
    short, h, begin = _few(codes, first[rest], last[rest], KEY_SHINGLE, SHORT)
    if len(short):
        out[rest[short], :BANDS] = _bands(_minima(h, begin), 0)
    long_ = np.flatnonzero(nine & (size >= LONG))
    if len(long_):
        h, begin = shingle_hashes(codes, first[long_], last[long_], KEY_SHINGLE)
        least = np.full(len(long_) * bins, _NONE)
        np.minimum.at(least, np.repeat(np.arange(len(long_)) * bins, np.diff(begin)) + (h % np.uint64(bins)).astype(np.int64), h)
        out[long_, BANDS:2 * BANDS] = _bands(least, 1)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _each_slice(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(batch.num_columns - 1)):
                lines = _Lines(data, offsets)
                if len(lines.id):
                    yield from make(batch.slice(first, end - first), data, lines)
    return run


def _places(rows: pa.RecordBatch, data: np.ndarray, lines: _Lines):
    take = pa.array(lines.text)
    yield pa.RecordBatch.from_arrays([_signed(lines.id), rows.column(0).take(take), rows.column(1).take(take), pa.array(lines.number, pa.int32())],
                                     names=["id", "doc_id", "_k", "pos"])


def _keyed(similarity: float):
    def make(rows: pa.RecordBatch, data: np.ndarray, lines: _Lines):
        _, at, n = np.unique(lines.id, return_index=True, return_counts=True)
        keys = keys_of(lines.codes, lines.first[at], lines.last[at], similarity)
        row, band = np.nonzero(keys != _NONE)
        yield pa.RecordBatch.from_arrays([_signed(keys[row, band]), pa.array(-n[row]), _signed(lines.id[at][row]), pa.array(np.zeros(len(row), np.int32))],
                                         names=["key", "rank", "id", "size"])
    return make


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key has another line, with the key's first line; one row waits for the next."""
    key = centre = width = None
    alone = False
    for batch in batches:
        if not batch.num_rows:
            continue
        k, i, size = (batch.column(c).to_numpy() for c in (0, 2, 3))
        new = np.concatenate(([k[0] != key], k[1:] != k[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        mid = np.where(head < 0, centre if centre is not None else 0, i[np.maximum(head, 0)])
        wide = np.where(head < 0, width if width is not None else 0, size[np.maximum(head, 0)])
        other = i != mid
        # A centre is a row of its key as soon as another line shows up.
        group = np.cumsum(new)
        met = np.flatnonzero(other)
        first = met[np.unique(group[met], return_index=True)[1]] if len(met) else met
        first = first[(group[first] > 0) | alone] if len(first) else first
        cols = [(k, k), (i, mid), (size, wide), (mid, mid)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a[met], b[first]))) for a, b in cols], names=["key", "id", "size", "centre"])
        if new.any():
            alone = not other[group == group[-1]].any()
        else:
            alone = alone and not other.any()
        key, centre, width = k[-1], int(mid[-1]), int(wide[-1])


def _wanted(ids: DataFrame):
    """A test of line ids that every id passes, and few others; None where it would be too large to send."""
    n = ids.count()
    bits = 1 << max(15, int(16 * n).bit_length())
    if bits > FILTER_BITS:
        return None
    place = [F.pmod(F.col("id"), F.lit(bits)), F.pmod(F.shiftright("id", 32), F.lit(bits))]
    maps = (ids.select(F.explode(F.array(*place)).alias("p")).groupBy(F.expr("p div 32768").alias("b"))
            .agg(F.bitmap_construct_agg(F.pmod("p", F.lit(32768)))).collect())  # FILTER_BITS / 8 bytes at most
    table = np.zeros((bits // 32768, 4096), np.uint8)
    for b, part in maps:
        table[b] = np.frombuffer(part, np.uint8)
    return bits, ids.sparkSession.sparkContext.broadcast(table.ravel())


def _found(docs: DataFrame, ids: DataFrame, kind: str, value) -> DataFrame:
    """One row for each wanted line: its id and what value(data, lines, rows) gives for it, of type `kind`."""
    sieve = _wanted(ids)

    def make(rows: pa.RecordBatch, data: np.ndarray, lines: _Lines):
        id_, at = np.unique(lines.id, return_index=True)
        if sieve:
            bits, table = sieve
            signed = id_.view(np.int64)
            passed = np.ones(len(id_), bool)
            for p in (signed % bits, (signed >> 32) % bits):
                passed &= (table.value[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
            id_, at = id_[passed], at[passed]
        if len(id_):
            yield pa.RecordBatch.from_arrays([_signed(id_), value(data, lines, at)], names=["id", "value"])

    found = docs.select("doc_id", "_k", "text").mapInArrow(_each_slice(make), f"id long, value {kind}")
    return found.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _bytes(data: np.ndarray, lines: _Lines, at: np.ndarray) -> pa.Array:
    return pa.array([data[a:b].tobytes() for a, b in zip(lines.start[at].tolist(), lines.end[at].tolist(), strict=True)], pa.binary())


def _bitmaps(data: np.ndarray, lines: _Lines, at: np.ndarray) -> pa.Array:
    """For each line the 64 * WORDS bits that its shingles' hashes choose, and how many different shingles it has."""
    h, begin = shingle_hashes(lines.codes, lines.first[at], lines.last[at])
    line = np.repeat(np.arange(len(at)), np.diff(begin))
    bits = np.zeros((len(at), 64 * WORDS), np.uint8)
    bits[line, (h % np.uint64(64 * WORDS)).astype(np.int64)] = 1
    words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    order = np.lexsort((h, line))
    h, line = h[order], line[order]
    size = np.bincount(line[np.concatenate(([True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])))], minlength=len(at))
    values = np.concatenate((words, size[:, None]), axis=1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * (WORDS + 1), pa.int32()), pa.array(values.ravel()))


def _verify(similarity: float):
    """Pairs (a, b, x, y) whose texts x and y are similar enough, a batch at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.maximum(1, np.array([len(x.as_buffer()) + len(y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]))
            stops = np.searchsorted(np.cumsum(size), np.arange(1 << 20, size.sum() + (1 << 20), 1 << 20)) + 1
            first = 0
            for stop in np.unique(np.minimum(stops, batch.num_rows)).tolist():
                rows = batch.slice(first, stop - first)
                first = stop
                if not rows.num_rows:
                    continue
                sides = []
                for k in (2, 3):
                    _, _, data, offsets = next(slices(rows.column(k), 1 << 62))
                    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
                    codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
                    h, begin = shingle_hashes(codes, points[:-1], points[1:])
                    pair = np.repeat(np.arange(rows.num_rows), np.diff(begin))
                    order = np.lexsort((h, pair))
                    h, pair = h[order], pair[order]
                    own = np.concatenate(([True], (h[1:] != h[:-1]) | (pair[1:] != pair[:-1])))
                    sides.append((pair[own], h[own]))
                pair, h = np.concatenate((sides[0][0], sides[1][0])), np.concatenate((sides[0][1], sides[1][1]))
                order = np.lexsort((h, pair))
                pair, h = pair[order], h[order]
                both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=rows.num_rows)
                total = np.bincount(pair, minlength=rows.num_rows)
                good = pa.array(np.flatnonzero(both >= similarity * (total - both)))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(good), rows.column(1).take(good)], names=["a", "b"])
    return run


def _similar(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) of lines those whose shingle sets are similar enough."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = written(_found(docs, ids, "binary", _bytes))
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_verify(similarity), "a long, b long")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def line_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of each distinct line of rows (doc_id, _k, text) that is similar to another one."""
    keys = docs.mapInArrow(_each_slice(_keyed(similarity)), "key long, rank long, id long, size int").repartition("key").sortWithinPartitions("key", "rank", "id")
    met = written(keys.mapInArrow(_meetings, "key long, id long, size int, centre long").distinct())
    pairs = cut(met.where("id <> centre").select(*_pair("id", "centre")).distinct())
    edges = cut(_similar(pairs, docs, similarity))
    roots = components(edges)
    named = met.join(roots.toDF("id", "r"), "id", "left").join(roots.toDF("centre", "c"), "centre", "left")
    named = named.select("key", "id", F.coalesce("r", "id").alias("r"), F.coalesce("c", "centre").alias("c"))
    named = cut(named.join(named.where("r <> c").select("key").distinct(), "key", "left_semi"))
    if named.isEmpty():
        return roots
    # What cannot be similar is left out exactly: sets whose sizes differ too much, and sets whose bitmaps differ in more
    # places than their symmetric difference may have elements.
    maps = _found(docs, cut(named.select("id").distinct()), "array<long>", _bitmaps)
    named = named.join(maps, "id").select("key", "id", F.col("value")[WORDS].alias("size"), "r", "c", *[F.col("value")[k].alias(f"b{k}") for k in range(WORDS)])
    named = cut(named)
    x, y = named.where("r <> c").alias("x"), named.alias("y")
    total = F.col("x.size") + F.col("y.size")
    apart = sum((F.bit_count(F.col(f"x.b{k}").bitwiseXOR(F.col(f"y.b{k}"))) for k in range(WORDS)), F.lit(0))
    near = (F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size")) & (apart <= total * (1 - similarity) / (1 + similarity) + 1e-9)
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.r") != F.col("y.r")) & near)
    more = more.select(F.col("x.id").alias("p"), F.col("y.id").alias("q"))
    more = cut(more.select(*_pair("p", "q")).distinct().join(pairs, ["a", "b"], "left_anti"))
    if more.isEmpty():
        return roots
    return components(edges.union(_similar(more, docs, similarity)))


def dedup_lines(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Documents with `text` reduced to the lines that stay, n_lines and n_removed; all columns but these stay as they are."""
    docs = docs.drop("n_lines", "n_removed", "_k", "_kept")
    docs = docs.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(F.col("doc_id"), F.xxhash64("doc_id", text).alias("_k"), F.col(text).alias("text"))
    roots = line_classes(keyed, similarity)
    places = keyed.mapInArrow(_each_slice(_places), f"id long, doc_id {kind}, _k long, pos int")
    first = places.groupBy("id").agg(F.min(F.struct("doc_id", "_k", "pos")).alias("at"))
    first = first.join(roots.toDF("id", "root"), "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("at").alias("at"))
    kept = first.select("at.*").groupBy("doc_id", "_k").agg(F.collect_list("pos").alias("_kept"))
    kept = kept.select(F.col("doc_id").alias("_d"), F.col("_k").alias("_h"), "_kept")
    out = docs.withColumn("_k", F.xxhash64("doc_id", text)).join(
        kept, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_h")), "left")
    out = out.withColumn("_lines", F.split(text, "\n", -1))
    blank = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.trim(F.get("_lines", i)) == "")
    out = out.withColumn("_stay", F.sort_array(F.concat(F.coalesce("_kept", F.array().cast("array<int>")), blank)))
    names = [F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n").alias(c) if c == text else F.col(c) for c in docs.columns]
    return out.select(*names, F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_stay")).cast("long").alias("n_removed"))
