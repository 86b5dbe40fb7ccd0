"""Removal of repeated byte strings by sampled positions (landmarks) and one doubling step, in place of prefix doubling in rounds.

Every string of `length` bytes that starts at two places, in one text or in two, is removed wherever it stands.

Names of strings of half the length come first: the name of a position is a hash of the half-length string there.  The
smallest name in a full-length string is its landmark, and neighbouring strings with the same landmark form a run of at
most half the length; equal strings have equal landmarks, at equal distances.  So one position in about 50 stands for all:

1. Spark sorts the landmarks' rank pairs (name, name of the whole run).  A unique name is done: nothing in its run
   repeats.  Equal pairs are past the threshold: the whole run repeats.  Rows of one name stream by, none is gathered.
2. What is left are runs that share a landmark with another run but not all of their bytes, mostly at the edges of copied
   passages.  Their positions are ranked again by pairs (name, name at an offset of half the length), which doubles the
   length to the full one.  Spark groups the runs by landmark; of a landmark of very many runs, Spark sorts the strings'
   pairs themselves, and equal neighbours stream by, so that no copy and no task holds all of its runs.

Spans come back to their texts by doc_id and a hash of the text; identical rows have identical spans.  A null text is an
empty one.  Texts shorter than `length` have no repeats.  Extra columns are left out.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import _BASE, _INVERSE, _byte_codes, _powers, mix64, slices
from .shared import cut

LENGTH, GROUP_RUNS = 200, 5000
_STEP = 1 << 20
_U = np.uint64


class _Names:
    """Hashes of any spans of some bytes."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(21, int(len(data)).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_codes()[data] * _powers(_BASE, size)[:len(data)], out=self.sums[1:])
        self.inverse = _powers(_INVERSE, size)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    blocks = -(-len(values) // width)
    table = np.full(blocks * width, ~_U(0))
    table[:len(values)] = values
    table = table.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Landmark name, run name, text, start in the text and number of strings of each run; at most 2^20 bytes."""
    half = length // 2
    n = len(data) - length + 1
    if n <= 0:
        return None
    names = _Names(data)
    # The upper 44 bits are the name, the lower ones the place: of equal names the first counts.
    marks = _smallest((names.all(half) >> _U(20) << _U(20)) | np.arange(len(data) - half + 1, dtype=np.uint64), length - half + 1)
    place = np.arange(n)
    text = np.searchsorted(offsets, place, "right") - 1
    inside = place + length <= offsets[text + 1]
    change = (np.diff(marks) != 0) | (np.diff(text) != 0) | (np.diff(inside) != 0)
    start = np.flatnonzero(np.concatenate(([True], change)))
    end = np.append(start[1:], n)
    start, end = start[inside[start]], end[inside[start]]
    name = names.at(start, end + length - 1) ^ mix64((end - start).astype(np.uint64))
    return marks[start] >> _U(20), name, text[start], start - offsets[text[start]], end - start


def _find_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2), _STEP - length):
                pieces = [(0, data, offsets)] if len(data) <= _STEP else [
                    (b, data[b:b + _STEP], np.array([0, len(data[b:b + _STEP])])) for b in range(0, len(data) - length + 1, _STEP - length + 1)]
                for base, part, at in pieces:
                    found = runs_of(part, at, length)
                    if found is None:
                        continue
                    mark, name, text, start, count = found
                    rows = pa.array(text + first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mark.view(np.int64)), pa.array(name.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
                         pa.array((start + base) << 16 | count)], names=["mark", "name", "doc_id", "_k", "run"])
    return run


def _sorted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (mark, name): those whose pair repeats, and the first of each pair whose mark has another pair.

    One row waits for its successor, and one pair for another pair of its mark; nothing else is held.
    """
    def out(rows: pa.RecordBatch, at: np.ndarray, whole: np.ndarray, probe: np.ndarray) -> pa.RecordBatch:
        part = rows.take(pa.array(at))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), pa.array(whole[at]), pa.array(probe[at])],
                                          names=["mark", "doc_id", "_k", "run", "whole", "probe"])

    held: pa.RecordBatch | None = None  # the last row
    flags = (True, True)  # whether it begins a mark, a pair
    waiting: pa.RecordBatch | None = None  # a first pair of its mark, as an output row
    for batch in _with_end(batches):
        if batch is None:
            if held is None:
                return
            rows, n = held, 1
        else:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = rows.num_rows - 1
        mark, name = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        new_mark = np.concatenate(([flags[0]], mark[1:] != mark[:-1]))
        new_pair = np.concatenate(([flags[1]], (mark[1:] != mark[:-1]) | (name[1:] != name[:-1])))
        whole = ~new_pair
        whole[:-1] |= ~new_pair[1:]
        probe = np.zeros(len(mark), bool)
        first = np.flatnonzero(new_pair[:n])
        if len(first):
            if waiting is not None and not new_mark[first[0]]:
                yield waiting
            waiting = None
            probe[first] = ~new_mark[first]
            probe[first[:-1]] |= ~new_mark[first[1:]]
        some = np.flatnonzero((whole | probe)[:n])
        if len(some):
            yield out(rows, some, whole, probe)
        if len(first) and new_mark[first[-1]]:
            # Its row is out already if it repeats; as a probe it must not count as a repeat once more.
            waiting = out(rows, first[-1:], whole, np.ones(len(mark), bool))
        held, flags = rows.slice(len(mark) - 1), (bool(new_mark[-1]), bool(new_pair[-1]))


def _with_end(batches):
    yield from batches
    yield None


def _pairs(names: _Names, place: np.ndarray, length: int) -> np.ndarray:
    """The rank pair of each string: the name of its first half and the name half the length further on."""
    half = length // 2
    return mix64(names.at(place, place + half) * _U(0x9FB21C651E98DF25) + names.at(place + half, place + length))


def _places(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each string of `length` bytes in rows of bytes that begin at `at`."""
    count = np.diff(at) - length + 1
    row = np.repeat(np.arange(len(count)), count)
    return row, np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())


def _strings(length: int):
    """The bytes of each probe's run, as rows of its landmark; of a hot landmark, each string's pair and start instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unpack = zstandard.ZstdDecompressor()
            for k, body in enumerate(batch.column(2)):
                text = unpack.decompress(body.as_py())
                probes = batch.column(3)[k].values

                def rows(of: pa.StructArray, pair: pa.Array, run_: pa.Array, strings: pa.Array, k: int = k) -> pa.RecordBatch:
                    owner = [pa.array([batch.column(c)[k].as_py()] * len(of), pa.int64()) for c in (0, 1)]
                    return pa.RecordBatch.from_arrays([of.field("mark"), pair, of.field("whole"), *owner, run_, strings],
                                                      names=["mark", "pair", "whole", "doc_id", "_k", "run", "bytes"])

                hot = probes.field("hot").to_numpy(zero_copy_only=False)
                for some in (np.flatnonzero(~hot), np.flatnonzero(hot)):
                    size = (probes.field("run").to_numpy()[some] & 0xFFFF) + length - 1
                    block = np.cumsum(size) // _STEP
                    for at in np.split(some, np.flatnonzero(np.diff(block)) + 1) if len(some) else []:
                        of = probes.take(pa.array(at))
                        run_ = of.field("run")
                        strings = pa.array([text[r >> 16:(r >> 16) + (r & 0xFFFF) + length - 1] for r in run_.to_pylist()], pa.binary())
                        if not hot[at[0]]:
                            yield rows(of, pa.nulls(len(of), pa.int64()), run_, strings)
                            continue
                        _, _, data, begin = next(slices(strings, 1 << 62))
                        row, place = _places(begin, length)
                        start = (run_.to_numpy()[row] >> 16) + place - begin[row]
                        yield rows(of.take(pa.array(row)), pa.array(_pairs(_Names(data), place, length).view(np.int64)),
                                   pa.array(start << 16 | 1), pa.nulls(len(row), pa.binary()))
    return run


def _double(length: int):
    """Of rows sorted by (mark, pair): the strings of each open probe that another probe of its landmark has as well.

    The rows without a pair are groups of few runs, which are held; of the others one row waits for its successor.
    """
    def settle(rows: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        _, _, data, at = next(slices(rows.column(6), 1 << 62))
        row, place = _places(at, length)
        pair = _pairs(_Names(data), place, length)
        order = np.lexsort((pair, group[row]))
        same = (np.diff(pair[order]) == 0) & (np.diff(group[row[order]]) == 0)
        twice = np.zeros(len(order), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        open_ = ~rows.column(2).to_numpy(zero_copy_only=False)
        twice &= open_[row]
        row, place = row[twice], place[twice]
        cut_ = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 1) | (np.diff(row) != 0)))) if len(row) else row
        size = np.diff(np.append(cut_, len(row)))
        row, place = row[cut_], place[cut_]
        start = (rows.column(5).to_numpy()[row] >> 16) + place - at[row]
        return out(rows, row, start << 16 | size)

    def out(rows: pa.RecordBatch, at: np.ndarray, run_: np.ndarray) -> pa.RecordBatch:
        take = pa.array(at)
        return pa.RecordBatch.from_arrays([rows.column(3).take(take), rows.column(4).take(take), pa.array(run_)], names=["doc_id", "_k", "run"])

    def one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        return batches[0] if len(batches) == 1 else pa.concat_batches(batches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: list[pa.RecordBatch] = []  # the last row with a pair
        repeats = False  # whether it equals the one before it
        for batch in _with_end(batches):
            if batch is not None:
                paired = batch.column(1).is_valid()
                some = batch.filter(paired)
                batch = batch.filter(pc.invert(paired))
                # Offsets of 64 bits: held rows are joined whatever their size.
                batch = batch.set_column(6, "bytes", batch.column(6).cast(pa.large_binary()))
            else:
                some = None
            if last or some is not None and some.num_rows:
                rows = one([*last, some]) if some is not None else last[0]
                mark, pair = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                same = (mark[1:] == mark[:-1]) & (pair[1:] == pair[:-1])
                twice = np.zeros(rows.num_rows, bool)
                twice[0] = bool(last) and repeats
                twice[1:] |= same
                twice[:-1] |= same
                last, repeats = [rows.slice(rows.num_rows - 1)] if some is not None else [], bool(twice[-1])
                twice &= ~rows.column(2).to_numpy(zero_copy_only=False)
                if some is not None:
                    twice[-1] = False
                at = np.flatnonzero(twice)
                if len(at):
                    yield out(rows, at, rows.column(5).to_numpy()[at])
            if batch is not None:
                if batch.num_rows:
                    held.append(batch)
                if sum(b.num_rows for b in held) < GROUP_RUNS:
                    continue
            if not held:
                continue
            rows = one(held)
            change = np.flatnonzero(np.diff(rows.column(0).to_numpy()) != 0) + 1
            stop = rows.num_rows if batch is None else int(change[-1]) if len(change) else 0
            if stop:
                yield settle(rows.slice(0, stop), np.searchsorted(change, np.arange(stop), "right"))
            held = [rows.slice(stop)] if stop < rows.num_rows else []
    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by document and run: neighbouring runs as one, cut at each 2^14 bytes so that a size keeps its 16 bits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, run_ = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        start, end = run_ >> 16, (run_ >> 16) + (run_ & 0xFFFF)
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] != end[:-1]) | (start[1:] >> 14 != start[:-1] >> 14))))
        size = end[np.append(first[1:], len(key)) - 1] - start[first]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), batch.column(1).take(pa.array(first)), pa.array(start[first] << 16 | size)],
                                         names=["doc_id", "_k", "run"])


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            bodies = [pack.compress(x.as_py()) for x in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], names=["doc_id", "_k", "body"])
    return docs.mapInArrow(run, "doc_id long, _k long, body binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, group_runs: int = GROUP_RUNS) -> DataFrame:
    """(doc_id, _k, run) of rows (doc_id, _k, text): run holds start << 16 | number of repeated strings that begin there on."""
    runs = docs.mapInArrow(_find_runs(length), "mark long, name long, doc_id long, _k long, run long")
    ranked = cut(runs.repartition("mark").sortWithinPartitions("mark", "name").mapInArrow(
        _sorted_pairs, "mark long, doc_id long, _k long, run long, whole boolean, probe boolean"))
    settled = ranked.where("whole").select("doc_id", "_k", "run")
    probes = ranked.where("probe")
    marks = probes.groupBy("mark").agg(F.count("*").alias("_n"), F.count_if(~F.col("whole")).alias("_open")).where("_open > 0")
    probes = probes.join(marks, "mark").groupBy("doc_id", "_k").agg(F.collect_list(F.struct(
        "mark", (F.col("_n") > group_runs).alias("hot"), "whole", "run")).alias("probes"))
    mine = probes.select(F.col("doc_id").alias("_d"), F.col("_k").alias("_h"), "probes")
    bodies = _packed(docs)
    strings = (bodies.join(mine, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_h")))
               .select("doc_id", "_k", "body", "probes")
               .mapInArrow(_strings(length), "mark long, pair long, whole boolean, doc_id long, _k long, run long, bytes binary"))
    more = strings.repartition("mark", "pair").sortWithinPartitions("mark", "pair").mapInArrow(_double(length), "doc_id long, _k long, run long")
    more = more.repartition("doc_id", "_k").sortWithinPartitions("doc_id", "_k", "run").mapInArrow(_joined, "doc_id long, _k long, run long")
    return settled.unionByName(more)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, group_runs: int = GROUP_RUNS) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each maximal removed run, in bytes) and kept, the bytes that stay."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_k"), "text")
    spans = repeated_spans(docs, length, group_runs).groupBy("doc_id", "_k").agg(F.collect_list("run").alias("runs"))
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("_k").alias("_h"), "runs")
    joined = _packed(docs).join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_h")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, begin, stop, sizes, lengths = [], [], [], [0], []
            for body, found in zip(batch.column(1), batch.column(2), strict=True):
                data = unpack.decompress(body.as_py())
                r = found.values.to_numpy() if found.is_valid else np.zeros(0, np.int64)
                gone = np.zeros(len(data) + 1, np.int32)
                np.add.at(gone, r >> 16, 1)
                np.add.at(gone, (r >> 16) + (r & 0xFFFF) + length - 1, -1)
                change = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(gone[:-1]) > 0, [False]))))
                a, b = change[::2], change[1::2]
                begin.append(a)
                stop.append(b)
                sizes.append(len(a))
                edges = [0, *np.stack((a, b), axis=1).ravel().tolist(), len(data)]
                kept.append(b"".join(data[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2)))
                lengths.append(len(data))
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate(begin), pa.int64()), pa.array(np.concatenate(stop), pa.int64())], names=["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), spans), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.select("doc_id", "body", "runs").mapInArrow(
        run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
