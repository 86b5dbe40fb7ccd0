"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Only lengths decide, and there are at most `capacity` different ones, so the plan is made from their counts alone:

1. Linear grouping: pieces longer than capacity / 8 are put into groups of equal cardinality, and each is taken to be as
   long as the longest of its group.  That leaves few sizes.
2. Configurations of these few sizes are optimised one after the other: the longest size still there, and the fullest
   filling beside it, found by a bounded knapsack; each is used as often as the counts allow.
3. The actual pieces take the places of their group, which frees what rounding up had reserved.
4. Small pieces go, longest first, where they leave least room; only when none has room is a sequence opened.

Plan steps are runs ("the next n pieces of length x stand at these places"), so the plan's size depends on the capacity
and not on the corpus.  Spark numbers the pieces of each length, a hot length in many parts, and each finds its place.

A null text is an empty one: one piece, the end token.  Repeated rows are packed each on its own; extra columns are left
out of the pieces, but pack() passes all columns of its input on.
"""
from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import slices
from .shared import cut

CAPACITY, END, GROUPS, PART_ROWS = 4096, 1, 48, 50_000
#: Word pieces that a Python worker remembers, and bytes of text it takes at once.
REMEMBERED, SLICE = 600_000, 6 << 20
VOCABULARY = "word_bpe_49k.json"


def _stretches(table: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches table[begin:begin + size], one after the other."""
    end = np.cumsum(size)
    return table[np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


def encoder(path: str):
    """A function from an array of texts to all their ids, as little-endian 32-bit numbers, and where each text's begin.

    The tokenizer never joins across white space, so a text's ids are those of its parts; equal parts are encoded once and
    remembered, in Arrow and numpy arrays.  New parts that are letters, perhaps with commas or stops behind, are encoded all
    in one call: each is one word to the tokenizer, whose last token ends a word.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    final = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    final[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
    none = pa.array([""]), np.zeros(0, "<u4"), np.zeros(1, np.int64)
    known, table, size = none  # parts, their ids one after the other, and how many each has

    def each(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def encode_parts(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different parts, and how many each has."""
        stems: dict[str, int] = {}
        rest: dict[str, int] = {}  # what follows a stem, and parts that have none
        stem_of, rest_of = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for k, part in enumerate(parts):
            stem = part.rstrip(",.")
            # A lower-case form may hold a mark that is no letter and belongs to what follows.
            if stem.isalpha() and (stem.isascii() or normalize("NFC", stem).lower().isalpha()):
                # The tokenizer lower-cases; of ASCII letters this is known beforehand.
                stem_of[k] = stems.setdefault(stem.lower() if stem.isascii() else stem, len(stems) + 1)
                rest_of[k] = rest.setdefault(part[len(stem):], len(rest) + 1)
            else:
                rest_of[k] = rest.setdefault(part, len(rest) + 1)
        ids, count = each([" ".join(stems)])
        ends = np.flatnonzero(final[ids]) + 1
        if len(ends) == len(stems):
            count = np.diff(ends, prepend=0)
        else:
            ids, count = each(list(stems))
        more, more_count = each(list(rest))
        count = np.concatenate(([0], count, more_count))  # the first is that of a missing stem
        begin = np.cumsum(count) - count
        both = np.stack((stem_of, np.where(rest_of, rest_of + len(stems), 0)), axis=1).ravel()
        return _stretches(np.concatenate((ids, more)), begin[both], count[both]), count[both].reshape(-1, 2).sum(axis=1)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nonlocal known, table, size
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=known)
        if at.null_count and len(known) > REMEMBERED:  # older ones are forgotten
            known, table, size = none
            at = pc.index_in(coded.dictionary, value_set=known)
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            words = coded.dictionary.take(pa.array(new))
            ids, count = encode_parts(words.to_pylist())
            at[new] = len(known) + np.arange(len(new))
            known, table, size = pa.concat_arrays([known, words]), np.concatenate((table, ids)), np.concatenate((size, count))
        place = at[coded.indices.to_numpy()]
        count = size[place]
        lists = split.offsets.to_numpy()
        return _stretches(table, (np.cumsum(size) - size)[place], count), np.concatenate(([0], np.cumsum(count)))[lists - lists[0]]
    return encode


def pieces(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, the ids themselves of each document's pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(public_tokenizers.path(vocabulary))
        for batch in batches:
            for first, end, _, _ in slices(batch.column(1), SLICE):
                found, offsets = encode(batch.column(1).slice(first, end - first).fill_null(""))
                found = np.insert(found, offsets[1:], END)
                offsets = offsets + np.arange(len(offsets))
                count = -(-np.diff(offsets) // capacity)
                row = np.repeat(np.arange(len(count)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = np.append(offsets[row] + piece * capacity, offsets[-1])
                crc = [zlib.crc32(found[a:b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
                cols = [batch.column(0).take(pa.array(first + row)), pa.array(piece, pa.int32()),
                        pa.array(piece * capacity), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.view("<i4"))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])
        del encode
        pa.default_memory_pool().release_unused()  # workers live on and serve other operators
    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def _fullest(room: int, sizes: list[int], counts: list[int]) -> list[int]:
    """How many of each size fill the room best, with no more of each than its count."""
    # best[k][r]: what the first k sizes can fill exactly; used[k][r]: how many of size k the way there took.
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    taken = []
    for size, count in zip(sizes, counts, strict=True):
        used = np.where(reach, 0, -1)
        if 0 < size <= room:
            for _ in range(min(count, room // size)):
                more = np.zeros(room + 1, np.int64) - 1
                more[size:] = used[:-size]
                new = (used < 0) & (more >= 0)
                if not new.any():
                    break
                used[new] = more[new] + 1
        taken.append(used)
        reach = used >= 0
    at, out = int(np.flatnonzero(reach)[-1]), [0] * len(sizes)
    for k in range(len(sizes) - 1, -1, -1):
        out[k] = int(taken[k][at])
        at -= out[k] * sizes[k]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, ...]], int]:
    """Runs (length, first number, how many, first sequence, pieces a sequence, offset), and the number of sequences.

    Piece number first + k of that length stands in sequence `first sequence + k // per`, at `offset + k % per * length`.
    """
    left = {x: n for x, n in histogram.items() if n}
    given = dict.fromkeys(left, 0)
    runs: list[tuple[int, ...]] = []
    sequences = 0
    open_: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
    rooms: list[int] = []

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, count))

    # 1. groups of equal cardinality, longest first; whole ones fill a sequence alone
    if capacity in left:
        runs.append((capacity, 0, left[capacity], sequences, 1, 0))
        sequences += left.pop(capacity)
    large = sorted((x for x in left if x > capacity // 8), reverse=True)
    total = sum(left[x] for x in large)
    queues: list[list[list[int]]] = []
    share = max(1, -(-total // groups))
    for x in large:
        n = left.pop(x)
        while n:
            if not queues or sum(c for _, c in queues[-1]) >= share:
                queues.append([])
            taken = min(n, share - sum(c for _, c in queues[-1]))
            queues[-1].append([x, taken])
            n -= taken
    sizes = [q[0][0] for q in queues]
    counts = [sum(c for _, c in q) for q in queues]
    # 2. configurations of the few sizes
    while any(counts):
        main = next(k for k, c in enumerate(counts) if c)
        counts[main] -= 1
        beside = _fullest(capacity - sizes[main], sizes, counts)
        counts[main] += 1
        beside[main] += 1
        times = min(counts[k] // b for k, b in enumerate(beside) if b)
        # 3. actual pieces for each place, in stretches of equal lengths
        places = [k for k, b in enumerate(beside) for _ in range(b)]
        filled: list[list[list[int]]] = []
        for k in places:
            counts[k] -= times
            need, got = times, []
            while need:
                x, c = queues[k][0]
                n = min(c, need)
                got.append([x, n])
                need -= n
                queues[k][0][1] -= n
                if c == n:
                    queues[k].pop(0)
            filled.append(got)
        done = 0
        while done < times:
            n = min(got[0][1] for got in filled)
            offset = 0
            for got in filled:
                x = got[0][0]
                runs.append((x, given[x], n, sequences + done, 1, offset))
                given[x] += n
                offset += x
                got[0][1] -= n
                if not got[0][1]:
                    got.pop(0)
            put(capacity - offset, sequences + done, n)
            done += n
        sequences += times
    # 4. small pieces by best fit
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                per = capacity // x
                count = -(-n // per)
                put(capacity, sequences, count)
                sequences += count
                continue
            room = rooms[at]
            first, count = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            per = room // x
            full = min(count, n // per)
            if full:
                runs.append((x, given[x], full * per, first, per, capacity - room))
                given[x] += full * per
                n -= full * per
                put(room - per * x, first, full)
            if full < count and n and n < per:
                runs.append((x, given[x], n, first + full, n, capacity - room))
                given[x] += n
                put(room - n * x, first + full, 1)
                full, n = full + 1, 0
            put(room, first + full, count - full)
    return runs, sequences


def pack(parts: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows with a length of 1 to capacity, and the sequence_id and offset of each.  All their columns stay."""
    parts = parts.drop("sequence_id", "offset", "_number", "_part", "_before")
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in parts.columns]
    n_parts = max(1, -(-parts.count() // part_rows))
    parts = parts.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(n_parts)))
    counts = parts.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("length", "_part", F.coalesce(F.sum("_n").over(
        Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths must lie in 1 to {capacity}")
    runs = np.array(sorted(plan(histogram, capacity, groups)[0]), np.int64).reshape(-1, 6)
    known = parts.sparkSession.sparkContext.broadcast(runs)  # its size follows the capacity, not the rows
    numbered = parts.withColumn("_number", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)))
    numbered = numbered.join(before, ["length", "_part"]).withColumn("_number", F.col("_before") + F.col("_number") - 1)
    kept = [c for c in parts.columns if c != "_part"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = known.value
        keys = (runs[:, 0] << 48) | runs[:, 1]
        for batch in batches:
            length, number = batch.column(len(kept)).to_numpy(), batch.column(len(kept) + 1).to_numpy()
            run = runs[np.searchsorted(keys, (length << 48) | number, "right") - 1]
            k = number - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:len(kept)] + [pa.array(run[:, 3] + k // run[:, 4]), pa.array(run[:, 5] + k % run[:, 4] * length)],
                names=[*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*kept).schema)
    return numbered.select(*kept, F.col("length").cast("long").alias("_length"), "_number").mapInArrow(
        place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """Tokenize, cut and pack documents: one row for each piece, with its place."""
    return pack(cut(pieces(docs, text, capacity, ids=ids)), capacity)
