"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a bounded run of documents of one partition.  Its words, as numbers of the benchmark's vocabulary, are
indexed: suffix order, its last column in a wavelet tree, and sampled suffix positions.  The benchmark's phrases are
found by backward search, all at once; occurrences are located by walking to a sampled position; overlapping ones are
merged to removal spans.  Words that no phrase has only separate the indexed runs.  Nothing is shuffled.

The phrases are a query set: they go to the tasks in blocks of at most `block_words` words, and each further block adds
to what the earlier ones found, whatever the size of the benchmark.

Nulls, empty texts and texts without words have no windows and are never hit.  Repeated rows are judged each on its own.
Extra columns pass through; a result column replaces an input column of the same name.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import lower_ascii, slices, span_hashes, word_bounds

WINDOW = 13
BLOCK_WORDS = 1_000_000
SAMPLE = 8

_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("_item", T.ArrayType(T.LongType())),
    T.StructField("_start", T.ArrayType(T.LongType())), T.StructField("_end", T.ArrayType(T.LongType()))])


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Word hashes, their starts and ends in bytes, and each text's first word.  Words: 0-9, a-z and all beyond ASCII."""
    low = lower_ascii(data)
    inside = (low >= 128) | ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122))
    starts, ends, first = word_bounds(inside, offsets)
    return span_hashes(low, starts, ends), starts, ends, first


class Phrases:
    """Distinct windows of benchmark items over a small vocabulary, and the items that have each."""

    def __init__(self, items: list[int], texts: list[str], window: int):
        column = pa.array(texts, pa.large_string())
        lists, owners = [], []
        for first, end, data, offsets in slices(column):
            h, _, _, start = words_of(data, offsets)
            for k in range(end - first):
                lists.append(h[start[k]:start[k + 1]])
                owners.append(items[first + k])
        self.vocabulary = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
        rows: dict[bytes, set[int]] = {}
        for words, item in zip(lists, owners, strict=True):
            if not len(words):
                continue
            ids = (np.searchsorted(self.vocabulary, words) + 1).astype(np.int32)
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1):
                rows.setdefault(ids[k:k + size].tobytes(), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({len(x) // 4 for x in rows}):
            keys = [x for x in rows if len(x) == 4 * size]
            counts = np.array([len(rows[x]) for x in keys], np.int64)
            self.by_length[size] = (np.frombuffer(b"".join(keys), np.int32).reshape(-1, size),
                                    np.concatenate(([0], np.cumsum(counts))),
                                    np.array([i for x in keys for i in sorted(rows[x])], np.int64))

    def __bool__(self) -> bool:
        return bool(self.by_length)


class FmIndex:
    """Backward search and location over runs of symbols 1.., each run after a separator 0.

    A separator is smaller than any symbol and differs from every other, so that no occurrence crosses it.
    """

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        top = int(text.max(initial=0))
        order = self._suffixes(text)
        last = text[order - 1]  # the suffix at 0 is preceded by the last symbol, as if the text were a ring
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 2)))).astype(np.int64)
        self.levels = []
        for shift in range(max(1, top.bit_length()) - 1, -1, -1):
            bit = ((last >> shift) & 1).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, ones, n - int(ones[-1])))
            last = np.concatenate((last[~bit], last[bit]))
        self.text_last = text[order - 1]
        self.marked = (order % SAMPLE == 0) | (self.text_last == 0)  # a run's first symbol ends every walk
        self.rank_marked = np.concatenate(([0], np.cumsum(self.marked))).astype(np.int64)
        self.samples = order[self.marked]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        n = len(text)
        gaps = text == 0
        rank = text.astype(np.int64) + int(gaps.sum())
        rank[gaps] = np.arange(int(gaps.sum()))
        step = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[:-step] = rank[step:] + 1 if step < n else 0
            key = rank * (int(rank.max()) + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank = new
            if rank[order[-1]] == n - 1 or step >= n:
                return order
            step *= 2

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before a place of the last column."""
        low, high = np.zeros(len(at), np.int64), at
        for shift, ones, zeros in self.levels:
            bit = (symbol >> shift) & 1 == 1
            a, b = ones[low], ones[high]
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all phrases of one length: those that occur, with the first and end row of their suffixes."""
        alive = np.flatnonzero(phrases.max(axis=1) < len(self.below) - 1)
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k].astype(np.int64)
            base = self.below[symbol]
            low, high = base + self.rank(symbol, low), base + self.rank(symbol, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of rows of the suffix order."""
        out, left, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(left):
            done = self.marked[rows]
            out[left[done]] = self.samples[self.rank_marked[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            symbol = self.text_last[rows].astype(np.int64)
            rows = self.below[symbol] + self.rank(symbol, rows)
            steps += 1
        return out


def hits(words: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a shard: (first word, end word) of each, and distinct pairs (text, item)."""
    none = np.zeros(0, np.int64)
    if not len(words) or not phrases:
        return none, none, none, none
    found = np.minimum(np.searchsorted(phrases.vocabulary, words), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[found] == words
    edge = np.zeros(len(words) + 1, bool)
    edge[first] = True
    starts, ends, _ = _runs(known, edge)
    long_enough = ends - starts >= min(phrases.by_length)
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts):
        return none, none, none, none
    size = ends - starts + 1
    place = np.repeat(starts - 1 - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    text = np.zeros(len(place), np.int32)
    inner = np.ones(len(place), bool)
    inner[np.concatenate(([0], np.cumsum(size)[:-1]))] = False
    text[inner] = found[place[inner]] + 1
    index = FmIndex(text)
    begin, stop, docs, items = [], [], [], []
    for length, (grams, at, owners) in phrases.by_length.items():
        which, low, high = index.search(grams)
        count = high - low
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        where = place[index.locate(rows)]
        begin.append(where)
        stop.append(where + length)
        doc = np.searchsorted(first, where, "right") - 1
        pairs = np.unique(doc * len(grams) + np.repeat(which, count))
        doc, gram = pairs // len(grams), pairs % len(grams)
        many = at[gram + 1] - at[gram]
        docs.append(np.repeat(doc, many))
        items.append(owners[np.repeat(at[gram] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())])
    pairs = np.unique(np.stack((np.concatenate(docs), np.concatenate(items))), axis=1)
    return np.concatenate(begin), np.concatenate(stop), pairs[0], pairs[1]


def _runs(inside: np.ndarray, edge: np.ndarray):
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1, None


def _ragged(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """Values with ascending row numbers as one list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(values, pa.int64()))


def _scan(phrases_of, again: bool, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = phrases_of.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            for first, end, data, offsets in slices(texts):
                words, _, _, start = words_of(data, offsets)
                begin, stop, doc, item = hits(words, start, phrases)
                part = batch.slice(first, end - first)
                old = {}
                if again:
                    for name in ("_item", "_start", "_end"):
                        col = part.column(part.schema.get_field_index(name))
                        old[name] = (col.flatten().to_numpy(), np.repeat(np.arange(len(col)), col.value_lengths().to_numpy()))
                    begin = np.concatenate((begin, old["_start"][0] + start[old["_start"][1]]))
                    stop = np.concatenate((stop, old["_end"][0] + start[old["_end"][1]]))
                    doc, item = np.concatenate((doc, old["_item"][1])), np.concatenate((item, old["_item"][0]))
                    order = np.lexsort((item, doc))
                    doc, item = doc[order], item[order]
                # Merged spans of words, none across a text's edge.
                level = np.zeros(len(words) + 1, np.int64)
                np.add.at(level, begin, 1)
                np.add.at(level, stop, -1)
                edge = np.zeros(len(words) + 1, bool)
                edge[start] = True
                lo, hi, _ = _runs(np.cumsum(level)[:-1] > 0, edge)
                row = np.searchsorted(start, lo, "right") - 1
                kept = [(f, part.column(i)) for i, f in enumerate(part.schema) if f.name not in _FOUND.fieldNames()]
                yield pa.RecordBatch.from_arrays(
                    [c for _, c in kept] + [pa.array(np.diff(start), pa.int64()), _ragged(item, doc, end - first),
                                            _ragged(lo - start[row], row, end - first), _ragged(hi - start[row], row, end - first)],
                    names=[f.name for f, _ in kept] + _FOUND.fieldNames())
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents with n_words, n_hit, items (distinct item_id, sorted), spans and contaminated.

    spans are maximal runs of hit words, numbered from 0 with the end exclusive.  contaminated: at least one word in
    twenty is hit.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "items", "spans", "contaminated", "_item", "_start", "_end")
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    total = items.agg(F.sum(F.ceil(F.length("text") / 2) + 1)).first()[0] or 0  # a bound on the words
    blocks = max(1, -(-int(total) // block_words))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # a bounded block of the query set
        phrases = spark.sparkContext.broadcast(Phrases([r[0] for r in rows], [r[1] for r in rows], window))
        schema = T.StructType([f for f in docs.schema if f.name not in _FOUND.fieldNames()] + list(_FOUND))
        docs = docs.mapInArrow(_scan(phrases, k > 0, text), schema)
    hit = F.aggregate(F.zip_with("_start", "_end", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    return docs.withColumn("n_hit", hit).select(
        *[c for c in docs.columns if c not in ("_item", "_start", "_end")], "n_hit", F.col("_item").alias("items"),
        F.arrays_zip(F.col("_start").alias("start"), F.col("_end").alias("end")).alias("spans"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
