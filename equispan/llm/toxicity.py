"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (4 to 6 UTF-8 bytes of the lower-cased text, runs of other signs folded to one
space), hashed to 2^20 numbers.  Spark counts in how many toxic and other texts each occurs, over all labelled documents;
the log of the ratio of the smoothed shares is the scale of the feature.  The features that tell most are kept, and a
logistic regression is fitted on their scaled values.  Scoring takes whole texts, slice by slice, in one pass without a
shuffle.

Only the regression is fitted on a sample: at most `max_rows` labelled rows, those whose doc_id and text hash lowest, equal
rows once.
Nulls and empty texts score what the intercept says.  If one of the two classes is missing, every score is the share of
toxic rows.  Repeated labels of a document count as toxic if one of them is.  Documents that share a doc_id are labelled
alike and each counts.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import lower_ascii, slices, sorted_distinct
from .shared import cut, written

SIZES, BUCKET_BITS, FEATURES, MAX_ROWS, THRESHOLD = (4, 5, 6), 20, 1 << 14, 20_000, 0.7
PENALTY, STEPS = 2e-4, 300
#: Bits of the filter of labelled doc_ids: 4 MB sent to each task, whatever the number of labels.
FILTER_BITS = 25
#: Bytes of text whose n-grams are held at once; each byte takes over a hundred while they are told apart.
SLICE_BYTES = 1 << 19


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the feature number of the n-gram at each byte and the text it lies in; none crosses an edge."""
    low = lower_ascii(data)
    word = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first sign after a word stands for all that follow
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    keep |= word | edge[:-1]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
    # A space before each text lets its first word begin like any other.
    signs = np.where(word, low, 32)[keep].astype(np.uint32)
    first = np.searchsorted(text, np.arange(len(offsets) - 1))
    signs, text = np.insert(signs, first, 32), np.insert(text, first, np.arange(len(offsets) - 1))
    h = np.zeros(len(signs), np.uint32)
    for size in range(1, max(SIZES) + 1):
        n = len(signs) - size + 1
        if n <= 0:
            return
        h = h[:n] * np.uint32(0x01000193) ^ (signs[size - 1:] * np.uint32(0x9E3779B1))
        h ^= h >> np.uint32(15)
        if size in SIZES:
            whole = text[:n] == text[size - 1:]
            code = (h ^ np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
            yield (code >> np.uint32(32 - BUCKET_BITS))[whole].astype(np.int64), text[:n][whole]


def _distinct(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text, feature), of the wanted features only."""
    found = []
    for feature, text in _grams(data, offsets):
        if wanted is not None:
            some = wanted[feature]
            feature, text = feature[some], text[some]
        found.append(text << BUCKET_BITS | feature)
    pairs = sorted_distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for first, end, data, offsets in slices(batch.column(0), SLICE_BYTES):
            row, feature = _distinct(data, offsets)
            for kind in (0, 1):
                counts[kind] += np.bincount(feature[toxic[first:end][row] == kind], minlength=1 << BUCKET_BITS)
    some = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[1, some]), pa.array(counts[0, some])],
                                     names=["feature", "p", "q"])


def _logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by Adam steps on the whole sparse matrix."""
    # A sample may hold one class only.
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w, bias = np.zeros(width), float(np.log(share / (1 - share)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[column], len(y)) + bias, -30, 30)))
        error = (p - y) / len(y)
        g = np.append(np.bincount(column, value * error[row], width) + PENALTY * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def labelled_texts(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(_text, toxic, _key) of all documents that have a label; written, as counts and sample both read it.

    Which documents have one is told by a bitmap of 2^FILTER_BITS bits before any text moves; a full one lets all pass."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - FILTER_BITS)
    bits = known.select(place.alias("p")).selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, cast(p & 63 AS int)) AS b")
    found = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bitmap[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).fill_null(0).to_numpy().view(np.uint64)
            hit = (sent.value[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            yield batch.filter(pa.array(hit))

    likely = docs.select("doc_id", F.col(text).alias("_text"), place.alias("_place"))
    likely = likely.mapInArrow(run, likely.schema).drop("_place")
    return written(likely.join(known, "doc_id").select("_text", "toxic", F.xxhash64("doc_id", "_text").alias("_key")))


def feature_counts(labelled: DataFrame) -> DataFrame:
    """(feature, p, q): in how many toxic and other texts each feature occurs."""
    counts = labelled.select("_text", "toxic").mapInArrow(_count, "feature long, p long, q long")
    return counts.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def fit_sample(labelled: DataFrame, max_rows: int) -> DataFrame:
    """At most max_rows labelled rows, the same ones each time; equal rows count once."""
    keys = cut(labelled.select("_key").distinct().orderBy("_key").limit(max_rows))
    # Dealt by key: a limit would bring all texts into one task.
    return cut(labelled.join(F.broadcast(keys), "_key", "left_semi").dropDuplicates(["_key"]).select("_text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights of all features and, last, the intercept; learnt from documents that have a label (doc_id, toxic)."""
    spark = docs.sparkSession
    labelled = labelled_texts(docs, labels, text)
    n_toxic, n = labelled.agg(F.sum("toxic"), F.count("*")).first()
    out = np.zeros((1 << BUCKET_BITS) + 1, np.float32)
    if not n_toxic or n_toxic == n:
        share = (n_toxic or 0) / max(n, 1)
        out[-1] = np.clip(np.log(share + 1e-9) - np.log(1 - share + 1e-9), -15, 15)
        return out
    ratio = F.log((F.col("p") + 1) / F.lit(n_toxic + 2.0)) - F.log((F.col("q") + 1) / F.lit(n - n_toxic + 2.0))
    tells = F.abs("r") / F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))
    kept = (feature_counts(labelled).where("p + q >= 3")
            .select("feature", ratio.alias("r"), "p", "q")
            .orderBy(tells.desc(), "feature").limit(FEATURES).select("feature", "r").orderBy("feature").collect())
    feature = np.array([r[0] for r in kept], np.int64)
    scale = np.array([r[1] for r in kept])
    chosen = spark.sparkContext.broadcast(feature)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BUCKET_BITS, bool)
        wanted[chosen.value] = True
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(0), SLICE_BYTES):
                row, found = _distinct(data, offsets, wanted)
                at = np.searchsorted(row, np.arange(end - first + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.searchsorted(chosen.value, found), pa.int32())),
                     batch.column(1).slice(first, end - first)], names=["features", "toxic"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, sizes, toxic = [], [], []
        for batch in batches:
            columns.append(batch.column(0).flatten().to_numpy())
            sizes.append(batch.column(0).value_lengths().to_numpy())
            toxic.append(batch.column(1).to_numpy())
        size = np.concatenate(sizes)
        column = np.concatenate(columns)
        w, bias = _logistic(np.repeat(np.arange(len(size)), size), column, scale[column],
                            np.concatenate(toxic).astype(float), len(scale))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(w * scale, bias))], names=["w"])

    # One task learns: its rows are bounded by max_rows and FEATURES.
    train = fit_sample(labelled, max_rows)
    learnt = np.array([r[0] for r in train.mapInArrow(rows, "features array<int>, toxic int")
                       .repartition(1).sortWithinPartitions("toxic", "features").mapInArrow(learn, "w double").collect()])
    out[feature], out[-1] = learnt[:-1], learnt[-1]
    return out


def score(docs: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """Documents with score in 0 to 1; all their columns stay, but for one named score."""
    docs = docs.drop("score")
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        wanted = w[:-1] != 0
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(batch.schema.get_field_index(text)), SLICE_BYTES):
                row, feature = _distinct(data, offsets, wanted)
                z = np.bincount(row, w[feature], end - first) + w[-1]
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                                                 names=part.schema.names + ["score"])
    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("score", T.DoubleType())]))


def in_training(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: those whose remainder is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD,
                   max_rows: int = MAX_ROWS, learn_from: DataFrame | None = None) -> DataFrame:
    """Documents with held_out, score and predicted, learnt from the labels outside the held-out third.

    learn_from: documents to learn from, if others than those to score.
    """
    model = fit(docs if learn_from is None else learn_from, labels.where(in_training(F.col("doc_id"))), text, max_rows)
    return score(docs.drop("held_out", "predicted"), model, text).withColumns({
        "held_out": F.coalesce(~in_training(F.col("doc_id")), F.lit(False)),
        "predicted": (F.col("score") >= threshold).cast("int")})
