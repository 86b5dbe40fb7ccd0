"""Document fingerprints: MinHash under many universal hash permutations of word shingles, in vectorised numpy.

A text's shingles are its runs of five words (fewer words: the whole sequence; none: one empty shingle).  Words are cut at
ASCII white space and A-Z count as a-z.  Permutation i sends a shingle's 64-bit hash x to a_i * x + b_i modulo 2^64 with
a_i odd; the fingerprint holds the top 16 bits of each minimum.  Two fingerprints' likeness is the share of equal
entries, which estimates the Jaccard similarity of the shingle sets.

near_duplicates() joins bands of the fingerprints in Spark and verifies the Jaccard similarity of the shingle sets.  The
texts of a band are compared to one of them; those that stay apart from its component are compared to all others.
neighbours() sets each document beside the next one by descending doc_id, without gathering the table anywhere.

Null texts are empty ones.  Rows of equal doc_id follow each other by text; null doc_ids come last.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import lower_ascii, mix64, slices, span_hashes, window_hashes, word_bounds
from .lines import _meetings as meetings
from .shared import components, cut

SHINGLE, PERMUTATIONS, BANDS, SIMILARITY = 5, 128, 32, 0.8
_BLOCK = 1 << 19


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, np.uint64)


def shingles_of(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles, and where each text's begin; every text has at least one."""
    low = lower_ascii(data)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    starts, ends, first = word_bounds(inside, offsets)
    words = span_hashes(low, starts, ends)
    n = len(offsets) - 1
    count = np.diff(first)
    full = window_hashes(words, size)
    many = np.maximum(count - size + 1, 1)
    begin = np.concatenate(([0], np.cumsum(many)))
    out = np.zeros(int(begin[-1]), np.uint64)
    long_ = np.flatnonzero(count >= size)
    take = np.repeat(first[long_] - np.concatenate(([0], np.cumsum(many[long_])[:-1])), many[long_]) + np.arange(many[long_].sum())
    at = np.repeat(count >= size, many)
    out[at] = full[take]
    for k in np.flatnonzero((count < size) & (count > 0)):
        out[begin[k]] = window_hashes(words[first[k]:first[k + 1]], int(count[k]))[0]
    assert n == len(begin) - 1
    return out, begin


def signatures_of(data: np.ndarray, offsets: np.ndarray, permutations: int = PERMUTATIONS, size: int = SHINGLE) -> np.ndarray:
    """One row of 16-bit minima for each text."""
    x, begin = shingles_of(data, offsets, size)
    a, b = _multipliers(permutations)
    out = np.empty((len(offsets) - 1, permutations), np.uint16)
    held = np.empty_like(x)
    for k in range(permutations):
        np.multiply(x, a[k], out=held)
        np.add(held, b[k], out=held)
        out[:, k] = np.minimum.reduceat(held, begin[:-1]) >> np.uint64(48)
    return out


def _hex(signatures: np.ndarray) -> list[str]:
    width = signatures.shape[1] * 4
    text = np.ascontiguousarray(signatures.astype(">u2")).tobytes().hex()
    return [text[k * width:(k + 1) * width] for k in range(len(signatures))]


def _all_signatures(texts: list[str], permutations: int) -> np.ndarray:
    parts = [signatures_of(data, offsets, permutations) for _, _, data, offsets in slices(pa.array(texts, pa.large_string()), _BLOCK)]
    return np.concatenate(parts) if parts else np.empty((0, permutations), np.uint16)


def neighbours(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (_bucket, _tail, doc_id, text): by these, doc_id descending, each row's next document follows it.

    doc_id is cut into as many ranges as there are shuffle partitions.  A range's last document is followed by the first
    of the range below, which is sent along as a tail row; the lowest range's by the first of all.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = np.unique(np.array(docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else [], np.int64))
    table = spark.sparkContext.broadcast(bounds)  # at most one bound for each partition

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            bucket = np.searchsorted(table.value, ids.fill_null(0).to_numpy(), "left") + 1
            bucket[ids.is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *batch.columns], names=["_bucket", *batch.schema.names])

    tops = docs.select("doc_id").mapInArrow(deal, "_bucket int, doc_id long").groupBy("_bucket").agg(F.max("doc_id")).orderBy("_bucket").collect()
    dealt = docs.mapInArrow(deal, "_bucket int, doc_id long, text string")
    if not tops:
        return dealt.withColumn("_tail", F.lit(False))
    # The first of a range also ends the range above it, the first of all the lowest one.
    above = {low[0]: high[0] for low, high in zip(tops, tops[1:], strict=False)} | {tops[-1][0]: tops[0][0]}
    first = {b: top for b, top in tops}
    send = F.create_map(*[F.lit(x) for b in above for x in (b, above[b])])
    top = F.create_map(*[F.lit(x).cast("long") for b in first for x in (b, first[b])])
    also = F.col("doc_id").eqNullSafe(top[F.col("_bucket").cast("long")])
    return dealt.withColumn("_to", F.when(also, F.array(
        F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("t")), F.struct(send[F.col("_bucket")].alias("b"), F.lit(True).alias("t"))))
        .otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("t"))))).select(
        F.explode("_to").alias("_to"), "doc_id", "text").select("_to.b", "_to.t", "doc_id", "text").toDF("_bucket", "_tail", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame, text: str = "text", permutations: int = PERMUTATIONS) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness to each other and to the next document's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids, texts, changed):
            """texts: one more than ids, as the last is the next of the last one."""
            own, other = _all_signatures(texts, permutations), _all_signatures(changed, permutations)
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(_hex(own[:-1])), pa.array(_hex(other)),
                pa.array((own[:-1] == other).mean(axis=1)), pa.array((own[:-1] == own[1:]).mean(axis=1))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        ids, texts, changed, size, bucket = [], [], [], 0, None
        for batch in batches:
            for b, tail, doc, text_ in zip(*batch.columns, strict=True):
                b = b.as_py()
                if b == bucket is not None and not len(texts):
                    continue  # further tails of a range that is done
                value = text_.as_py()
                if len(texts):
                    changed.append(edited(texts[-1], value))
                texts.append(value)
                size += len(value)
                bucket = b
                if tail.as_py():
                    yield out(ids, texts, changed)
                    ids, texts, changed, size = [], [], [], 0
                    continue
                if size > _BLOCK and len(ids):
                    yield out(ids, texts, changed)
                    ids, texts, changed, size = [], [value], [], len(value)
                ids.append(doc.as_py())
        assert not ids

    rows = neighbours(docs, text).repartition("_bucket").sortWithinPartitions("_bucket", "_tail", F.desc_nulls_last("doc_id"), "text")
    return rows.select("_bucket", "_tail", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
             "near_next double")


def _distinct(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and their distinct shingles, both ascending."""
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    own = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))[:len(h)]
    return text[own], h[own]


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(1), _BLOCK):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first),
                                              pa.array(span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64)),
                                              batch.column(1).slice(first, end - first)], names=["doc_id", "id", "text"])


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(1), _BLOCK):
            ids, at, n = np.unique(batch.column(0).slice(first, end - first).to_numpy(), return_index=True, return_counts=True)
            rows = signatures_of(data, offsets)[at].reshape(len(at), BANDS, -1).astype(np.uint64)
            key = np.zeros(rows.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for k in range(rows.shape[2]):
                key = mix64(key * np.uint64(0x9FB21C651E98DF25) + rows[:, :, k])
            size = np.bincount(_distinct(*shingles_of(data, offsets))[0], minlength=end - first)[at]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(-n, BANDS)), pa.array(np.repeat(ids, BANDS)),
                                              pa.array(np.repeat(size, BANDS).astype(np.int32))], names=["key", "rank", "id", "size"])


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                rows = batch.slice(first, 64)
                sides = [_distinct(*shingles_of(data, offsets)) for c in (2, 3) for _, _, data, offsets in slices(rows.column(c), 1 << 62)]
                pair, h = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
                order = np.lexsort((h, pair))
                pair, h = pair[order], h[order]
                both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=rows.num_rows)
                good = pa.array(np.flatnonzero(both >= similarity * (np.bincount(pair, minlength=rows.num_rows) - both)))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(good), rows.column(1).take(good)], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id, the smallest doc_id reachable over pairs of texts whose shingle sets are similar enough."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = docs.mapInArrow(_identities, "doc_id long, id long, text string")
    keys = known.select("id", "text").mapInArrow(_band_keys, "key long, rank long, id long, size int")
    met = cut(keys.repartition("key").sortWithinPartitions("key", "rank", "id").mapInArrow(
        meetings, "key long, id long, size int, centre long").distinct())

    def similar(pairs: DataFrame) -> DataFrame:
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        texts = known.select("id", "text").join(wanted, "id", "left_semi").dropDuplicates(["id"])
        both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
        return cut(both.select("a", "b", "x", "y").mapInArrow(_verify(similarity), "a long, b long"))

    def pair(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    edges = similar(cut(met.where("id <> centre").select(*pair("id", "centre")).distinct()))
    roots = components(edges)
    named = met.join(roots.toDF("id", "r"), "id", "left").join(roots.toDF("centre", "c"), "centre", "left")
    named = named.select("key", "id", "size", F.coalesce("r", "id").alias("r"), F.coalesce("c", "centre").alias("c"))
    x, y = named.where("r <> c").alias("x"), named.alias("y")
    near = F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size")
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.r") != F.col("y.r")) & near)
    more = cut(more.select(F.col("x.id").alias("p"), F.col("y.id").alias("q")).select(*pair("p", "q")).distinct())
    roots = components(edges.union(similar(more)))
    classes = known.groupBy("id").agg(F.min("doc_id").alias("least")).join(roots.toDF("id", "root"), "id", "left")
    classes = classes.withColumn("root", F.coalesce("root", "id"))
    least = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    return known.select("doc_id", "id").join(classes.join(least, "root").select("id", "class_id"), "id").select("doc_id", "class_id")
