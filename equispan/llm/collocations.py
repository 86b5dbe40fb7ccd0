"""Phrase collocations by partitioned mining (SON): phrases of up to four words, counted and scored exactly by language.

Documents are dealt to `shards` shards.  A phrase with `support` occurrences has at least support / shards of them in one
shard, so every shard is mined completely at that lower support and the union of what is frequent somewhere misses nothing.
A shard is mined level by level by all tasks together: first words and pairs of words, then the longer phrases all of whose
pairs are frequent in the shard.  Mining counts 64-bit hashes, where a collision can only add a candidate.  Then all
candidates, and only they, are counted over the whole corpus as text, which is exact.

What is frequent goes to the next pass as a bitmap of 2^`bits` bits, whatever the corpus; a full bitmap costs work but
changes no result.  Texts are read in slices of a few MB, counts are combined before each shuffle, and a frequent phrase
is one row for each slice.  A language's best phrases are ranked in parts first.

Texts are lower-cased (A-Z), split at marks and line ends into pieces and at spaces and tabs into words.  Nulls and empty
texts have no words, a null language is `und` and one with the rows that say so.  Repeated rows count each time.  Ties in
score go by count, then by the phrase's bytes.  An empty table has no phrases.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import lower_ascii, mix64, slices, span_hashes, word_bounds
from .shared import written

SUPPORT, WORDS, TOP, COVER = 30, 4, 2000, 80
SHARDS, BITS = 4, 27
#: Scores are whole numbers: 2 * SCALE times a share.
SCALE = 1_000_000
#: Hashes held before they are counted and handed on; parts of a language ranked on their own first.
HELD, PARTS = 3 << 19, 32
#: Bytes of text whose words are held at once.
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
#: Low bits of a hash that hold the shard instead.
_SHARD = np.uint64(15)
_STEP, _OTHER = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """The words of some texts: bytes joined by single spaces, where each begins, its length, row and hash."""
    joined: np.ndarray
    at: np.ndarray
    length: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    #: Whether the next word follows in the same piece.
    follows: np.ndarray

    def long_enough(self, size: int) -> np.ndarray:
        """First words of all phrases of `size` words."""
        n = len(self.at) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        whole = np.ones(n, bool)
        for k in range(size - 1):
            whole &= self.follows[k:k + n]
        return np.flatnonzero(whole)

    def phrases(self, first: np.ndarray, size: int, seed: np.ndarray, step: np.uint64 = _STEP) -> np.ndarray:
        """A hash of each phrase of `size` words from `first`, its row's seed included."""
        out = seed[self.row[first]]
        for k in range(size):
            out = out * step + self.hashes[first + k]
        return mix64(out)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = lower_ascii(data)
    mark = np.zeros(256, bool)
    mark[[*b".,;:!?", *range(10, 14)]] = True
    cut = mark[low]
    inside = ~(cut | (low == 32) | (low == 9))
    starts, ends, first = word_bounds(inside, offsets)
    length = ends - starts
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    piece = np.cumsum(cut)[starts] if len(starts) else starts
    follows = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    at = np.cumsum(length + 1) - length - 1
    joined = np.full(int((length + 1).sum()), 32, np.uint8)
    joined[np.repeat(at - starts, length) + np.flatnonzero(inside)] = low[inside]
    return Words(joined, at, length, row, span_hashes(low, starts, ends), follows)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Words, language seeds and shards by row, and the rows of each slice of batches (lang, text, shard)."""
    for batch in batches:
        for first, end, data, offsets in slices(batch.column("text"), SLICE_BYTES):
            rows = batch.slice(first, end - first)
            lang = rows.column("lang").dictionary_encode()
            seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in lang.dictionary.to_pylist()], np.uint64)
            yield words_of(data, offsets), seeds[lang.indices.to_numpy()], rows.column("shard").to_numpy().astype(np.uint64), rows


def _counted(keys: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def counts() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    for k in keys:
        held.append(k)
        if sum(map(len, held)) >= HELD:
            yield counts()
    if held:
        yield counts()


def _shard_key(h: np.ndarray, shard: np.ndarray) -> np.ndarray:
    return (h & ~_SHARD) | shard


def _place(key: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a key: its high bits, stirred by its shard."""
    return (key >> np.uint64(64 - bits)) ^ ((key & _SHARD) << np.uint64(bits - 4))


def _test(bitmap: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    place = _place(key, bits)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits of all keys, gathered as words of 64: 2^bits / 8 bytes whatever the number of keys."""
    key = F.col("key")
    place = F.shiftrightunsigned(key, 64 - bits).bitwiseXOR(F.shiftleft(key.bitwiseAND(F.lit(15)), bits - 4))
    word = keys.withColumn("p", place).selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, cast(p & 63 AS int)) AS b")
    found = word.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and pairs of words of each shard."""
    def keys() -> Iterator[np.ndarray]:
        for words, seed, shard, _ in _read(batches):
            for size in (1, 2):
                first = words.long_enough(size)
                yield _shard_key(words.phrases(first, size, seed), shard[words.row[first]])
    return _counted(keys())


def _long(pairs, bits: int, most: int):
    """Counts of longer phrases all of whose pairs are frequent in the shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[np.ndarray]:
            for words, seed, shard, _ in _read(batches):
                first = words.long_enough(2)
                good = np.zeros(len(words.at), bool)
                good[first] = _test(pairs.value, _shard_key(words.phrases(first, 2, seed), shard[words.row[first]]), bits)
                for size in range(3, most + 1):
                    first = words.long_enough(size)
                    for k in range(size - 1):
                        first = first[good[first + k]]
                    yield _shard_key(words.phrases(first, size, seed), shard[words.row[first]])
        return _counted(keys())
    return run


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Strings of spans of bytes."""
    length = end - start
    offsets = np.concatenate(([0], np.cumsum(length)))
    at = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at].tobytes())).cast(pa.string())


def _count(candidates, bits: int, most: int):
    """(lang, phrase, n) of candidates, and of all words as a null phrase."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, seed, _, rows in _read(batches):
            lang = rows.column("lang")
            total = np.bincount(words.row, minlength=rows.num_rows)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(some)), pa.nulls(len(some), pa.string()), pa.array(total[some])],
                                             names=["lang", "phrase", "n"])
            for size in range(1, most + 1):
                first = words.long_enough(size)
                h = words.phrases(first, size, seed)
                good = _test(candidates.value, h & ~_SHARD, bits)
                first, h = first[good], h[good]
                order = np.argsort(h, kind="stable")
                first, h = first[order], h[order]
                # A second hash keeps phrases apart whose first ones are equal.
                other = words.phrases(first, size, seed, _OTHER)
                begin = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (other[1:] != other[:-1])))) if len(h) else first
                n = np.diff(np.concatenate((begin, [len(h)])))
                one = first[begin]
                last = one + size - 1
                yield pa.RecordBatch.from_arrays(
                    [lang.take(pa.array(words.row[one])), _spans(words.joined, words.at[one], words.at[last] + words.length[last]), pa.array(n)],
                    names=["lang", "phrase", "n"])
    return run


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, most: int = WORDS, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(lang, phrase, n) of all phrases of up to `most` words that occur `support` times or more; a null phrase has all words."""
    if not 1 <= shards <= 16:
        raise ValueError("1 to 16 shards")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"),
                       F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"))
    local = -(-support // shards)

    def mined(run) -> DataFrame:
        counts = rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        return written(counts.where(F.col("n") >= local).select("key"))

    spread = docs.sparkSession.sparkContext.broadcast
    short = mined(_short)
    pairs = spread(_bitmap(short, bits))
    long = mined(_long(pairs, bits, most))
    pairs.unpersist()
    union = short.union(long).select(F.col("key").bitwiseAND(F.lit(-16)).alias("key"))
    candidates = spread(_bitmap(union, bits))
    counts = rows.mapInArrow(_count(candidates, bits, most), "lang string, phrase string, n long")
    counts = counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return written(counts.where(F.col("phrase").isNull() | (F.col("n") >= support)))


def _joined(words: Column, first, size) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, support: int = SUPPORT, most: int = WORDS, top: int = TOP, cover: int = COVER,
                 shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best `top` phrases of each language.

    Each phrase has the score 2 a / (l + r) of its weakest cut into two parts that occur l and r times, in millionths and
    rounded down.  Phrases within a longer one that has at least `cover` hundredths of their occurrences are left out.
    """
    counts = frequent_phrases(docs, support, most, shards, bits)
    totals = counts.where("phrase is null").select("lang", "n")
    single = counts.where("phrase is not null").select("lang", "phrase", F.col("n").alias("a"))
    phrases = single.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w")).where("k > 1")

    wide = phrases.where("k > 2").select("lang", "a", "k", "w", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    within = wide.select("lang", "a", F.explode(F.expr(
        "transform(sequence(1, k - size + 1), i -> array_join(slice(w, i, size), ' '))")).alias("phrase"))
    longest = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    exact = "cast({} AS decimal(20, 0))"
    covered = F.expr(f"{exact.format('longer')} * 100 >= {exact.format('a')} * {cover}")
    kept = phrases.join(longest, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))

    cuts = kept.select("lang", "phrase", "a", "w", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined(F.col("w"), 1, F.col("cut")).alias("first"),
                       _joined(F.col("w"), F.col("cut") + 1, F.col("k")).alias("rest"))
    part = single.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    cuts = cuts.join(part, ["lang", "first"]).join(part.toDF("lang", "rest", "r"), ["lang", "rest"])
    score = F.expr(f"({exact.format('a')} * {2 * SCALE}) div ({exact.format('l')} + {exact.format('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min_by(F.struct("score", "l", "r"), F.struct("score", "cut")).alias("s")).select("lang", "phrase", "a", "s.*")

    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ahead = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    ahead = ahead.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("_n") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB's form of the query over documents.
SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
    SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM spots, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, phrase, k, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE a >= 30),
sizes AS (SELECT o.*, unnest(range(2, k)) AS size FROM often o WHERE k > 2),
within AS (SELECT lang, a, size, w, unnest(range(1, k - size + 2)) AS i FROM sizes),
longest AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer FROM within GROUP BY ALL),
kept AS (
    SELECT o.* FROM often o LEFT JOIN longest x ON o.lang = x.lang AND o.phrase = x.phrase
    WHERE k > 1 AND (longer IS NULL OR longer::HUGEINT * 100 < a::HUGEINT * 80)),
cuts AS (SELECT kept.*, unnest(range(1, k)) AS cut FROM kept),
scored AS (
    SELECT c.lang, c.phrase, c.a, cut, f.a AS l, r.a AS r, ((c.a::HUGEINT * 2000000) // (f.a + r.a))::BIGINT AS score
    FROM cuts c JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(c.w[1:cut], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:c.k], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
