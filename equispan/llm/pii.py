"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.  DataFrame functions only.

Base spans are the leftmost non-overlapping matches of each kind that pass its test (parts of an address at most 255,
Luhn's sum, number of digits).  The expressions find what the plain patterns find, but never scan a run of signs twice:
`\\G` and a look-behind let a match begin only where a run begins or the last match ended.

Bootstrapping: tokens with digits or `@` are instances; the two words before a token are one pattern of it, these
words and its shape another, so trust carries over to values of other forms.
Instances that a base test accepts are the seeds.  On the graph of patterns and distinct instances Spark scores in turn:
a pattern's confidence is the mean score of its instances, an instance's score is one minus the product of its patterns'
doubts, and seeds stay at one.  Patterns with at least `support` distinct seeds and a confidence of `confidence` discover
their other instances, whose spans get the kind `id`.

Long texts are cut into pieces where no match can stand on both sides: behind a sign that is in none of the expressions,
or between a space and a sign that no phone number or card holds.  A stretch without such a place is one piece.  So the time
follows the length, and the results are those of whole texts.

A null text is an empty one.  Rows of equal doc_id and text get the same result, each on its own row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.8, 3
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Single separators between digits are marked first; a card is then one run of signs.
JOINT, CARD = r"(?<=[0-9])[\x20-](?=[0-9])", "[0-9][0-9\x01]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Leading zeros are passed at once; a part of zeros only has nothing after them.
_PART = r"(?=[0-9])0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)"
_TOKEN = "A-Za-z0-9@._%+-"
#: A phone number or a token of six signs or more with a digit or `@`, at the beginning of a token.
INSTANCE = rf"(?<![{_TOKEN}])(?:\+[0-9][\x20().0-9-]{{6,20}}[0-9]|(?=[A-Za-z._%+-]*+[0-9@])[{_TOKEN}]{{6,}}+)"
_PIECE = 256
#: Code points beyond which a text is cut, the least length of a piece, and where one may end.
LONG, CUT = 8192, 4096
_PIECES = rf"(?s).{{{CUT},}}?(?:(?<=[^\x20(){_TOKEN}])|(?<=\x20)(?=[^\x20().0-9-]))|.+"
_CONTEXT = 48


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Luhn's test of a string of 13 to 19 digits."""
    d = _digits(x)
    n = F.length(d)

    def term(i: Column) -> Column:
        v = F.substr(d, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return v - F.when(v > 9, 9).otherwise(0)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0), lambda a, b: a + b)
    return n.between(13, 19) & F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


#: For each kind the expression, what a text must contain at all, and the test of a match.
TESTS = {
    "email": (EMAIL, "@", lambda x: F.lit(True)),
    "ip": (IP, ".", lambda x: F.rlike(x, F.lit(rf"^(?:{_PART}\.){{3}}{_PART}$"))),
    "card": (CARD, "", _luhn),
    "phone": (PHONE, "+", lambda x: F.length(_digits(x)).between(9, 15)),
}


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once: the single-row Generate keeps the optimizer from copying their expressions."""
    names = list(columns)
    one = df.withColumn("_v", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return one.select(*[c for c in df.columns if c not in names], *[F.col("_v")[n].alias(n) for n in names])


def _matches(df: DataFrame, text: str, expression: str, must: str, out: str) -> DataFrame:
    """Add `out`: an array of (start, end, value) of all matches, in code points.

    Starts are sums of the gaps and matches before; sums are kept for every 256 matches, so long texts stay cheap.
    """
    none = F.array().cast("array<string>")
    some = F.col(text).contains(must) if must else F.rlike(text, F.lit("[0-9]"))
    df = _held(df, _m=F.when(some, F.regexp_extract_all(text, F.lit(expression), F.lit(0))).otherwise(none))
    df = _held(df, _g=F.when(F.size("_m") > 0, F.split(text, expression, -1)).otherwise(none))
    df = _held(df, _a=F.zip_with(F.slice("_g", F.lit(1), F.size("_m")), "_m", lambda g, m: F.struct(
        F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m"))))
    df = _held(df, _t=F.transform("_a", lambda a: a["g"] + a["n"]))

    def total(first: Column, count: Column) -> Column:
        return F.aggregate(F.slice("_t", first, count), F.lit(0), lambda a, b: a + b)

    df = _held(df, _s=F.transform(F.sequence(F.lit(0), F.floor(F.size("_t") / _PIECE).cast("int")), lambda c: total(F.lit(1), c * _PIECE)))

    def span(a: Column, i: Column) -> Column:
        start = F.get("_s", F.floor(i / _PIECE).cast("int")) + total(i - i % _PIECE + 1, i % _PIECE) + a["g"]
        return F.struct(start.alias("start"), (start + a["n"]).alias("end"), a["m"].alias("value"))

    return _held(df, **{out: F.transform("_a", span)}).drop("_m", "_g", "_a", "_t", "_s")


def base_spans(docs: DataFrame) -> DataFrame:
    """Add email, ip, card and phone: arrays of (start, end, value) of the base spans of `text`."""
    marked = F.regexp_replace(F.translate("text", "\x01", "\x02"), JOINT, "\x01")
    for kind in KINDS:
        expression, must, test = TESTS[kind]
        if kind == "card":
            docs = _held(docs, _marked=F.when(F.rlike("text", F.lit("[0-9]")), marked).otherwise(""))
        docs = _matches(docs, "_marked" if kind == "card" else "text", expression, must, kind)
        docs = docs.withColumn(kind, _passing(kind, test))
    return docs.drop("_marked")


def _passing(kind: str, test) -> Column:
    return F.filter(kind, lambda s: test(s["value"]))


def _is_seed(value: Column) -> Column:
    email, ip, phone = (F.rlike(value, F.lit(f"^{x}$")) for x in (EMAIL, IP, PHONE))
    card = F.rlike(value, F.lit(r"^[0-9](?:-?[0-9]){12,18}$"))
    return (email | (ip & TESTS["ip"][2](value)) | (phone & TESTS["phone"][2](value)) | (card & _luhn(value)))


def _pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, _k, at, before, text) of the pieces of long texts: where each begins, and the signs before it."""
    docs = docs.where(F.length("text") > LONG).dropDuplicates(["doc_id", "_k"])
    parts = docs.select("doc_id", "_k", F.posexplode(F.regexp_extract_all("text", F.lit(_PIECES), F.lit(0))).alias("_pos", "text"))
    order = Window.partitionBy("doc_id", "_k").orderBy("_pos")  # the pieces of one text
    at = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    before = F.substring(F.lag("text").over(order), -_CONTEXT, _CONTEXT)
    return parts.select("doc_id", "_k", F.coalesce(at, F.lit(0)).cast("int").alias("at"), F.coalesce(before, F.lit("")).alias("before"), "text")


def _whole_base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _k and the base spans (start, end) of each row, long texts by pieces."""
    short = base_spans(docs.where(F.length("text") <= LONG)).select("doc_id", "_k", *[_places(k) for k in KINDS])
    found = base_spans(_pieces(docs)).where(" or ".join(f"size({k}) > 0" for k in KINDS))
    found = found.select("doc_id", "_k", F.struct("at", *[_places(k, F.col("at")) for k in KINDS]).alias("_f"))
    found = found.groupBy("doc_id", "_k").agg(F.sort_array(F.collect_list("_f")).alias("_f"))  # the spans of one text
    found = found.select(F.col("doc_id").alias("_d"), F.col("_k").alias("_h"), *[F.flatten(F.transform("_f", lambda f: f[k])).alias(k) for k in KINDS])
    long_ = docs.where(F.length("text") > LONG).select("doc_id", "_k")
    long_ = long_.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_h")), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return short.union(long_.select("doc_id", "_k", *[F.coalesce(k, none).alias(k) for k in KINDS]))


def _instances(docs: DataFrame) -> DataFrame:
    """(doc_id, _k, start, end, value, patterns, seed) of each instance that two words precede."""
    short = docs.where(F.length("text") <= LONG).select("doc_id", "_k", F.lit(0).alias("at"), F.lit("").alias("before"), "text")
    texts = short.union(_pieces(docs)).where(F.rlike("text", F.lit("[0-9@]")))
    found = _matches(texts, "text", INSTANCE, "", "found")
    rows = found.select("doc_id", "_k", "at", "before", F.explode("found").alias("s"), "text")
    # Signs of the piece before the instance, behind what is needed of the piece before.
    own = F.substring("text", F.greatest(F.col("s.start") - _CONTEXT + 1, F.lit(1)), F.least(F.col("s.start"), F.lit(_CONTEXT)))
    before = F.lower(F.substring(F.concat("before", own), -_CONTEXT, _CONTEXT))
    context = F.regexp_extract(before, r"(\S+\s+\S+[\s=:\"'(]+)$", 1)
    shape = F.regexp_replace(F.regexp_replace(F.col("s.value"), "[A-Za-z]+", "a"), "[0-9]+", "9")
    return rows.select("doc_id", "_k", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"),
                       F.lower("s.value").alias("value"), F.when(context != "", F.array(F.xxhash64(context), F.xxhash64(context, shape))).alias("patterns"),
                       _is_seed(F.col("s.value")).alias("seed")).where("patterns is not null")


def discovered(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, _k, found): spans (start, end) that trusted patterns discover beyond the seeds."""
    instances = cut(_instances(docs))
    edges = instances.select(F.explode("patterns").alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    enough = edges.groupBy("pattern").agg(F.count_if("seed").alias("_s"), F.count("*").alias("_n")).where((F.col("_s") >= support) & (F.col("_n") > F.col("_s")))
    edges = cut(edges.join(enough.select("pattern"), "pattern"))
    scores = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        patterns = edges.join(scores, "value").groupBy("pattern").agg(F.avg("score").alias("trust"))
        doubt = F.exp(F.sum(F.log(1 - 0.99 * F.col("trust"))))
        scores = cut(edges.join(patterns, "pattern").groupBy("value").agg(
            F.greatest(F.max(F.col("seed").cast("double")), 1 - doubt).alias("score")))
    trusted = edges.join(scores, "value").groupBy("pattern").agg(F.avg("score").alias("trust")).where(F.col("trust") >= confidence)
    new = instances.where("not seed").select("doc_id", "_k", "start", "end", "value", F.explode("patterns").alias("pattern")).join(trusted.select("pattern"), "pattern", "left_semi").join(
        scores.where(F.col("score") >= confidence).select("value"), "value", "left_semi")
    return new.groupBy("doc_id", "_k").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("found"))


def find_personal_data(docs: DataFrame, text: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE,
                       rounds: int = ROUNDS) -> DataFrame:
    """doc_id and, for each base kind and for id, the spans (start, end) in code points, end exclusive, by start."""
    docs = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("_k", F.xxhash64("doc_id", "text"))
    base = _whole_base_spans(docs)
    new = discovered(docs, support, confidence, rounds).toDF("_d", "_h", "found")
    both = base.join(new, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_h")), "left")
    taken = F.concat(*KINDS)
    new = F.filter(F.coalesce("found", F.array().cast("array<struct<start:int,end:int>>")), lambda f: ~F.exists(
        taken, lambda b: (b["start"] < f["end"]) & (f["start"] < b["end"])))
    return both.select("doc_id", *KINDS, new.alias("id"))


def _places(kind: str, at: Column | None = None) -> Column:
    moved = F.lit(0) if at is None else at
    return F.transform(kind, lambda s: F.struct((s["start"] + moved).alias("start"), (s["end"] + moved).alias("end"))).alias(kind)


def span_text(kind: str) -> Column:
    """Spans as kind:start:end strings."""
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))
