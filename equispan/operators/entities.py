"""Companies, names, sectors and universes."""
from pyspark.sql import DataFrame, functions as F

from .quality import concepts_known

# fixed values: words that carry no identity in a company name
NAME_NOISE = ["INC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LLC", "LP", "PLC", "THE", "GROUP",
              "HOLDINGS", "HOLDING", "COM", "NEW", "&"]
# fixed values: SIC classes of products that are not operating companies, and of blank-check shells
FUND_SICS = ["6726", "6221", "6770", "6792"]
SHELL_SIC = "6770"
# fixed values: name patterns
FUND_NAME = (r"(?i)\b(ETF|EXCHANGE.TRADED|INDEX FUND|GOLD TRUST|SILVER TRUST|ISHARES|SPDR|CLOSED.END|"
             r"INCOME FUND|BOND FUND|MUNICIPAL)\b")
INSTRUMENT_NAME = r"(?i)\b(WARRANTS?|RIGHTS?|PREFERRED|DEPOSITARY|SUBORDINATED\s+NOTES?)\b"
GRAM = 6
# Places of one piece of a name in one part.
POSTINGS = 100_000


def norm_name_sql(col):
    """F20 as SQL text: upper case, no parentheses, state marks, punctuation, suffix words or class tags."""
    noise = ", ".join(f"'{w}'" for w in NAME_NOISE)
    text = f"regexp_replace(upper(coalesce({col}, '')), r'\\([^)]*\\)', ' ')"
    text = f"regexp_replace({text}, r' /DE/| /MD/| /DE| \\\\DE\\\\', '')"
    text = f"translate({text}, \"/\\\\,-'’.\", '    ')"
    keep = (f"w NOT IN ({noise}) AND NOT (w IN ('CLASS', 'CL') AND coalesce(length(get(ws, i + 1)) = 1, false)) "
            "AND NOT (w IN ('A', 'B', 'C') AND coalesce(get(ws, i - 1) IN ('CLASS', 'CL'), false))")
    words = f"filter(split({text}, r'\\s+'), w -> w <> '')"
    return f"get(transform(array({words}), ws -> array_join(filter(ws, (w, i) -> {keep}), ' ')), 0)"


def with_norm_name(df: DataFrame, col="name", out="norm_name") -> DataFrame:
    return df.withColumn(out, F.expr(norm_name_sql(col)))


def _pieces(col, low, high):
    """(at, gram) of every substring of low to high letters, the same piece at each of its places."""
    return (f"flatten(transform(sequence({low}, {high}), n -> if(length({col}) < n, array(), transform(sequence(1, length({col}) - n + 1), "
            f"i -> named_struct('at', i, 'gram', substr({col}, i, n))))))")


def containing_names(keys: DataFrame, known: DataFrame, hot=POSTINGS) -> DataFrame:
    """(key, lo, hi): the least and greatest cik of the names that contain each key; keys that none contains are left out.

    keys: distinct `key`.  known: distinct names with the least and greatest cik that bears them (known, lo, hi); two ciks
    are all that a key's answer needs, so nothing more is kept.  A name that contains a key has the key's rarest piece
    somewhere, and around that place, at the key's own distance and length, the key itself.  So a piece's places meet only
    the shapes (distance, length) of the keys that chose it, which no name's length lets grow, instead of the keys; what
    they cut out is folded and joined with the keys by equality.  Places of a piece with more than `hot` of them are dealt
    to several parts, each of which gets the shapes.
    """
    short, long = keys.where(f"length(key) < {GRAM}"), keys.where(f"length(key) >= {GRAM}")
    ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    brief = known.select("lo", "hi", F.inline(F.expr(_pieces("known", 1, GRAM - 1)))).groupBy(F.col("gram").alias("key")).agg(*ends)
    places = known.select("known", "lo", "hi", F.inline(F.expr(_pieces("known", GRAM, GRAM))))
    wanted = long.select("key", F.inline(F.expr(_pieces("key", GRAM, GRAM))))
    sizes = places.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    chosen = wanted.join(sizes, "gram", "left").groupBy("key").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "at")).alias("c")).where("c.n > 0")
    shapes = chosen.select("c.gram", "c.at", F.length("key").alias("len"), F.expr(f"cast(c.n DIV {hot} AS int)").alias("parts")).distinct()
    parts = shapes.select("gram", "parts").distinct()
    dealt = places.join(parts, "gram").withColumn("part", F.expr("pmod(hash(known, at), parts + 1)")).drop("parts")
    shapes = shapes.select("gram", F.col("at").alias("off"), "len", F.explode(F.expr("sequence(0, parts)")).alias("part"))
    cut = dealt.join(shapes, ["gram", "part"]).where("at >= off AND at - off + len <= length(known)")
    cut = cut.groupBy(F.expr("substr(known, at - off + 1, len)").alias("key")).agg(*ends)
    return long.join(cut, "key").unionByName(short.join(brief, "key"))


def resolve_names(names: DataFrame, filers: DataFrame, hot=POSTINGS) -> DataFrame:
    """(ticker, name) to a cik: a unique exact match on any current or former normalized name,
    else a unique name that contains it; anything ambiguous stays null."""
    keys = with_norm_name(names).where("norm_name <> ''").select("ticker", F.col("norm_name").alias("key"))
    known = filers.select("cik", F.explode("norm_names").alias("known")).groupBy("known").agg(F.min("cik").alias("lo"), F.max("cik").alias("hi"))
    exact = (keys.join(known, F.col("key") == F.col("known")).groupBy("ticker")
             .agg(F.expr("if(min(lo) = max(hi), min(lo), NULL)").alias("exact_cik"), F.lit(True).alias("hit")))
    open_keys = keys.join(exact, "ticker", "left_anti")
    part = (open_keys.join(containing_names(open_keys.select("key").distinct(), known, hot), "key").groupBy("ticker")
            .agg(F.expr("if(min(lo) = max(hi), min(lo), NULL)").alias("part_cik")))
    return (names.select("ticker").join(exact, "ticker", "left").join(part, "ticker", "left")
            .select("ticker", F.expr("if(hit, exact_cik, part_cik)").alias("cik")))


def name_consistent(pairs: DataFrame, filers: DataFrame) -> DataFrame:
    """is the name, spaces removed, contained in one of that filer's own names?"""
    keyed = with_norm_name(pairs).withColumn("key", F.expr("replace(norm_name, ' ', '')"))
    ok = "length(key) >= 2 AND exists(coalesce(norm_names, array()), n -> contains(replace(n, ' ', ''), key))"
    return (keyed.join(filers.select("cik", "norm_names"), "cik", "left")
            .select(*pairs.columns, F.expr(ok).alias("matches")))


def ticker_cik(filers: DataFrame, registrants: DataFrame, pins: DataFrame) -> DataFrame:
    """tickers to ciks; pins beat the registrant list, which beats the filers' own tickers."""
    own = filers.select(F.explode("tickers").alias("ticker"), "cik").withColumn("src", F.lit(2))
    rows = (own.unionByName(registrants.select("ticker", "cik").withColumn("src", F.lit(1)))
            .unionByName(pins.select("ticker", "cik").withColumn("src", F.lit(0))))
    return (rows.groupBy(F.upper("ticker").alias("ticker"))
            .agg(F.min_by("cik", F.struct("src", "cik")).alias("cik")))


def dedupe_share_class(df: DataFrame) -> DataFrame:
    """one row per cik, the first ticker's."""
    rest = [c for c in df.columns if c not in ("cik", "ticker")]
    return (df.groupBy("cik").agg(F.min(F.struct("ticker", *rest)).alias("r"))
            .select("cik", "r.*").select(*df.columns))


def to_ingest(universe: DataFrame, fin: DataFrame, min_concepts=15) -> DataFrame:
    """names not yet covered by enough concepts."""
    done = concepts_known(fin).where(F.col("n") >= min_concepts)
    return universe.join(done, "ticker", "left_anti")


def constituents(lists: DataFrame) -> DataFrame:
    """(list_rank, ticker, name, sector) rows to one row per ticker, first list wins."""
    return (lists.groupBy("ticker").agg(F.min_by(F.struct("name", "sector"), "list_rank").alias("r"))
            .select("ticker", "r.name", "r.sector"))


def union_universe(members: DataFrame, universes: DataFrame) -> DataFrame:
    """F16: merge universes: the first names the ticker, a GICS source overrides a non-GICS sector."""
    rows = members.join(F.broadcast(universes.select("universe", "rank", "gics")), "universe")
    return rows.groupBy("ticker").agg(
        F.min_by("name", "rank").alias("name"),
        F.min_by("sector", F.struct((~F.col("gics")), "rank")).alias("sector"),
        F.array_sort(F.collect_set("universe")).alias("universes"))


def with_sector_by_sic(df: DataFrame, sicmap: DataFrame, out="sector") -> DataFrame:
    """sector of the longest mapped SIC prefix (4, 3, 2 digits).  The map has at most 11,100 prefixes."""
    for n in (4, 3, 2):
        side = F.broadcast(sicmap.select(F.col("prefix").alias(f"_p{n}"), F.col("sector").alias(f"_s{n}")))
        df = df.join(side, F.substring("sic", 1, n) == F.col(f"_p{n}"), "left").drop(f"_p{n}")
    return df.withColumn(out, F.coalesce("_s4", "_s3", "_s2")).drop("_s4", "_s3", "_s2")


def listed_census(filers: DataFrame, forms: DataFrame, sicmap: DataFrame) -> DataFrame:
    """NYSE-listed operating companies with an annual form and a mapped sector."""
    rows = (filers.where("exists(exchanges, x -> contains(x, 'NYSE')) AND size(tickers) > 0")
            .where(~F.col("sic").isin(FUND_SICS) & ~F.coalesce(F.col("name").rlike(FUND_NAME), F.lit(False)))
            .join(forms.where("form IS NOT NULL"), "cik"))
    return (with_sector_by_sic(rows, sicmap).where("sector IS NOT NULL")
            .select("cik", F.expr("upper(trim(tickers[0]))").alias("ticker"),
                    F.initcap("name").alias("name"), "sector", "form"))


HYGIENE = f"""CASE WHEN price > 0 AND price < 1 THEN 'sub-$1 share price (L0 hygiene)'
 WHEN sic = '{SHELL_SIC}' THEN 'SPAC / blank-check shell (SIC {SHELL_SIC})'
 WHEN name RLIKE r'{INSTRUMENT_NAME}' THEN 'non-common instrument (warrant/right/preferred)' END"""


def with_hygiene_reason(df: DataFrame, out="hygiene") -> DataFrame:
    """why a line is not an investable common stock; the first reason wins."""
    return df.withColumn(out, F.expr(HYGIENE))


def apply_floor(members: DataFrame, companies: DataFrame, universes: DataFrame) -> DataFrame:
    """drop members whose market cap is under their universe's floor; an unknown cap counts as 0."""
    floors = F.broadcast(universes.select("universe", "mcap_floor"))
    caps = companies.select("ticker", F.expr("coalesce(price, 0D) * coalesce(shares_out, 0D)").alias("mcap"))
    return (members.join(floors, "universe", "left").join(caps, "ticker", "left")
            .where("mcap_floor IS NULL OR coalesce(mcap, 0D) >= mcap_floor")
            .select(*members.columns))
