"""Company-facts and filing-header JSON."""
from pyspark.sql import DataFrame, SparkSession, functions as F

FACTS_SCHEMA = ("cik string, facts map<string, map<string, struct<units: map<string, array<struct<"
                "start: date, end: date, val: double, filed: date, form: string, fp: string>>>>>>")
HEADER_SCHEMA = ("cik string, name string, sic string, sicDescription string, tickers array<string>, "
                 "exchanges array<string>, formerNames array<struct<name: string>>")


def read_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A folder of facts documents, one JSON object per file: long fact rows, and the documents that can't be read.
    Spark's readers pass over files of no bytes, so those are in neither."""
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"), F.input_file_name().alias("source"))
    return parse_facts(docs), unreadable(docs)


def _read(docs: DataFrame) -> DataFrame:
    """docs with the parsed document d; d._bad is the text where it is no JSON object of this form."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return docs.withColumn("d", F.from_json("doc", f"{FACTS_SCHEMA}, _bad string", options))


_READABLE = "d IS NOT NULL AND d._bad IS NULL AND d.cik IS NOT NULL AND d.facts IS NOT NULL"


def parse_facts(docs: DataFrame) -> DataFrame:
    """Facts documents in `doc` to long rows; tag_ord is the tag's place in its namespace, pos the point's in its unit.
    Documents that can't be read give no rows, not even their readable parts; unreadable() has them."""
    doc = _read(docs).where(_READABLE).select(F.lpad("d.cik", 10, "0").alias("cik"), F.explode("d.facts").alias("ns", "tags"))
    tags = doc.select("cik", "ns", F.posexplode("tags").alias("tag_ord", "tag", "node"))
    units = tags.select("cik", "ns", "tag", "tag_ord", F.explode("node.units").alias("unit", "points"))
    points = units.select("cik", "ns", "tag", "tag_ord", "unit", F.posexplode("points").alias("pos", "p"))
    return points.select("cik", "ns", "tag", "tag_ord", "unit", "pos", "p.*")


def unreadable(docs: DataFrame) -> DataFrame:
    """S1, quarantine: the documents that parse_facts leaves out, as they came, with the reason."""
    reason = """CASE WHEN doc IS NULL OR doc RLIKE r'^\\s*$' THEN 'empty' WHEN d IS NULL OR d._bad IS NOT NULL THEN 'not JSON of this form'
                WHEN d.cik IS NULL THEN 'no cik' ELSE 'no facts' END"""
    return _read(docs).where(f"NOT ({_READABLE})").select(*docs.columns, F.expr(reason).alias("reason"))


def _folded(df: DataFrame, keys: list[str], name: str, value) -> DataFrame:
    """Rows to a map per key from `name` to `value`, in the order of the names."""
    m = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, value.alias("_v")))).alias("_m"))
    return m.withColumn("_m", F.expr("transform(array(array_sort(map_keys(_m))), k -> map_from_arrays(k, transform(k, x -> _m[x])))[0]"))


def pack_facts(rows: DataFrame) -> DataFrame:
    """Fact rows to documents, one for each filer with its whole history; points are in the order of their dates."""
    point = F.struct("end", "filed", "start", "form", "fp", "val")
    units = rows.groupBy("cik", "ns", "tag", "unit").agg(F.array_sort(F.collect_list(point)).alias("points"))
    tags = _folded(units, ["cik", "ns", "tag"], "unit", F.col("points"))
    spaces = _folded(tags, ["cik", "ns"], "tag", F.struct(F.col("_m").alias("units")))
    doc = _folded(spaces, ["cik"], "ns", F.col("_m")).select("cik", F.to_json(F.struct("cik", F.col("_m").alias("facts"))).alias("doc"))
    return doc


def read_filers(spark: SparkSession, path: str) -> DataFrame:
    """Filing headers.  The schema names the header fields only, so the long filing lists are
    skipped by the JSON reader."""
    return shape_filers(spark.read.schema(HEADER_SCHEMA).option("multiLine", True).json(path))


def shape_filers(raw: DataFrame) -> DataFrame:
    """Keep filers with a ticker or a SIC; add the normalized current and former names."""
    from ..operators.entities import norm_name_sql
    named = raw.select(
        F.lpad("cik", 10, "0").alias("cik"), "name", F.coalesce("sic", F.lit("")).alias("sic"),
        F.coalesce("sicDescription", F.lit("")).alias("sic_desc"),
        F.expr("filter(coalesce(tickers, array()), t -> t <> '')").alias("tickers"),
        F.expr("filter(coalesce(exchanges, array()), x -> x <> '')").alias("exchanges"),
        F.expr("transform(coalesce(formerNames, array()), f -> f.name)").alias("former_names"))
    names = "filter(concat(array(name), former_names), n -> n <> '')"
    return named.where("size(tickers) > 0 OR sic <> ''").withColumn(
        "norm_names", F.expr(f"array_sort(array_distinct(transform({names}, n -> {norm_name_sql('n')})))"))
