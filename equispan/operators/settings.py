"""The configuration's layers, resolved for each company."""
from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import with_exprs
from .entities import with_sector_by_sic
from .metrics import size_premium_sql


def resolve_assumptions(companies: DataFrame, tables: dict) -> DataFrame:
    """What the configuration says about each company (ticker, cik, sic, sector, mcap): a pin of its own goes before
    what its SIC code says, and that before the company's own entry.  The maps are configuration, so each is small.

    n_universes counts the universes whose floor the market cap clears; without a market cap none, and no premium."""
    def pinned(df, name, col, out):
        return df.join(F.broadcast(tables[name].select("ticker", F.col(col).alias(out))), "ticker", "left")

    df = companies
    for name, col, out in (("archetype_overrides", "archetype", "archetype_pin"), ("cik_pins", "cik", "_cik"), ("subsector_overrides", "bucket", "_own")):
        df = pinned(df, name, col, out)
    df = df.join(F.broadcast(tables["subsector_by_sic"].select("sic", F.col("bucket").alias("_sic_bucket"))), "sic", "left")
    df = with_sector_by_sic(df.withColumnRenamed("sector", "_sector"), tables["sector_by_sic"], out="_sic_sector")
    floors = tables["universes"].agg(F.array_sort(F.collect_list(F.greatest("min_mcap", F.coalesce("mcap_floor", F.lit(0.0))))).alias("_floors"))
    df = df.withColumn("_one", F.lit(1)).join(F.broadcast(floors.withColumn("_one", F.lit(1))), "_one", "left")
    return with_exprs(
        df, cik="coalesce(_cik, cik)", bucket="coalesce(_own, _sic_bucket)", sector="coalesce(_sector, _sic_sector)",
        sic_sector="_sic_sector", n_universes="size(filter(coalesce(_floors, array()), f -> coalesce(mcap >= f, false)))",
        size_premium=f"if(mcap IS NULL, NULL, {size_premium_sql()})").select(
        "ticker", "cik", "archetype_pin", "bucket", "sector", "sic_sector", "size_premium", "n_universes")
