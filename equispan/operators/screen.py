"""Screening queries over the ranked board."""
from pyspark.sql import DataFrame, functions as F

from ..functions import ranks
from ..functions.exprs import with_exprs

_BILLIONS = "round(mcap / 1e9, 1)"  # bands compare what the board shows
CAP_BANDS = {"mega": f"{_BILLIONS} >= 200", "large": f"{_BILLIONS} >= 10 AND {_BILLIONS} < 200", "mid": f"{_BILLIONS} < 10"}
# fixed values: the named screens
PRESETS = {
    "Deep value": dict(min_upside=25, min_conf=3),
    "Quality compounders": dict(min_quality=78, min_upside=0, hide_flagged=True),
    "Clean & cheap": dict(min_upside=10, min_quality=65, hide_flagged=True),
    "Value confirmed by tape": dict(min_upside=15, min_conf=3, hide_flagged=True, min_momentum=50),
}
SORT_KEYS = ["score", "ticker", "price", "upside", "conf", "quality", "mcap", "pe", "mom_pct"]


def screen(df: DataFrame, sectors=None, cap=None, min_quality=0, min_conf=1, min_upside=-100,
           min_momentum=0, hide_flagged=False) -> DataFrame:
    """Upside in percent; with a momentum floor, names without momentum fail."""
    if sectors is not None:
        df = df.where(F.col("sector").isin(list(sectors)))
    if cap is not None:
        df = df.where(CAP_BANDS[cap])
    df = df.where(f"quality >= {min_quality} AND conf >= {min_conf} AND upside * 100 >= {min_upside}")
    if min_momentum > 0:
        df = df.where(f"coalesce(mom_pct, -1) >= {min_momentum}")
    return df.where("size(flags) = 0") if hide_flagged else df


def preset(df: DataFrame, name: str) -> DataFrame:
    """C2."""
    return screen(df, **PRESETS[name])


def sort_screen(df: DataFrame, key="score", desc=True) -> DataFrame:
    """A missing P/E or momentum sorts as the smallest."""
    if key not in SORT_KEYS:
        raise ValueError(key)
    col = F.coalesce(F.col(key).cast("double"), F.lit(-1e18)) if key in ("pe", "mom_pct") else F.col(key)
    return df.orderBy(col.desc() if desc else col.asc(), "ticker")


def place_screen(df: DataFrame, key="score", desc=True, by=("universe",)) -> DataFrame:
    """C3 with the place of each row, for orders too long for one task; numeric keys only."""
    col = F.coalesce(F.col(key).cast("double"), F.lit(-1e18)) if key in ("pe", "mom_pct") else F.col(key).cast("double")
    return ranks.with_position(df.withColumn("_key", col), "_key", list(by), "ticker", out="place", total="_n", desc=desc).drop("_key", "_n")


def search(df: DataFrame, text: str, n=7) -> DataFrame:
    """C4: the first n tickers or names, in board order, that contain the text."""
    q = F.lit(text.strip().lower())
    hit = F.contains(F.lower("ticker"), q) | F.contains(F.lower("name"), q)
    return df.where(hit & (q != "")).orderBy(F.desc("score"), "ticker").limit(n)


def ranked_board(df: DataFrame) -> DataFrame:
    """C5."""
    return df.orderBy("universe", F.desc("score"), "ticker")


def watchlist(df: DataFrame, tickers: DataFrame) -> DataFrame:
    """C6."""
    return df.join(tickers.select("ticker"), "ticker", "left_semi")


def sectors(df: DataFrame) -> DataFrame:
    """C7."""
    return df.select("sector").distinct().orderBy("sector")


def archetype_tally(valued: DataFrame) -> DataFrame:
    """Names by archetype, how many are gated, rerouted or excluded."""
    rows = with_exprs(valued, ok="why IS NULL")
    return rows.groupBy("universe", "arch").agg(
        F.expr("count_if(ok)").alias("ranked"), F.expr("count_if(ok AND eff_arch <> 'standard')").alias("gated"),
        F.expr("count_if(ok AND arch = 'financial' AND eff_arch = 'standard')").alias("rerouted"),
        F.expr("count_if(NOT ok)").alias("excluded"))
