"""Few groups do not bring all rows to a few tasks, and rows are read once for their places."""
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from equispan.functions import ranks
from equispan.functions.staging import stage
from equispan.operators import backtest as bt, crosssection as x


@contextmanager
def settings(spark, **kv):
    old = {k: spark.conf.get(k) for k in kv}
    for k, v in kv.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def board(spark):
    return stage(spark.range(300).select(F.expr("if(id % 3 = 0, 'b', 'a')").alias("universe"), F.expr("concat('s', id % 4)").alias("sector"),
                                         F.col("id").cast("string").alias("ticker"), F.expr("if(id % 10 = 0, id / 7D, NULL)").alias("upside")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_tables_go_to_the_rows(spark, board):
    turns = bt.turnover(board.selectExpr("'v' AS variant", "DATE'2020-03-31' AS qdate", "ticker", "true AS held"))
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for df in (x.sector_z(board, "upside", ["universe"], "z"), x.axis_bounds(board), x.neutralize(board, "sector", ["universe"], "upside"), turns):
            assert not re.search(r"SortMergeJoin \[(universe|variant)#\d+(, (_sec|sector|qdate)#\d+)?\]", plan(df))


def test_rows_without_value_are_dealt(spark, board):
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        out = x.with_pct_rank(board, "upside", ["universe"], "pr").withColumn("p", F.spark_partition_id()).collect()
    empty = [r for r in out if r.upside is None]
    assert len(out) == 300 and len(empty) == 270 and all(r.pr is None for r in empty)
    assert len({(r.universe, r.p) for r in empty}) > 4


def test_places_shuffle_their_rows_once(spark, board):
    df = ranks.with_position(board, "upside", ["universe"], "ticker")
    assert plan(df).count("ReadSchema: struct<universe:string,sector:string,ticker:string,upside:double>") == 1
    assert df.count() == 30
