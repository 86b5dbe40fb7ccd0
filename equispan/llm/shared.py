"""What several operators need: reading the tables, cutting lineage, and components of a graph."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own; on a cluster the setting is required.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master().startswith("local[") and context.master() != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like cut, but as a compressed table, for larger results."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of longs: one row (node, root) for each node that has an edge.

    root is the smallest node reachable.  Alternating star contraction: each round links the larger neighbours of a node
    to its smallest one, then the smaller ones; the edges never grow in number and settle in logarithmically many
    rounds.  Minima are combined before each shuffle, and a hub's edges stay separate rows, so that no group is
    gathered in one place.
    """
    def links(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    now = cut(links(edges))
    seen = state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = links(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = links(large.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b"))
        now = cut(small)
        last, seen = seen, state(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # Settled: every edge points from a node to its root.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
