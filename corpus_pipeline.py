"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last one returns the
places of the packed pieces.  Null texts are empty ones from the second stage on.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equispan.llm.decontaminate import decontaminate
from equispan.llm.lines import dedup_lines
from equispan.llm.packing import pack_documents
from equispan.llm.shared import shared_folder, table
from equispan.llm.simhash import one_of_each_group
from equispan.llm.toxicity import score_toxicity


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return score_toxicity(docs, labels).where("predicted = 0").select(*docs.columns)


def keep_first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of similar lines; documents that lose all their lines go, n_chars follows the text."""
    out = dedup_lines(docs)
    left = out.where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n", "")) != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates; rows without doc_id can't be named and stay."""
    return one_of_each_group(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document."""
    return pack_documents(docs, ids=False)


STAGES = [("toxicity", keep_civil), ("line_dedup", keep_first_lines), ("simhash_near_dedup", keep_one_of_each_group),
          ("decontamination", keep_clean), ("packing", pack_sequences)]

#: SQL has neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


QUERIES = {"pipeline": run}
