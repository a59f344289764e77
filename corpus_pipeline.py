"""A cleaning pipeline over ``documents``: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm import near_dedup, packing, quality_rules, toxicity
from boxwright.session import checkpoint_dir, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "row_number"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with a number for each row; written, so that it's the same at each read."""
    path = f"{checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)).write.parquet(path)
    return spark.read.parquet(path)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents but those rows; only so many numbers as were counted are broadcast."""
    if rows.limit(near_dedup.BROADCAST_IDS + 1).count() <= near_dedup.BROADCAST_IDS:
        rows = F.broadcast(rows)
    return docs.join(rows, ROW, "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on labelled rows, doesn't call toxic."""
    ship_package(spark)
    return toxicity.drop_toxic(docs.select(*COLUMNS), toxicity.train(docs, _labels(spark, sf_dir)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the likelihood ratio, each by its own verdict."""
    trusted = _labels(spark, sf_dir).filter("quality = 1")
    docs = _numbered(spark, docs)
    return _without(docs, quality_rules.judge(docs, trusted, row_col=ROW).filter("not kept").select(ROW))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity 0.8): the first one with the smallest id, or if none has an id, the first."""
    ship_package(spark)
    docs = _numbered(spark, docs)
    groups = near_dedup.near_duplicates(docs, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id").checkpoint()
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW))
    first = groups.join(docs.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return _without(docs, groups.select(ROW).join(first, ROW, "left_anti").checkpoint())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of up to 2048 tokens."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("packing", pack),
]

#: Models and tokenizers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what lies between them is written to the shared folder."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
