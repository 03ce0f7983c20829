"""The corpus pipeline: documents are scored, cleaned, deduplicated and packed.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last give the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rangeparts.llm import linededup, packing, quality, simhash, toxicity
from rangeparts.llm.common import shared_folder, table
from rangeparts.llm.queries import byte_bpe


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier takes for good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the toxicity models take for ordinary."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes away lines that repeat earlier ones, and documents of which nothing is left."""
    return linededup.dedup(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens; a row for each piece."""
    return packing.packed(docs, byte_bpe())


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("best-fit packing", packing_stage),
]

#: SQL expresses neither the trained models nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`; stages are handed on through the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
