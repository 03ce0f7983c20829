"""Helpers that several operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's ``spark.checkpoint.dir`` names it.

    Only where that is unset (tests, a single machine) a folder below the warehouse is taken, which is
    shared as well.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there from now on."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: A key is hot if it has over HOT_ROWS rows and over one of HOT_SHARE rows of all.
HOT_ROWS, HOT_SHARE = 10_000, 1_000


def met(rows: DataFrame, values: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` joined with ``values``: one row a ``key``, with the number of the key's rows in ``times``, ``n`` in all at most.

    No task of the shuffle gets the rows of a hot key: there are HOT_SHARE such keys at most, however
    large the tables are, so their values are broadcast. Below HOT_ROWS rows there is none.
    """
    if n <= HOT_ROWS:
        return rows.join(values.drop("times"), key)
    values = cut(values)
    hot = values.where(F.col("times") > max(HOT_ROWS, n // HOT_SHARE)).drop("times")
    rest = values.drop("times")
    if hot.isEmpty():
        return rows.join(rest, key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(rest, key))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0 as if its text were empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(labels: DataFrame, label: str, folds: int, held: int, bound: int) -> DataFrame:
    """(doc_id, label) of at most ``bound`` documents with a label outside the fold ``held``.

    The rows with the smallest hash of their id are taken, so the sample does not depend on the
    order or the partitions of the table. Where a document has several labels, the largest counts.
    """
    return (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .where(fold(F.col("doc_id"), folds) != held)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of the sample; it has at most ``bound`` narrow rows, so it is broadcast."""
    sample = labelled_sample(labels, label, folds, held, bound)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id")


def worker_cache(name: str) -> dict:
    """A dictionary that a Python worker keeps from task to task, for one operator at a time.

    A worker serves one operator after another; what it kept for the last one is let go when the next
    one asks, so that their tables don't add up.
    """
    kept = sys.modules.setdefault("_rangeparts_worker", types.ModuleType("_rangeparts_worker")).__dict__
    if kept.get("operator") != name:
        kept["operator"], kept["cache"] = name, {}
    return kept["cache"]


def parts(batch, column: int, chars: int) -> Iterator[tuple]:
    """(part, texts): slices of a batch with some ``chars`` characters of text each, one row at least, so that memory
    follows the longest text and not the number of rows. Null texts are empty."""
    at, texts, size = 0, [], 0
    for value in batch.column(column):
        text = value.as_py() or ""
        texts.append(text)
        size += len(text) + 1
        if size >= chars:
            yield batch.slice(at, len(texts)), texts
            at, texts, size = at + len(texts), [], 0
    if texts:
        yield batch.slice(at, len(texts)), texts
