"""Ranges: predicates and algebra of half-open ranges, and the contiguous range that a set's partitions form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeparts.errors import GAP, INCOHERENT_BOUNDS

# -- two ranges --------------------------------------------------------------------------------


def disjoint(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    return (hi <= other_lo) | (lo >= other_hi)


def sticks_out_left(lo: Column, hi: Column, other_lo: Column) -> Column:
    """Whether a range begins before another one and reaches into it or over it."""
    return (lo < other_lo) & (hi > other_lo)


def sticks_out_right(lo: Column, hi: Column, other_hi: Column) -> Column:
    return (hi > other_hi) & (lo < other_hi)


def equal(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    return (lo == other_lo) & (hi == other_hi)


def empty(lo: Column, hi: Column) -> Column:
    return lo == hi


def intersection(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """Struct (lo, hi) of what two ranges share; empty where they only touch, null where they do not."""
    both = F.struct(F.greatest(lo, other_lo).alias("lo"), F.least(hi, other_hi).alias("hi"))
    return F.when((other_lo <= hi) & (lo <= other_hi), both)


# -- the partitions of a set -------------------------------------------------------------------


def checked(partitions: DataFrame) -> DataFrame:
    """``partitions`` with the error of each, if any, in the order of their bounds within the set.

    A partition that does not begin where the one before it ends is a GAP, be it a hole or an overlap;
    ``detail`` tells which. One that does not end after it begins is INCOHERENT_BOUNDS.
    """
    order = Window.partitionBy("set_name").orderBy("lo", "hi", "name")
    before = F.lag("hi").over(order)
    gap = before.isNotNull() & (before != F.col("lo"))
    return partitions.withColumn(
        "error", F.when(gap, GAP).when(F.col("lo") >= F.col("hi"), INCOHERENT_BOUNDS)
    ).withColumn("detail", F.when(gap, F.when(before < F.col("lo"), "hole").otherwise("overlap")))


def global_range(partitions: DataFrame) -> DataFrame:
    """(set_name, lo, hi, n_parts, n_gaps, n_incoherent, error): the range of each set, and its first error.

    A set without partitions has no row.
    """
    by_place = F.struct("lo", "hi", "name")
    return checked(partitions).groupBy("set_name").agg(
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.count("*").alias("n_parts"),
        F.count_if(F.col("error") == GAP).alias("n_gaps"),
        F.count_if(F.col("error") == INCOHERENT_BOUNDS).alias("n_incoherent"),
        F.min_by(F.col("error"), F.when(F.col("error").isNotNull(), by_place)).alias("error"),
    )


def errors(partitions: DataFrame) -> DataFrame:
    """The partitions that have an error."""
    return checked(partitions).where("error is not null")
