"""Optional extras: rows to partitions, and partitions to read.

The database that partitions are meant for does this itself; for tables that Spark keeps, it is done
here. A regular layout is routed by an expression on the key, without a join; any layout by
equi-joins on runs of days as long as the partitions are, which Spark can hash, instead of a nested
loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeparts.operators.expected import partition_for

#: Rows that a routing table may have to be sent to all executors.
BROADCAST_ROWS = 100_000


def route_regular(rows: DataFrame, key: str, interval: str, table: str) -> DataFrame:
    """``rows`` with the name of the partition that an unbroken layout of one interval has for their key."""
    return rows.withColumn("part_name", F.when(F.col(key).isNotNull(), partition_for(key, interval, F.lit(table))["name"]))


#: Levels that partitions can have: 2**22 days are more than 9999 years.
LEVELS = range(23)


def _spans(partitions: DataFrame) -> DataFrame:
    """(name, lo, hi, first, last, level): the first and last day of each partition; it has 2**level days at most."""
    first, end = F.unix_date(F.col("lo").cast("date")), F.col("hi").cast("date")
    last = F.unix_date(end) - F.when(F.col("hi") == end.cast("timestamp_ntz"), 1).otherwise(0)
    spans = partitions.where("lo < hi").select("name", "lo", "hi", first.alias("first"), last.alias("last"))
    return spans.withColumn("level", F.ceil(F.log2(F.col("last") - F.col("first") + 1)).cast("int"))


def _runs(spans: DataFrame) -> DataFrame:
    """(level, run, name, lo, hi): each span in each run of 2**level days that it meets; two at most.

    However long a partition is (one may end in the year 9999), it has no more rows. The level is given
    by the generator, so that a filter on it stays above whatever the spans are made of.
    """
    ends = (F.call_function("shiftright", F.col(c), F.col("level")) for c in ("first", "last"))
    runs = F.transform(F.sequence(*ends), lambda run: F.struct(F.col("level").alias("level"), run.alias("run")))
    return spans.select(F.inline(runs), "name", "lo", "hi")


def route_rows(rows: DataFrame, key: str, partitions: DataFrame) -> DataFrame:
    """``rows`` with the name (part_name) of the partition whose range has their key, null if none has.

    For layouts of any shape whose ranges do not overlap. Rows are joined once for each of the LEVELS
    that the layout has: one or two in most.
    """
    spans = _spans(partitions.select("name", "lo", "hi"))
    counts = spans.agg(*(F.count_if(F.col("level") == i) for i in LEVELS)).first()
    runs = _runs(spans)
    at, names = F.col(key).cast("timestamp_ntz"), []
    for level in (i for i in LEVELS if counts[i]):
        names.append(f"_name{level}")
        some = runs.where(F.col("level") == level).drop("level").toDF("_run", names[-1], "_lo", "_hi")
        run = F.shiftright(F.unix_date(at.cast("date")), level)
        match = (run == F.col("_run")) & (at >= F.col("_lo")) & (at < F.col("_hi"))
        rows = rows.join(F.broadcast(some) if 2 * counts[level] <= BROADCAST_ROWS else some, match, "left").drop("_run", "_lo", "_hi")
    return rows.withColumn("part_name", F.coalesce(*names) if names else F.lit(None).cast("string")).drop(*names)


def overlapping(partitions: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The partitions that a range of keys has something of."""
    return partitions.where((F.col("lo") < hi) & (F.col("hi") > lo))


def read_range(table: DataFrame, key: str, partitions: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Rows of a table (partitioned by part_name) with lo <= key < hi; only the files of partitions in that range are read."""
    wanted = [r.name for r in overlapping(partitions, lo, hi).select("name").collect()]  # as many as partitions match
    at = F.col(key).cast("timestamp_ntz")
    return table.where(F.col("part_name").isin(wanted) & (at >= lo) & (at < hi))
