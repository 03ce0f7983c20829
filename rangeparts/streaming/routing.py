"""Streams into partitions: each micro-batch is routed like a table, and appended by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from rangeparts.operators.routing import route_regular


def routed_stream(rows: DataFrame, key: str, interval: str, table: str) -> DataFrame:
    """A stream with the name of each row's partition; a plain projection, so it keeps no state."""
    return route_regular(rows, key, interval, table)


def write_partitioned(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends the routed stream as Parquet, a folder for each partition."""
    return (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy("part_name").outputMode("append")
    )
