"""Operators on DataFrames of partitions: generators, ranges, differences, routing."""
