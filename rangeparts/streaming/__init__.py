"""Optional extra: routing of streams to the partitions of a set."""
