"""Schemas of the tables that plans read and give. Bounds are wall-clock times without a zone; ranges are half-open."""

CONFIGS = (
    "set_name string, schema string, table string, partition_key string, interval string,"
    " retention int, pre_provisioned int, cleanup_policy string"
)
RAW_PARTITIONS = "parent_table string, schema string, name string, lower_bound string, upper_bound string"
PARTITIONS = "set_name string, parent_table string, schema string, name string, lo timestamp_ntz, hi timestamp_ntz"
ACTIONS = "set_name string, seq int, action string, schema string, name string, lo timestamp_ntz, hi timestamp_ntz, segment string"

INTERVALS = ("daily", "weekly", "monthly", "quarterly", "yearly")
POLICIES = ("drop", "detach")
KEY_TYPES = ("date", "timestamp", "timestamp with time zone", "uuid")
