"""Catalogs: where partitions are listed, and where actions on them are carried out."""

from __future__ import annotations

import contextlib
import datetime
import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeparts import errors
from rangeparts.errors import DetachPending, RangeError
from rangeparts.functions import bounds, names
from rangeparts.operators import keys
from rangeparts.schemas import RAW_PARTITIONS


class Catalog(Protocol):
    """What an engine needs of a catalog."""

    #: The least major version that ``engine_version`` may tell.
    min_version: int

    def list_partitions(self, schema: str, table: str) -> list[tuple]: ...
    def column_type(self, schema: str, table: str, column: str) -> str: ...
    def partition_settings(self, schema: str, table: str) -> tuple[str, str]: ...
    def table_exists(self, schema: str, table: str) -> bool: ...
    def is_attached(self, schema: str, table: str) -> bool: ...
    def create_like(self, schema: str, table: str, parent: str) -> None: ...
    def attach(self, schema: str, table: str, parent: str, lower: str, upper: str) -> None: ...
    def detach(self, schema: str, table: str, parent: str) -> None: ...
    def finalize_detach(self, schema: str, table: str, parent: str) -> None: ...
    def drop(self, schema: str, table: str) -> None: ...
    def copy_identity(self, schema: str, table: str, parent: str) -> None: ...
    def engine_version(self) -> str: ...
    def server_time(self) -> datetime.datetime: ...


def described_partitions(children: DataFrame) -> DataFrame:
    """RAW_PARTITIONS of the children of tables, (parent_table, schema, name, kind, expression), as a catalog describes them.

    Ordinary tables only; the bounds are null where the expression has none.
    """
    return children.where("kind = 'r'").select(
        "parent_table", "schema", "name",
        names.lower_bound("expression").alias("lower_bound"), names.upper_bound("expression").alias("upper_bound"),
    )


def typed_partitions(raw: DataFrame) -> DataFrame:
    """``raw`` (RAW_PARTITIONS and set_name) with lo and hi in place of the texts, and the error of each row, if any."""
    null = F.col("lower_bound").isNull() | F.col("upper_bound").isNull()
    b = bounds.parsed("lower_bound", "upper_bound")
    error = F.when(null, errors.NULL_BOUND).when(b.isNull(), errors.UNDECODABLE_BOUNDS)
    return raw.select("set_name", "parent_table", "schema", "name", b["lo"].alias("lo"), b["hi"].alias("hi"), error.alias("error"))


class FrameCatalog:
    """A catalog in memory, for tests and dry runs; ``calls`` has the actions, and those in ``failing`` (action, table) fail."""

    min_version = keys.MIN_VERSION

    def __init__(self, version: str = "16.2", now: datetime.datetime | None = None):
        self.version, self.now = version, now
        self.parents: dict[tuple[str, str], dict] = {}
        self.tables: dict[tuple[str, str], dict] = {}
        self.failing: set[tuple[str, str]] = set()
        self.calls: list[tuple] = []

    def add_parent(self, schema: str, table: str, key: str, key_type: str, strategy: str = "RANGE", identity: str = "d") -> None:
        self.parents[schema, table] = {"key": key, "type": key_type, "strategy": strategy, "identity": identity}

    def add_partition(self, schema: str, table: str, parent: str, lower: str | None, upper: str | None, state: str = "attached") -> None:
        self.tables[schema, table] = {"parent": parent, "lower": lower, "upper": upper, "state": state, "identity": "d"}

    def _do(self, action: str, schema: str, table: str, *rest) -> None:
        self.calls.append((action, schema, table, *rest))
        if (action, table) in self.failing:
            raise RangeError("ACTION_FAILED", f"{action} {schema}.{table}")

    def list_partitions(self, schema: str, table: str) -> list[tuple]:
        if ("list", table) in self.failing:
            raise RangeError("ACTION_FAILED", f"list {schema}.{table}")
        return sorted(
            (table, s, n, t["lower"], t["upper"]) for (s, n), t in self.tables.items() if s == schema and t["parent"] == table and t["state"] != "free"
        )

    def column_type(self, schema: str, table: str, column: str) -> str:
        parent = self.parents.get((schema, table))
        if parent is None or names.TYPE_NAMES.get(parent["type"]) is None:
            raise RangeError(errors.UNSUPPORTED_KEY_TYPE, f"{schema}.{table}.{column}")
        return names.TYPE_NAMES[parent["type"]]

    def partition_settings(self, schema: str, table: str) -> tuple[str, str]:
        parent = self.parents.get((schema, table))
        if parent is None or not parent["strategy"]:
            raise RangeError(errors.NOT_PARTITIONED, f"{schema}.{table}")
        return parent["strategy"], parent["key"]

    def table_exists(self, schema: str, table: str) -> bool:
        return (schema, table) in self.tables or (schema, table) in self.parents

    def is_attached(self, schema: str, table: str) -> bool:
        t = self.tables.get((schema, table))
        return t is not None and t["state"] != "free"

    def create_like(self, schema: str, table: str, parent: str) -> None:
        self._do("create", schema, table, parent)
        self.add_partition(schema, table, parent, None, None, "free")

    def attach(self, schema: str, table: str, parent: str, lower: str, upper: str) -> None:
        self._do("attach", schema, table, parent, lower, upper)
        self.tables[schema, table] |= {"parent": parent, "lower": lower, "upper": upper, "state": "attached"}

    def detach(self, schema: str, table: str, parent: str) -> None:
        self._do("detach", schema, table, parent)
        if self.tables[schema, table]["state"] == "pending":
            raise DetachPending(f"{schema}.{table}")
        self.tables[schema, table]["state"] = "free"

    def finalize_detach(self, schema: str, table: str, parent: str) -> None:
        self._do("finalize", schema, table, parent)
        self.tables[schema, table]["state"] = "free"

    def drop(self, schema: str, table: str) -> None:
        self._do("drop", schema, table)
        del self.tables[schema, table]

    def copy_identity(self, schema: str, table: str, parent: str) -> None:
        self._do("identity", schema, table, parent)
        identity = self.parents[schema, parent]["identity"]
        if identity in ("f", "i"):
            self.tables[schema, table]["identity"] = identity

    def engine_version(self) -> str:
        return self.version

    def server_time(self) -> datetime.datetime:
        return self.now or datetime.datetime.now(datetime.UTC)


class SparkCatalog:
    """Tables of a Spark catalog: an external table, partitioned by a column ``part_name``.

    The bounds and the state of a partition are properties of its table, so that a change of them is
    one statement. Every partition is registered as a table of its own on the same folder, so that it
    can be read when it has been detached, and names its parent. A detach that was broken off leaves
    the state "pending" and is ended by ``finalize_detach``. Indexes, constraints and replication have
    no likeness here: a replica identity is a property that is copied.

    A statement that takes longer than ``statement_timeout`` milliseconds is interrupted and fails.
    Attaching and detaching hold a lock of the parent, a file in its folder; where another engine holds
    it for ``lock_timeout`` milliseconds, the action fails. 0 waits for ever. A lock that has been left
    by an engine that is gone is taken over after STALE seconds.
    """

    STRATEGY, KEY, TYPE, IDENTITY, PART = "range.strategy", "range.key", "range.type", "range.identity", "range.part."
    PARENT, LOCK, STALE = "range.parent", "_range_lock", 600
    #: Spark's own version: tables with times without an offset as keys need it.
    min_version = 4

    def __init__(self, spark: SparkSession, lock_timeout: int = 0, statement_timeout: int = 0):
        self.spark, self.lock_timeout, self.statement_timeout = spark, lock_timeout, statement_timeout

    def _sql(self, statement: str) -> list:
        """Rows of a statement, within the time that it may take."""
        if not self.statement_timeout:
            return self.spark.sql(statement).collect()
        group = f"range-{uuid.uuid4()}"

        def run() -> list:
            self.spark.sparkContext.setJobGroup(group, "a statement on the catalog", True)
            return self.spark.sql(statement).collect()

        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(run).result(self.statement_timeout / 1000)
        except Late:
            self.spark.sparkContext.cancelJobGroup(group)
            raise RangeError(errors.STATEMENT_TIMEOUT, statement.split(" ")[0]) from None
        finally:
            pool.shutdown(wait=False)

    @contextlib.contextmanager
    def _locked(self, schema: str, parent: str) -> Iterator[None]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._location(schema, parent)}/{self.LOCK}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        until = time.monotonic() + self.lock_timeout / 1000
        while not files.createNewFile(path):
            if files.exists(path) and time.time() - files.getFileStatus(path).getModificationTime() / 1000 > self.STALE:
                files.delete(path, False)
            elif self.lock_timeout and time.monotonic() > until:
                raise RangeError(errors.LOCK_TIMEOUT, f"{schema}.{parent}")
            else:
                time.sleep(0.01)
        try:
            yield
        finally:
            files.delete(path, False)

    def _properties(self, schema: str, table: str) -> dict[str, str]:
        if not self.table_exists(schema, table):
            return {}
        return {r.key: r.value for r in self._sql(f"SHOW TBLPROPERTIES {names.quoted(schema, table)}")}

    @staticmethod
    def _literal(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def _set(self, schema: str, table: str, name: str, value: dict) -> None:
        pair = f"{self._literal(self.PART + name)} = {self._literal(json.dumps(value))}"
        self._sql(f"ALTER TABLE {names.quoted(schema, table)} SET TBLPROPERTIES ({pair})")

    def _unset(self, schema: str, table: str, name: str) -> None:
        self._sql(f"ALTER TABLE {names.quoted(schema, table)} UNSET TBLPROPERTIES IF EXISTS ({self._literal(self.PART + name)})")

    def _part(self, schema: str, table: str, parent: str) -> dict | None:
        found = self._properties(schema, parent).get(self.PART + table)
        return json.loads(found) if found else None

    def _location(self, schema: str, table: str) -> str:
        rows = self._sql(f"DESCRIBE TABLE EXTENDED {names.quoted(schema, table)}")
        described = {r.col_name: r.data_type for r in rows}
        if described.get("Type") != "EXTERNAL":
            raise RangeError(errors.NOT_PARTITIONED, f"{schema}.{table} is not an external table")
        return described["Location"]

    def create_parent(self, schema: str, table: str, columns: str, key: str, location: str, key_type: str | None = None) -> None:
        """An empty table that is partitioned by range of ``key``; ``key_type`` tells a uuid from a text."""
        kind = f", '{self.TYPE}' = '{key_type}'" if key_type else ""
        self._sql(
            f"CREATE TABLE {names.quoted(schema, table)} ({columns}, part_name STRING) USING parquet PARTITIONED BY (part_name)"
            f" LOCATION {self._literal(location)} TBLPROPERTIES ('{self.STRATEGY}' = 'RANGE', '{self.KEY}' = {self._literal(key)}{kind})"
        )

    def list_partitions(self, schema: str, table: str) -> list[tuple]:
        found = self._properties(schema, table)
        parts = {k.removeprefix(self.PART): json.loads(v) for k, v in found.items() if k.startswith(self.PART)}
        return sorted((table, schema, n, p["lower"], p["upper"]) for n, p in parts.items())

    def column_type(self, schema: str, table: str, column: str) -> str:
        given = self._properties(schema, table).get(self.TYPE)
        if given is None:
            kinds = {T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamp with time zone"}
            fields = {f.name: f.dataType for f in self.spark.table(names.quoted(schema, table)).schema} if self.table_exists(schema, table) else {}
            given = kinds.get(type(fields.get(column)))
        if names.TYPE_NAMES.get(given or "") is None:
            raise RangeError(errors.UNSUPPORTED_KEY_TYPE, f"{schema}.{table}.{column}")
        return names.TYPE_NAMES[given]

    def partition_settings(self, schema: str, table: str) -> tuple[str, str]:
        found = self._properties(schema, table)
        if self.STRATEGY not in found or self.KEY not in found:
            raise RangeError(errors.NOT_PARTITIONED, f"{schema}.{table}")
        return found[self.STRATEGY], found[self.KEY]

    def table_exists(self, schema: str, table: str) -> bool:
        return self.spark.catalog.tableExists(names.quoted(schema, table))

    def is_attached(self, schema: str, table: str) -> bool:
        """To any parent."""
        return self.PARENT in self._properties(schema, table)

    def create_like(self, schema: str, table: str, parent: str) -> None:
        folder = f"{self._location(schema, parent)}/part_name={table}"
        columns = [f for f in self.spark.table(names.quoted(schema, parent)).schema if f.name != "part_name"]
        listed = ", ".join(f"{names.quoted(f.name)} {f.dataType.simpleString()}" for f in columns)
        self._sql(f"CREATE TABLE IF NOT EXISTS {names.quoted(schema, table)} ({listed}) USING parquet LOCATION {self._literal(folder)}")

    def attach(self, schema: str, table: str, parent: str, lower: str, upper: str) -> None:
        folder = self._location(schema, table)
        with self._locked(schema, parent):
            self._sql(
                f"ALTER TABLE {names.quoted(schema, parent)} ADD IF NOT EXISTS PARTITION (part_name = {self._literal(table)}) LOCATION {self._literal(folder)}"
            )
            self._set(schema, parent, table, {"lower": lower, "upper": upper, "state": "attached"})
            self._sql(f"ALTER TABLE {names.quoted(schema, table)} SET TBLPROPERTIES ('{self.PARENT}' = {self._literal(parent)})")

    def detach(self, schema: str, table: str, parent: str) -> None:
        part = self._part(schema, table, parent)
        if part is None:
            raise RangeError("NOT_ATTACHED", f"{schema}.{table}")
        if part["state"] == "pending":
            raise DetachPending(f"{schema}.{table}")
        with self._locked(schema, parent):
            self._set(schema, parent, table, part | {"state": "pending"})
        self.finalize_detach(schema, table, parent)

    def finalize_detach(self, schema: str, table: str, parent: str) -> None:
        with self._locked(schema, parent):  # which fails for a table that is not external: its files would go
            self._sql(f"ALTER TABLE {names.quoted(schema, parent)} DROP IF EXISTS PARTITION (part_name = {self._literal(table)})")
            if self.table_exists(schema, table):
                self._sql(f"ALTER TABLE {names.quoted(schema, table)} UNSET TBLPROPERTIES IF EXISTS ('{self.PARENT}')")
            self._unset(schema, parent, table)

    def drop(self, schema: str, table: str) -> None:
        folder = self._location(schema, table)
        self._sql(f"DROP TABLE {names.quoted(schema, table)}")
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def copy_identity(self, schema: str, table: str, parent: str) -> None:
        identity = self._properties(schema, parent).get(self.IDENTITY)
        if identity in ("f", "i"):
            self._sql(f"ALTER TABLE {names.quoted(schema, table)} SET TBLPROPERTIES ('{self.IDENTITY}' = '{identity}')")

    def engine_version(self) -> str:
        return self.spark.version

    def server_time(self) -> datetime.datetime:
        return datetime.datetime.fromtimestamp(self._sql("SELECT unix_micros(current_timestamp())")[0][0] / 1e6, datetime.UTC)


def raw_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(set_name, RAW_PARTITIONS) as a DataFrame, of rows that a catalog lists."""
    return spark.createDataFrame(rows, "set_name string, " + RAW_PARTITIONS)
