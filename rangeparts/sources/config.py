"""Configuration: YAML file, environment and flags to a DataFrame of sets, and its validation."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeparts.schemas import CONFIGS, INTERVALS, POLICIES

FILE = "rangeparts.yaml"
PREFIX = "RANGEPARTS_"
#: Names in the file, and the type and default of each.
GLOBALS: dict[str, tuple[type, Any]] = {
    "debug": (bool, False),
    "log-format": (str, "json"),
    "connection-url": (str, ""),
    "lock-timeout": (int, 100),
    "statement-timeout": (int, 3000),
}
#: Names of a set in the file, and the column of each.
SET_FIELDS = {
    "schema": "schema",
    "table": "table",
    "partitionKey": "partition_key",
    "interval": "interval",
    "retention": "retention",
    "preProvisioned": "pre_provisioned",
    "cleanupPolicy": "cleanup_policy",
}


class ConfigError(Exception):
    """The file cannot be read, or a value is of the wrong type."""


@dataclass
class Config:
    debug: bool = False
    log_format: str = "json"
    connection_url: str = ""
    lock_timeout: int = 100
    statement_timeout: int = 3000
    partitions: dict[str, dict[str, Any]] = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        """A row for each set, in the order of CONFIGS; what is missing is null."""

        def value(s: Mapping, name: str):
            v = s.get(name)
            if v is None:
                return None
            if name in ("retention", "preProvisioned"):
                if isinstance(v, bool) or (not isinstance(v, int) and not str(v).lstrip("-").isdigit()):
                    raise ConfigError(f"{name} is not a whole number: {v!r}")
                return int(v)
            return str(v)

        return [(name, *(value(s or {}, f) for f in SET_FIELDS)) for name, s in sorted(self.partitions.items())]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), CONFIGS)


def find_file(path: str | None = None, folders: tuple[str, ...] | None = None) -> Path | None:
    """The file that is asked for; else that in the current folder, else that in the home folder, else none."""
    if path:
        if not Path(path).is_file():
            raise ConfigError(f"no such file: {path}")
        return Path(path)
    for folder in folders or (".", str(Path.home())):
        if (found := Path(folder) / FILE).is_file():
            return found
    return None


def _typed(name: str, value: Any) -> Any:
    kind = GLOBALS[name][0]
    if kind is bool:
        known = {"true": True, "1": True, "t": True, "false": False, "0": False, "f": False}
        if str(value).lower() not in known:
            raise ConfigError(f"{name} is not true or false: {value!r}")
        return known[str(value).lower()]
    try:
        return kind(value)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{name}: {value!r}") from e


def load(path: str | None = None, env: Mapping[str, str] | None = None, flags: Mapping[str, Any] | None = None) -> Config:
    """The configuration: a flag goes before the environment, that before the file, that before the default."""
    env = os.environ if env is None else env
    data: dict[str, Any] = {}
    if file := find_file(path):
        import yaml

        try:
            data = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
        except yaml.YAMLError as e:
            raise ConfigError(f"{file} is not YAML: {e}") from e
        if not isinstance(data, dict):
            raise ConfigError(f"{file} holds no settings")
    values = {}
    for name, (_, default) in GLOBALS.items():
        given = [
            (flags or {}).get(name),
            env.get(PREFIX + name.upper().replace("-", "_")),
            data.get(name),
            default,
        ]
        values[name.replace("-", "_")] = _typed(name, next(v for v in given if v is not None))
    partitions = data.get("partitions") or {}
    if not isinstance(partitions, dict) or not all(s is None or isinstance(s, dict) for s in partitions.values()):
        raise ConfigError("partitions is not a map of sets")
    return Config(**values, partitions=partitions)


def validation_errors(configs: DataFrame) -> DataFrame:
    """(set_name, field, tag, value, message) of every value that is not allowed.

    All fields are required, and zero counts as missing; interval and policy are of a list; counts are positive.
    """
    checks = []
    for name, column in SET_FIELDS.items():
        c = F.col(column)
        numeric = column in ("retention", "pre_provisioned")
        allowed = {"interval": INTERVALS, "cleanup_policy": POLICIES}.get(column)
        absent = c.isNull() | ((c == 0) if numeric else (c == ""))
        tag = F.when(absent, "required")
        if allowed:
            tag = tag.when(~c.isin(*allowed), "oneof")
        if numeric:
            tag = tag.when(c < 0, "gt")
        text = (
            F.when(absent, F.concat(F.lit(f"'{name}' of '"), "set_name", F.lit("' is required")))
            .otherwise(F.concat(F.lit(f"'{name}' of '"), "set_name", F.lit("' "), F.lit(f"must be one of {' '.join(allowed or ())}" if allowed else "must be positive")))
        )
        checks.append(
            F.when(tag.isNotNull(), F.struct(F.lit(name).alias("field"), tag.alias("tag"), c.cast("string").alias("value"), text.alias("message")))
        )
    found = F.array_compact(F.array(*checks))
    return configs.select("set_name", F.explode(found).alias("e")).select("set_name", "e.*")


def check(config: Config, spark: SparkSession) -> list[str]:
    """Messages of all that is wrong with a configuration; none if it can be used."""
    out = [f"'{n.replace('_', '-')}' is required" for n in ("lock_timeout", "statement_timeout") if not getattr(config, n)]
    if not config.partitions:
        return [*out, "'partitions' is required"]
    rows = validation_errors(config.frame(spark)).orderBy("set_name", "field").collect()
    return out + [r.message for r in rows]
