"""Command line: ``python -m rangeparts run all|check|cleanup|provisioning`` and ``validate``."""

from __future__ import annotations

import argparse
import datetime
import os
import sys
from collections.abc import Callable, Mapping

from rangeparts import __version__, errors
from rangeparts.logs import logger
from rangeparts.sources import config as configuration

WORK_DATE = configuration.PREFIX + "WORK_DATE"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="rangeparts", description="Manages the life cycle of time-range partitions.")
    out.add_argument("--version", action="version", version=__version__)
    out.add_argument("-c", "--config", help="configuration file")
    out.add_argument("-d", "--debug", action="store_const", const=True, help="debug lines")
    out.add_argument("-l", "--log-format", choices=("json", "text"))
    out.add_argument("-u", "--connection-url", help="master of the Spark session, such as yarn or spark://host:7077")
    out.add_argument("--lock-timeout", type=int, help="milliseconds that an action waits for another engine's lock of a table")
    out.add_argument("--statement-timeout", type=int, help="milliseconds that a statement on the catalog may take")
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="work on partitions")
    run.add_argument("work", choices=("all", "check", "cleanup", "provisioning"))
    commands.add_parser("validate", help="check the configuration")
    return out


def work_date(env: Mapping[str, str]) -> datetime.date:
    """The day that is planned for: today, or that of the environment, as YYYY-MM-DD."""
    given = env.get(WORK_DATE)
    if not given:
        return datetime.datetime.now().date()
    return datetime.datetime.strptime(given, "%Y-%m-%d").date()


def main(argv: list[str] | None = None, env: Mapping[str, str] | None = None, session: Callable | None = None, catalog: Callable | None = None) -> int:
    """The exit code. ``session`` makes the Spark session and ``catalog`` the catalog of it, if not the usual ones are meant."""
    args = parser().parse_args(argv)
    env = os.environ if env is None else env
    flags = {k: getattr(args, k.replace("-", "_")) for k in configuration.GLOBALS}
    try:
        settings = configuration.load(args.config, env, flags)
    except configuration.ConfigError as e:
        print(f"ERROR: {e}")
        return errors.BAD_CONFIG

    def usual():
        from pyspark.sql import SparkSession

        builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
        return (builder.master(settings.connection_url) if settings.connection_url else builder).getOrCreate()

    try:
        spark = (session or usual)()
    except Exception as e:
        print(f"ERROR: no session: {e}")
        return errors.NO_CONNECTION
    try:
        problems = configuration.check(settings, spark)
    except configuration.ConfigError as e:
        problems = [str(e)]
    for p in problems:
        print(f"ERROR: {p}")
    if problems:
        return errors.BAD_CONFIG
    if args.command == "validate":
        print("The configuration is valid")
        return errors.OK
    log = logger(settings.debug, settings.log_format)
    try:
        day = work_date(env)
    except ValueError:
        return errors.BAD_WORK_DATE
    from rangeparts.engine import Engine
    from rangeparts.sources.catalog import SparkCatalog

    try:
        kept = catalog(spark) if catalog else SparkCatalog(spark, settings.lock_timeout, settings.statement_timeout)
        engine = Engine(spark, kept, settings.frame(spark), day, log)
        engine.check_server()
    except Exception as e:
        log.error("server: %s", e)
        return errors.NO_CONNECTION
    if args.work == "all":
        return engine.run_all()
    work, code = {
        "check": (engine.check, errors.CHECK_FAILED),
        "cleanup": (engine.clean_up, errors.CLEANUP_FAILED),
        "provisioning": (engine.provision, errors.PROVISIONING_FAILED),
    }[args.work]
    return errors.OK if work() else code


if __name__ == "__main__":
    sys.exit(main())
