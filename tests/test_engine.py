"""Engine, catalogs, configuration and command line."""

import datetime as dt
import io
import json
import logging
import time

import pytest

from rangeparts import errors
from rangeparts.__main__ import main
from rangeparts.engine import Engine
from rangeparts.logs import logger, say
from rangeparts.retry import with_retry
from rangeparts.schemas import CONFIGS
from rangeparts.sources import config
from rangeparts.sources.catalog import FrameCatalog, SparkCatalog

DAY = dt.date(2025, 2, 1)


def quiet():
    return logger(stream=io.StringIO())


def engine(spark, catalog, *sets, day=DAY):
    """Sets (table, interval, retention, pre-provisioned[, policy[, key]])."""
    rows = [(t, "public", t, (rest[1:] or ("created_at",))[0], i, r, p, (rest or ("drop",))[0]) for t, i, r, p, *rest in sets]
    return Engine(spark, catalog, spark.createDataFrame(rows, CONFIGS), day, quiet(), sleep=lambda s: None)


def catalog_with(*tables, kind="date"):
    c = FrameCatalog()
    for t in tables:
        c.add_parent("public", t, "created_at", kind)
    return c


def listing(catalog, table):
    return [r[2:] for r in catalog.list_partitions("public", table)]


def test_provisioning_two_sets(spark):
    c = catalog_with("a", "b")
    assert engine(spark, c, ("a", "daily", 1, 1), ("b", "daily", 2, 2)).provision()
    assert [n for n, *_ in listing(c, "a")] == ["a_2025_01_31", "a_2025_02_01", "a_2025_02_02"]
    assert listing(c, "b")[0] == ("b_2025_01_30", "2025-01-30", "2025-01-31") and len(listing(c, "b")) == 5
    calls = len(c.calls)
    assert engine(spark, c, ("a", "daily", 1, 1), ("b", "daily", 2, 2)).provision()
    assert len(c.calls) == calls  # nothing is done twice


def test_uuid_months_check_out(spark):
    c = catalog_with("u", kind="uuid")
    e = engine(spark, c, ("u", "monthly", 2, 2), day=dt.date(2025, 2, 10))
    assert e.provision()
    assert listing(c, "u") == [
        ("u_2024_12", "01937f84-5800-7000-8000-000000000000", "01941f29-7c00-7000-8000-000000000000"),
        ("u_2025_01", "01941f29-7c00-7000-8000-000000000000", "0194bece-a000-7000-8000-000000000000"),
        ("u_2025_02", "0194bece-a000-7000-8000-000000000000", "01954f00-b000-7000-8000-000000000000"),
        ("u_2025_03", "01954f00-b000-7000-8000-000000000000", "0195eea5-d400-7000-8000-000000000000"),
        ("u_2025_04", "0195eea5-d400-7000-8000-000000000000", "01968924-9c00-7000-8000-000000000000"),
    ]
    assert e.check()


def test_interval_change_end_to_end(spark):
    c = catalog_with("test_interv")
    assert engine(spark, c, ("test_interv", "monthly", 1, 1), day=dt.date(2025, 1, 20)).provision()
    e = engine(spark, c, ("test_interv", "weekly", 2, 10))
    assert e.provision()
    assert [n for n, *_ in sorted(listing(c, "test_interv"), key=lambda r: r[1])] == [
        "test_interv_2024_12", "test_interv_2025_01", "test_interv_2025_02", "test_interv_20250301_20250303",
        *(f"test_interv_2025_w{w}" for w in range(10, 16)),
    ]
    assert not e.check()  # the months are no weeks


def test_a_missing_parent_keeps_no_other_set_back(spark):
    c = catalog_with("b")
    assert not engine(spark, c, ("a", "daily", 1, 1), ("b", "daily", 1, 1)).provision()
    assert len(listing(c, "b")) == 3


def test_attaching_is_tried_again_and_identity_is_copied(spark):
    c = catalog_with("t")
    c.parents["public", "t"]["identity"] = "f"
    tries = []
    attach = c.attach

    def flaky(*a):
        tries.append(a)
        if len(tries) < 3:
            raise RuntimeError("lock timeout")
        attach(*a)

    c.attach = flaky
    assert engine(spark, c, ("t", "daily", 0, 0)).provision()
    assert len(tries) == 3 and c.tables["public", "t_2025_02_01"]["identity"] == "f"


def test_existing_tables_are_only_attached(spark):
    c = catalog_with("t")
    c.add_partition("public", "t_2025_02_01", "t", None, None, "free")
    assert engine(spark, c, ("t", "daily", 0, 0)).provision()
    assert [x[0] for x in c.calls] == ["attach", "identity"]


def test_cleanup_and_policies(spark):
    for policy, left in (("drop", 3), ("detach", 7)):
        c = catalog_with("t")
        engine(spark, c, ("t", "daily", 3, 3)).provision()
        assert engine(spark, c, ("t", "daily", 1, 1, policy)).clean_up()
        assert len(listing(c, "t")) == 3 and len(c.tables) == left


def test_a_gap_in_any_set_stops_all_cleanup(spark):
    c = catalog_with("a", "b")
    engine(spark, c, ("a", "daily", 3, 3), ("b", "daily", 3, 3)).provision()
    del c.tables["public", "b_2025_02_01"]
    before = dict(c.tables)
    assert not engine(spark, c, ("a", "daily", 1, 1), ("b", "daily", 1, 1)).clean_up()
    assert c.tables == before


def test_cleanup_goes_on_after_failures(spark):
    c = catalog_with("t")
    engine(spark, c, ("t", "daily", 5, 0)).provision()
    c.failing |= {("detach", "t_2025_01_27"), ("drop", "t_2025_01_28")}
    c.tables["public", "t_2025_01_29"]["state"] = "pending"
    assert not engine(spark, c, ("t", "daily", 1, 0)).clean_up()
    assert sorted(n for _, n in c.tables) == ["t_2025_01_27", "t_2025_01_28", "t_2025_01_31", "t_2025_02_01"]
    assert ("finalize", "public", "t_2025_01_29", "t") in c.calls
    assert sum(x[:3] == ("detach", "public", "t_2025_01_27") for x in c.calls) == 3


def test_check_tells_keys_apart(spark):
    c = catalog_with("good", "key")
    c.add_parent("public", "list", "created_at", "date", "LIST")
    c.add_parent("public", "text", "created_at", "text")
    sets = [("good", "daily", 1, 1), ("key", "daily", 1, 1, "drop", "updated_at"), ("list", "daily", 1, 1), ("text", "daily", 1, 1), ("none", "daily", 1, 1)]
    engine(spark, c, ("good", "daily", 1, 1)).provision()
    e = engine(spark, c, *sets)
    got = {r.set_name: r.error for r in e.results().collect()}
    assert got == {"good": None, "key": "KEY_MISMATCH", "list": "UNSUPPORTED_STRATEGY", "text": "UNSUPPORTED_KEY_TYPE", "none": "UNSUPPORTED_KEY_TYPE"}
    assert not e.check() and engine(spark, c, ("good", "daily", 1, 1)).check()


@pytest.mark.parametrize(("lower", "upper", "error"), [("x", "y", "UNDECODABLE_BOUNDS"), (None, "2025-01-01", "NULL_BOUND")])
def test_bounds_that_cannot_be_read(spark, lower, upper, error):
    c = catalog_with("t")
    c.add_partition("public", "t_default", "t", lower, upper)
    e = engine(spark, c, ("t", "daily", 1, 1))
    assert not e.provision() and not e.clean_up()
    assert [r.error for r in e.results().collect()] == [error]


def test_run_all(spark):
    c = catalog_with("t")
    assert engine(spark, c, ("t", "daily", 1, 1)).run_all() == errors.OK
    assert engine(spark, c, ("t", "daily", 1, 1), day=dt.date(2025, 2, 2)).run_all() == errors.OK
    assert [n[-2:] for n, *_ in listing(c, "t")] == ["01", "02", "03"]
    assert engine(spark, catalog_with(), ("t", "daily", 1, 1)).run_all() == errors.PROVISIONING_FAILED


def test_server(spark):
    engine(spark, FrameCatalog(), ("t", "daily", 1, 1)).check_server()
    for c, code in ((FrameCatalog("13.1"), "UNSUPPORTED_SERVER"), (FrameCatalog(now=dt.datetime(2020, 1, 1, tzinfo=dt.UTC)), "TIME_DRIFT")):
        with pytest.raises(errors.RangeError, match=code):
            engine(spark, c, ("t", "daily", 1, 1)).check_server()


def test_spark_catalog(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS life")
    c = SparkCatalog(spark)
    table = "logs"
    c.create_parent("life", table, "id BIGINT, created_at DATE", "created_at", str(tmp_path / "t"))
    rows = [("s", "life", table, "created_at", "daily", 1, 1, "detach")]
    make = lambda day: Engine(spark, c, spark.createDataFrame(rows, CONFIGS), day, quiet(), sleep=lambda s: None)
    e = make(DAY)
    e.check_server()
    assert e.run_all() == errors.OK
    assert [n for *_, n, _, _ in c.list_partitions("life", table)] == [f"{table}_2025_0{d}" for d in ("1_31", "2_01", "2_02")]
    spark.sql("INSERT INTO life.logs PARTITION (part_name = 'logs_2025_01_31') SELECT 7, DATE '2025-01-31'")
    spark.sql("REFRESH TABLE life.logs")
    assert spark.table("life.logs").count() == 1
    later = make(dt.date(2025, 2, 2))
    assert later.run_all() == errors.OK
    spark.sql("REFRESH TABLE life.logs")
    assert spark.table("life.logs").count() == 0  # detached
    assert spark.table("life.logs_2025_01_31").first().id == 7  # but still there
    c.drop("life", f"{table}_2025_01_31")
    assert not (tmp_path / "t" / f"part_name={table}_2025_01_31").exists()
    c._set("life", table, f"{table}_2025_02_01", {"lower": "2025-02-01", "upper": "2025-02-02", "state": "pending"})
    with pytest.raises(errors.DetachPending):
        c.detach("life", f"{table}_2025_02_01", table)
    c.finalize_detach("life", f"{table}_2025_02_01", table)
    assert not c.is_attached("life", f"{table}_2025_02_01") and c.is_attached("life", f"{table}_2025_02_02")
    assert not (tmp_path / "t" / c.LOCK).exists()
    (tmp_path / "t" / c.LOCK).touch()  # another engine is at work
    c.lock_timeout, began = 200, time.monotonic()
    with pytest.raises(errors.RangeError, match="LOCK_TIMEOUT"):
        c.detach("life", f"{table}_2025_02_02", table)
    assert 0.2 <= time.monotonic() - began < 10
    c.STALE = -1  # it is gone
    c.detach("life", f"{table}_2025_02_02", table)
    assert not c.is_attached("life", f"{table}_2025_02_02")
    with pytest.raises(errors.RangeError, match="NOT_PARTITIONED"):
        c.partition_settings("life", "nothing")
    with pytest.raises(errors.RangeError, match="UNSUPPORTED_KEY_TYPE"):
        c.column_type("life", table, "id")


def test_statements_have_their_time(spark):
    c = SparkCatalog(spark, statement_timeout=300)
    slow = "SELECT count(*) FROM range(2000000000) WHERE id % 7 = crc32(cast(id AS string)) % 7"
    with pytest.raises(errors.RangeError, match="STATEMENT_TIMEOUT"):
        c._sql(slow)
    c.statement_timeout = 60_000
    assert c._sql("SELECT 5")[0][0] == 5


def test_spark_has_a_least_version(spark):
    c = SparkCatalog(spark)
    engine(spark, c, ("t", "daily", 1, 1)).check_server()
    c.min_version = 99
    with pytest.raises(errors.RangeError, match="UNSUPPORTED_SERVER"):
        engine(spark, c, ("t", "daily", 1, 1)).check_server()


def test_tables_of_another_parent_are_left(spark):
    c = catalog_with("t", "other")
    c.add_partition("public", "t_2025_02_01", "other", "2020-01-01", "2020-01-02")
    assert engine(spark, c, ("t", "daily", 0, 0)).provision()
    assert c.calls == [] and c.tables["public", "t_2025_02_01"]["parent"] == "other"


def test_no_session(tmp_path, capsys):
    path = tmp_path / "c.yaml"
    path.write_text(YAML)

    def none():
        raise OSError("unreachable")

    assert main(["-c", str(path), "run", "all"], {}, none) == errors.NO_CONNECTION
    assert "unreachable" in capsys.readouterr().out


def test_names_with_signs(spark):
    c = catalog_with("table's name")
    e = engine(spark, c, ("table's name", "daily", 1, 1))
    assert e.run_all() == errors.OK
    assert [n for n, *_ in listing(c, "table's name")] == ["table's name_2025_01_31", "table's name_2025_02_01", "table's name_2025_02_02"]


def test_retry():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        with_retry(3, fails, waits.append)
    assert (len(calls), waits) == (3, [1, 2, 3])
    assert with_retry(3, lambda: 5, waits.append) == 5


YAML = """
debug: true
log-format: text
lock-timeout: 300
partitions:
  by_date: {schema: public, table: by_date, partitionKey: created_at, interval: yearly, retention: 1, preProvisioned: 1, cleanupPolicy: drop}
"""


def test_configuration(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(YAML)
    c = config.load(str(path), {"RANGEPARTS_LOCK_TIMEOUT": "200", "RANGEPARTS_DEBUG": "false"}, {"log-format": "json"})
    assert (c.debug, c.log_format, c.lock_timeout, c.statement_timeout) == (False, "json", 200, 3000)
    assert config.check(c, spark) == []
    assert tuple(c.frame(spark).first()) == ("by_date", "public", "by_date", "created_at", "yearly", 1, 1, "drop")
    path.write_text("")
    assert config.check(config.load(str(path), {}), spark) == ["'partitions' is required"]
    path.write_text(YAML.replace("yearly", "hourly").replace("retention: 1", "retention: 0"))
    assert len(config.check(config.load(str(path), {}), spark)) == 2
    for bad in ("partitions: [1]", "- 1", "a: [", "lock-timeout: x"):
        path.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(path), {})
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "no.yaml"), {})


def test_search_order(tmp_path):
    (tmp_path / "here").mkdir()
    (tmp_path / "home").mkdir()
    folders = (str(tmp_path / "here"), str(tmp_path / "home"))
    assert config.find_file(None, folders) is None
    (tmp_path / "home" / config.FILE).write_text("")
    assert config.find_file(None, folders).parent.name == "home"
    (tmp_path / "here" / config.FILE).write_text("")
    assert config.find_file(None, folders).parent.name == "here"


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "c.yaml"
    path.write_text(YAML)
    c = FrameCatalog()
    c.add_parent("public", "by_date", "created_at", "date")
    env = {"RANGEPARTS_WORK_DATE": "2025-02-01"}
    run = lambda *a, env=env, cat=c: main(["-c", str(path), *a], env, lambda: spark, lambda s: cat)
    assert run("validate") == errors.OK
    assert run("run", "check") == errors.CHECK_FAILED
    assert run("run", "provisioning") == errors.OK
    assert run("run", "check") == errors.OK
    assert run("run", "cleanup") == errors.OK
    assert run("run", "all") == errors.OK
    assert run("run", "all", env={"RANGEPARTS_WORK_DATE": "today"}) == errors.BAD_WORK_DATE
    assert run("run", "all", cat=FrameCatalog("13")) == errors.NO_CONNECTION
    assert run("run", "provisioning", cat=FrameCatalog()) == errors.PROVISIONING_FAILED
    del c.tables["public", "by_date_2025"]
    assert run("run", "cleanup") == errors.CLEANUP_FAILED
    path.write_text("")
    assert run("validate") == errors.BAD_CONFIG
    assert "'partitions' is required" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["--version"])


def test_log_lines():
    for form in ("json", "text"):
        out = io.StringIO()
        log = logger(False, form, out)
        say(log, logging.DEBUG, "hidden")
        say(log, logging.INFO, "shown", partition="p")
        line = out.getvalue()
        assert "hidden" not in line and "shown" in line
        if form == "json":
            assert json.loads(line)["partition"] == "p"
