"""Floors, steps and names of intervals against known dates."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rangeparts.functions import calendar
from rangeparts.operators.expected import expected_partitions, pre_provisioned_partitions, retained_partitions
from rangeparts.schemas import CONFIGS, INTERVALS

FLOORS = [
    ("daily", "2024-02-29 12:00:00", "2024-02-29", "2024-03-01"),
    ("daily", "2024-12-31 00:00:00", "2024-12-31", "2025-01-01"),
    ("weekly", "2024-01-07 23:59:59", "2024-01-01", "2024-01-08"),
    ("weekly", "2024-01-31 00:00:00", "2024-01-29", "2024-02-05"),
    ("weekly", "2023-12-31 00:00:00", "2023-12-25", "2024-01-01"),
    ("monthly", "2024-01-31 00:00:00", "2024-01-01", "2024-02-01"),
    ("monthly", "2024-12-31 00:00:00", "2024-12-01", "2025-01-01"),
    ("quarterly", "2024-05-15 00:00:00", "2024-04-01", "2024-07-01"),
    ("quarterly", "2024-12-31 00:00:00", "2024-10-01", "2025-01-01"),
    ("yearly", "2024-02-29 00:00:00", "2024-01-01", "2025-01-01"),
]
STEPS = [
    ("daily", "2024-03-01", -1, "2024-02-29"),
    ("weekly", "2026-03-15", -4, "2026-02-15"),
    ("monthly", "2026-03-31", -1, "2026-02-01"),
    ("monthly", "2026-01-15", -1, "2025-12-01"),
    ("quarterly", "2026-03-31", -4, "2025-01-01"),
    ("quarterly", "2026-05-31", -1, "2026-01-01"),
    ("quarterly", "2026-03-31", 4, "2027-01-01"),
    ("yearly", "2026-12-31", -5, "2021-01-01"),
    ("monthly", "2026-03-31", 1, "2026-04-01"),
]
NAMES = [
    ("daily", "2024-02-29", "2024_02_29"),
    ("weekly", "2024-12-30", "2025_w01"),
    ("weekly", "2027-01-01", "2026_w53"),
    ("weekly", "2024-02-28", "2024_w09"),
    ("monthly", "2024-02-29", "2024_02"),
    ("quarterly", "2024-12-31", "2024_q4"),
    ("yearly", "2024-02-29", "2024"),
]


def configs(spark, *sets):
    return spark.createDataFrame([(f"s{k}", "public", "t", "k", i, r, p, "drop") for k, (i, r, p) in enumerate(sets)], CONFIGS)


def test_floors(spark):
    rows = spark.createDataFrame(FLOORS, "interval string, at string, lo string, hi string")
    at, interval = F.col("at").cast("timestamp_ntz"), F.col("interval")
    got = rows.select(calendar.floor(at, interval).cast("string"), calendar.following(calendar.floor(at, interval), interval).cast("string"))
    assert [tuple(r) for r in got.collect()] == [f[2:] for f in FLOORS]


def test_steps(spark):
    rows = spark.createDataFrame(STEPS, "interval string, d string, i int, to string")
    got = rows.select(calendar.step(F.col("d"), F.col("interval"), F.col("i")).cast("string")).collect()
    assert [r[0] for r in got] == [s[3] for s in STEPS]


def test_names(spark):
    rows = spark.createDataFrame(NAMES, "interval string, d string, name string")
    assert [r[0] for r in rows.select(calendar.suffix(F.col("d"), F.col("interval"))).collect()] == [n[2] for n in NAMES]


def test_an_unknown_interval_raises(spark):
    with pytest.raises(ValueError, match="UNSUPPORTED_INTERVAL"):
        calendar.floor("d", "hourly")
    with pytest.raises(Exception, match="UNSUPPORTED_INTERVAL"):
        expected_partitions(configs(spark, ("hourly", 1, 1)), dt.date(2024, 1, 1)).collect()


SETS = [
    ("daily", 2, 2), ("daily", 0, 1), ("daily", 4, 0), ("weekly", 2, 2), ("quarterly", 2, 2), ("monthly", 2, 2), ("yearly", 4, 4),
    ("daily", 0, 0), ("daily", 7, 3), ("weekly", 4, 2), ("monthly", 12, 3), ("quarterly", 40, 2), ("yearly", 10, 2), ("quarterly", 404, 0),
]


@pytest.mark.parametrize("day", [dt.date(2026, 3, 31), dt.date(2024, 2, 29), dt.date(2023, 12, 31), dt.date(2025, 8, 30)])
def test_expected_partitions_are_contiguous(spark, day):
    rows = expected_partitions(configs(spark, *SETS), day).orderBy("set_name", "lo").collect()
    for k, (interval, retention, ahead) in enumerate(SETS):
        mine = [r for r in rows if r.set_name == f"s{k}"]
        assert len(mine) == retention + 1 + ahead, interval
        assert all(a.hi == b.lo for a, b in zip(mine, mine[1:], strict=False))
        assert len({r.name for r in mine}) == len(mine)
        assert [r.i for r in mine] == list(range(-retention, ahead + 1))
        now = next(r for r in mine if r.i == 0)
        assert now.lo.date() <= day < now.hi.date()


def test_parts_of_the_expected_partitions(spark):
    c = configs(spark, ("monthly", 2, 3), ("daily", 0, 0))
    day = dt.date(2025, 1, 20)
    assert sorted(r.i for r in retained_partitions(c, day).collect()) == [-2, -1]
    assert sorted(r.i for r in pre_provisioned_partitions(c, day).collect()) == [1, 2, 3]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(days=st.lists(st.dates(dt.date(1971, 1, 1), dt.date(2200, 1, 1)), min_size=1, max_size=30), interval=st.sampled_from(INTERVALS))
def test_a_floor_is_in_its_own_interval(spark, days, interval):
    rows = spark.createDataFrame([(d,) for d in days], "d date")
    lo = calendar.floor("d", interval)
    hi = calendar.following(lo, interval)
    got = rows.select("d", lo.alias("lo"), hi.alias("hi"), calendar.floor(lo, interval).alias("again"), calendar.suffix("d", interval).alias("n"), calendar.suffix(lo, interval).alias("m"))
    for r in got.collect():
        assert r.lo <= r.d < r.hi and r.again == r.lo and r.n == r.m
