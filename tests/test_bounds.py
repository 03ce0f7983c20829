"""UUIDv7, bounds, names, versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rangeparts.functions import bounds, names, uuid7
from rangeparts.operators import keys

UUIDS = [
    ("2023-12-31 23:59:59", "018cc251-f018-7000-8000-000000000000"),
    ("2024-01-01 00:00:00", "018cc251-f400-7000-8000-000000000000"),
    ("2024-01-02 12:45:35", "018cca35-3998-7000-8000-000000000000"),
    ("2020-02-29 01:00:00", "01708e75-0a80-7000-8000-000000000000"),
    ("1996-12-20 00:39:57", "00c62614-6b48-7000-8000-000000000000"),
]
V7 = "018cc251-f400-7100-0000-000000000000"
PARSED = [
    ("2024-01-01", "2025-03-02", "2024-01-01 00:00:00", "2025-03-02 00:00:00"),
    ("2024-01-01 10:00:00", "2025-02-03 12:53:00", "2024-01-01 10:00:00", "2025-02-03 12:53:00"),
    ("2024-01-01 23:30:00-01", "2025-02-03 00:30:00+01", "2024-01-01 23:30:00", "2025-02-03 00:30:00"),
    (V7, "018cc778-5000-7100-0000-000000000000", "2024-01-01 00:00:00", "2024-01-02 00:00:00"),
    ("2025-01-02", "2025-01-01", "2025-01-02 00:00:00", "2025-01-01 00:00:00"),  # turned round: not the parser's concern
    (V7, "47568e76-fb49-11ee-b9c7-325096b39f47", None, None),
    ("ad5dac7a-fb46-11ee-be67-325096b39f47", V7, None, None),
    ("2024-01-01", "2024-01-02 00:00:00", None, None),
    ("2024-01-01", V7, None, None),
    ("2024-01-01 00:00:00", "2024-01-02 00:00:00+01", None, None),
    ("2024-01-01 00:00:00+05:30", "2024-01-02 00:00:00+05:30", None, None),  # only whole hours are known
    ("2024-02-30", "2024-03-01", None, None),
    ("", "", None, None),
    (None, "2024-01-01", None, None),
]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris", "America/Los_Angeles"])
def test_uuids(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame(UUIDS, "at string, u string")
        at = F.col("at").cast("timestamp_ntz")
        got = rows.select(uuid7.from_time(at), uuid7.to_time("u").cast("string"), uuid7.is_v7("u")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [tuple(r) for r in got] == [(u, at, True) for at, u in UUIDS]


def test_times_that_have_no_uuid(spark):
    one = spark.range(1)
    assert one.select(uuid7.from_time(F.lit(None).cast("timestamp_ntz"))).first()[0] is None
    with pytest.raises(Exception, match="before 1970"):
        one.select(uuid7.from_time(F.lit(dt.datetime(1969, 12, 31)).cast("timestamp_ntz"))).collect()
    for text in ("x", "47568e76-fb49-11ee-b9c7-325096b39f47", "018cc251f40071000000000000000000"):
        assert one.select(uuid7.to_time(F.lit(text))).first()[0] is None


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris"])
def test_parsing(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([p[:2] for p in PARSED], "lower string, upper string")
        b = bounds.parsed("lower", "upper")
        got = rows.select(b["lo"].cast("string"), b["hi"].cast("string"), bounds.parse_error("lower", "upper")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [tuple(r)[:2] for r in got] == [p[2:] for p in PARSED]
    assert [r[2] for r in got] == [None if p[2] else "UNDECODABLE_BOUNDS" for p in PARSED]


def test_formatting(spark):
    at = F.lit(dt.datetime(2024, 1, 1, 10)).cast("timestamp_ntz")
    got = spark.range(1).select(*(bounds.formatted(at, k) for k in ("date", "timestamp", "timestamp with time zone", "uuid"))).first()
    assert tuple(got) == ("2024-01-01", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "018cc251-f400-7000-8000-000000000000")
    assert spark.range(1).select(bounds.display(at, at)).first()[0] == "[ 01-01-2024 , 01-01-2024 ]"
    with pytest.raises(Exception, match="UNSUPPORTED_KEY_TYPE"):
        spark.range(1).select(bounds.formatted(at, "text")).collect()


def test_summer_time_bounds_are_what_the_clock_shows(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        got = spark.sql(
            "SELECT date_format(cast(cast('2025-03-24' AS timestamp_ntz) AS timestamp), 'yyyy-MM-dd HH:mm:ssx'),"
            " date_format(cast(cast('2025-03-31' AS timestamp_ntz) AS timestamp), 'yyyy-MM-dd HH:mm:ssx')"
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(got) == ("2025-03-24 00:00:00+01", "2025-03-31 00:00:00+02")


def test_texts_of_a_catalog(spark):
    rows = spark.createDataFrame([("FOR VALUES FROM ('a') TO ('b')", "RANGE (created_at)"), ("DEFAULT", "x")], "b string, k string")
    got = rows.select(names.lower_bound("b"), names.upper_bound("b"), names.strategy("k"), names.key("k")).collect()
    assert [tuple(r) for r in got] == [("a", "b", "RANGE", "created_at"), (None,) * 4]
    assert names.quoted("s", "a`b") == "`s`.`a``b`"


def test_versions_and_types(spark):
    rows = spark.createDataFrame([("16.2 (Debian 16.2-1.pgdg120+2)",), ("14.1",), ("garbage",)], "v string")
    assert [r[0] for r in rows.select(names.major_version("v")).collect()] == [16, 14, None]
    rows = spark.createDataFrame([("date",), ("timestamp without time zone",), ("timestamp",), ("timestamp with time zone",), ("UUID",), ("text",)], "t string")
    assert [r[0] for r in rows.select(names.key_type("t")).collect()] == ["date", "timestamp", "timestamp", "timestamp with time zone", "uuid", None]


def test_server_requirements(spark):
    now = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    cases = [("14.1", 0, None), ("14.1", 10, None), ("13.0", 0, "UNSUPPORTED_SERVER"), ("14.1", 30, "TIME_DRIFT"), ("14.1", -30, "TIME_DRIFT"), ("?", 0, "UNKNOWN_VERSION")]
    rows = spark.createDataFrame([(v, now + dt.timedelta(seconds=s), now) for v, s, _ in cases], "v string, a timestamp, b timestamp")
    assert [r[0] for r in rows.select(keys.server_error(F.col("v"), F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]
