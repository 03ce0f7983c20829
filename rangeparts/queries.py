"""Queries over the test tables, one for each operator, and their DuckDB SQL.

The partitions that "exist" are those that the keys of a table would be in: one for each month (or
other interval) in which it has a row.
"""

from __future__ import annotations

import datetime
import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeparts.engine import Engine
from rangeparts.functions import bounds, calendar, names, uuid7
from rangeparts.logs import logger
from rangeparts.operators import diff, keys, ranges, routing
from rangeparts.operators.expected import expected_partitions, partition_for, pre_provisioned_partitions, retained_partitions
from rangeparts.plans import check, cleanup, provision, status
from rangeparts.schemas import CONFIGS, INTERVALS
from rangeparts.sources import config
from rangeparts.sources.catalog import FrameCatalog, described_partitions, typed_partitions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WORK_DATE = datetime.date(1998, 11, 20)


def query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def configs(spark: SparkSession, *rows: tuple) -> DataFrame:
    """Sets (name, interval, retention, pre-provisioned[, policy]) of the table ``orders``."""
    return spark.createDataFrame([(n, "public", "orders", "o_orderdate", i, r, p, *(rest or ("drop",))) for n, i, r, p, *rest in rows], CONFIGS)


def existing(spark: SparkSession, sf_dir: str, interval: str = "monthly", set_name: str = "s") -> DataFrame:
    """A partition for each interval in which ``orders`` has a row; one pass, summed up before it is shuffled."""
    days = table(spark, sf_dir, "orders").select(calendar.floor("o_orderdate", interval).alias("d")).distinct()
    return days.select(F.lit(set_name).alias("set_name"), F.lit("orders").alias("parent_table"), F.lit("public").alias("schema"), partition_for("d", interval, F.lit("orders")).alias("p")).select(
        "set_name", "parent_table", "schema", "p.*"
    )


# -- the same in SQL -------------------------------------------------------------------------------

_UNIT = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}


def sql_floor(d: str, interval: str) -> str:
    return f"date_trunc('{_UNIT[interval]}', {d})::DATE"


def sql_step(d: str, interval: str, i: str) -> str:
    if interval in ("daily", "weekly"):
        return f"({d} + {7 if interval == 'weekly' else 1} * ({i})::INT)"
    months = {"monthly": 1, "quarterly": 3, "yearly": 12}[interval]
    return f"(date_trunc('{_UNIT[interval]}', {d}) + to_months(({months} * ({i}))::INT))::DATE"


def sql_suffix(d: str, interval: str) -> str:
    return {
        "daily": f"strftime({d}, '%Y_%m_%d')",
        "weekly": f"printf('%d_w%02d', isoyear({d}), weekofyear({d}))",
        "monthly": f"strftime({d}, '%Y_%m')",
        "quarterly": f"printf('%d_q%d', year({d}), quarter({d}))",
        "yearly": f"strftime({d}, '%Y')",
    }[interval]


def sql_expected(anchor: str, interval: str, first: int, last: int, set_name: str = "s") -> str:
    """SELECT of the partitions from ``first`` to ``last`` (counted from that of the anchor)."""
    lo = sql_floor("d", interval)
    return f"""
SELECT '{set_name}' AS set_name, 'orders' AS parent_table, 'public' AS schema, 'orders_' || {sql_suffix("d", interval)} AS name,
  {lo}::TIMESTAMP AS lo, {sql_step(lo, interval, "1")}::TIMESTAMP AS hi, i::INT AS i
FROM (SELECT i, {sql_step("a", interval, "i")} AS d FROM (SELECT {anchor} AS a), (SELECT unnest(range({first}, {last + 1})) AS i))"""


def sql_existing(interval: str = "monthly", set_name: str = "s") -> str:
    return f"""
SELECT DISTINCT '{set_name}' AS set_name, 'orders' AS parent_table, 'public' AS schema, 'orders_' || {sql_suffix("d", interval)} AS name,
  d::TIMESTAMP AS lo, {sql_step("d", interval, "1")}::TIMESTAMP AS hi
FROM (SELECT {sql_floor("o_orderdate", interval)} AS d FROM orders)"""


DAY = "DATE '1998-11-20'"
LAST_DAY = "(SELECT max(o_orderdate)::DATE FROM orders)"


def _last_day(spark: SparkSession, sf_dir: str) -> datetime.date:
    return table(spark, sf_dir, "orders").agg(F.max("o_orderdate").cast("date")).first()[0]


# -- calendars ---------------------------------------------------------------------------------------


def _calendars() -> None:
    for interval in INTERVALS:
        @query(f"expected_{interval}", sql_expected(LAST_DAY, interval, -5, 3))
        def expected(spark, sf_dir, interval=interval):
            return expected_partitions(configs(spark, ("s", interval, 5, 3)), _last_day(spark, sf_dir))

        @query(f"floor_{interval}", f"SELECT {sql_floor('l_shipdate', interval)} AS lo, count(*) AS n FROM lineitem GROUP BY 1")
        def floors(spark, sf_dir, interval=interval):
            return table(spark, sf_dir, "lineitem").groupBy(calendar.floor("l_shipdate", interval).alias("lo")).agg(F.count("*").alias("n"))

        @query(
            f"step_{interval}",
            f"SELECT DISTINCT o_orderdate::DATE AS d, {sql_step('o_orderdate::DATE', interval, '-4')} AS back, {sql_step('o_orderdate::DATE', interval, '4')} AS ahead FROM orders",
        )
        def steps(spark, sf_dir, interval=interval):
            d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
            return d.select("d", calendar.step("d", interval, -4).alias("back"), calendar.step("d", interval, 4).alias("ahead"))

        @query(
            f"partition_names_{interval}{'_iso' if interval == 'weekly' else ''}",
            f"SELECT 'orders_' || {sql_suffix('o_orderdate', interval)} AS name, count(*) AS n FROM orders GROUP BY 1",
        )
        def named(spark, sf_dir, interval=interval):
            name = names.partition_name(F.lit("orders"), calendar.suffix("o_orderdate", interval))
            return table(spark, sf_dir, "orders").groupBy(name.alias("name")).agg(F.count("*").alias("n"))


_calendars()
_SETS = (("d", "daily", 7, 3), ("m", "monthly", 12, 3), ("q", "quarterly", 8, 2), ("w", "weekly", 4, 2), ("y", "yearly", 10, 2))


@query("expected_all_sets", " UNION ALL ".join(sql_expected(LAST_DAY, i, -r, p, n) for n, i, r, p in _SETS))
def expected_all_sets(spark, sf_dir):
    return expected_partitions(configs(spark, *_SETS), _last_day(spark, sf_dir))


@query("expected_without_others", sql_expected(LAST_DAY, "daily", 0, 0))
def expected_without_others(spark, sf_dir):
    return expected_partitions(configs(spark, ("s", "daily", 0, 0)), _last_day(spark, sf_dir))


@query("retained_partitions", sql_expected(LAST_DAY, "quarterly", -6, -1))
def retained(spark, sf_dir):
    return retained_partitions(configs(spark, ("s", "quarterly", 6, 2)), _last_day(spark, sf_dir))


@query("pre_provisioned_partitions", sql_expected(LAST_DAY, "weekly", 1, 4))
def pre_provisioned(spark, sf_dir):
    return pre_provisioned_partitions(configs(spark, ("s", "weekly", 6, 4)), _last_day(spark, sf_dir))


# -- UUIDs and bounds --------------------------------------------------------------------------------

_UUID = "lpad(lower(to_hex(epoch_us(ts) // 1000)), 12, '0')"


@query(
    "uuid7_encode",
    f"SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-7000-8000-000000000000' AS uuid FROM (SELECT event_id, {_UUID} AS h FROM events)",
)
def uuid7_encode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", uuid7.from_time("ts").alias("uuid"))


@query("uuid7_roundtrip", "SELECT event_id, true AS is_v7, make_timestamp(epoch_us(ts) // 1000 * 1000) AS at FROM events")
def uuid7_roundtrip(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("event_id", uuid7.from_time("ts").alias("u"))
    return u.select("event_id", uuid7.is_v7("u").alias("is_v7"), uuid7.to_time("u").alias("at"))


_BOUNDS = (
    (1, "2024-01-01", "2025-03-02"), (2, "2024-01-01 10:00:00", "2025-02-03 12:53:00"), (3, "2024-01-01 23:30:00-01", "2025-02-03 00:30:00+01"),
    (4, "018cc251-f400-7100-0000-000000000000", "018cc778-5000-7100-0000-000000000000"),
    (5, "018cc251-f400-7100-0000-000000000000", "47568e76-fb49-11ee-b9c7-325096b39f47"),
    (6, "2024-01-01", "2024-01-02 00:00:00"), (7, "2024-01-01", "018cc251-f400-7100-0000-000000000000"), (8, "2024-01-01 23:30:00+05:30", "2024-02-01 23:30:00+05:30"),
    (9, "2024-02-30", "2024-03-01"), (10, "", "x"), (11, None, "2024-01-01"), (12, "2024-01-01 00:00:00.5", "2024-01-02 00:00:00.250000"),
)


def _values(rows, *columns: str) -> str:
    def text(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({', '.join(columns)})"


_SQL_FORMS = {
    "day": (r"^\d{4}-\d{2}-\d{2}$", "try_cast({x} AS TIMESTAMP)"),
    "clock": (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$", "try_cast({x} AS TIMESTAMP)"),
    "offset": (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?[+-]\d{2}$", "try_cast(left({x}, length({x}) - 3) AS TIMESTAMP)"),
    "uuid": (
        r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}$",
        "make_timestamp(CASE WHEN regexp_matches({x}, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-') THEN ('0x' || substr(replace({x}, '-', ''), 1, 12))::BIGINT * 1000 END)",
    ),
}


def _sql_both(x: str) -> str:
    """The bound ``x`` where both bounds are of one form."""
    cases = []
    for form, time in _SQL_FORMS.values():
        lo, hi = time.format(x="lower"), time.format(x="upper")
        fits = f"regexp_matches(lower, '{form}') AND regexp_matches(upper, '{form}')"
        cases.append(f"WHEN {fits} AND {lo} IS NOT NULL AND {hi} IS NOT NULL THEN {lo if x == 'lower' else hi}")
    return f"CASE {' '.join(cases)} END"


@query(
    "parse_bounds_mixed",
    f"SELECT id, {_sql_both('lower')} AS lo, {_sql_both('upper')} AS hi, CASE WHEN {_sql_both('lower')} IS NULL THEN 'UNDECODABLE_BOUNDS' END AS error"
    f" FROM {_values(_BOUNDS, 'id', 'lower', 'upper')}",
)
def parse_bounds_mixed(spark, sf_dir):
    rows = spark.createDataFrame(list(_BOUNDS), "id int, lower string, upper string")
    b = bounds.parsed("lower", "upper")
    return rows.select("id", b["lo"].alias("lo"), b["hi"].alias("hi"), bounds.parse_error("lower", "upper").alias("error"))


_TYPES = ("date", "timestamp", "timestamp with time zone", "uuid")
_SQL_UUID_DAY = "(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-7000-8000-000000000000' FROM (SELECT lpad(lower(to_hex(epoch_us(lo) // 1000)), 12, '0') AS h))"


@query(
    "format_bounds_by_type",
    f"WITH e AS ({sql_existing()}), t AS (SELECT * FROM {_values([(t,) for t in _TYPES], 'key_type')})"
    f" SELECT name, key_type, CASE key_type WHEN 'date' THEN strftime(lo, '%Y-%m-%d') WHEN 'uuid' THEN {_SQL_UUID_DAY}"
    " ELSE strftime(lo, '%Y-%m-%d 00:00:00') END AS bound, '[ ' || strftime(lo, '%d-%m-%Y') || ' , ' || strftime(hi, '%d-%m-%Y') || ' ]' AS shown FROM e, t",
)
def format_bounds_by_type(spark, sf_dir):
    rows = existing(spark, sf_dir).select("name", "lo", "hi", F.explode(F.array(*map(F.lit, _TYPES))).alias("key_type"))
    return rows.select("name", "key_type", bounds.formatted("lo", F.col("key_type")).alias("bound"), bounds.display("lo", "hi").alias("shown"))


_CHILDREN = (
    ("logs", "public", "logs_2024_01", "r", "FOR VALUES FROM ('2024-01-01') TO ('2024-02-01')"),
    ("logs", "public", "logs_2024_02", "r", "FOR VALUES FROM ('2024-02-01 00:00:00') TO ('2024-03-01 00:00:00')"),
    ("logs", "public", "logs_default", "r", "DEFAULT"),
    ("logs", "public", "logs_min", "r", "FOR VALUES FROM (MINVALUE) TO ('2024-01-01')"),
    ("logs", "public", "logs_sub", "p", "FOR VALUES FROM ('2024-03-01') TO ('2024-04-01')"),
)


@query(
    "list_partitions_regex",
    "WITH c AS (SELECT parent_table, schema, name, nullif(regexp_extract(expression, $$FOR VALUES FROM \\('(.*)'\\) TO \\('(.*)'\\)$$, 1), '') AS lower,"
    " nullif(regexp_extract(expression, $$FOR VALUES FROM \\('(.*)'\\) TO \\('(.*)'\\)$$, 2), '') AS upper"
    f" FROM {_values(_CHILDREN, 'parent_table', 'schema', 'name', 'kind', 'expression')} WHERE kind = 'r')"
    f" SELECT parent_table, schema, name, {_sql_both('lower')} AS lo, {_sql_both('upper')} AS hi,"
    " CASE WHEN lower IS NULL OR upper IS NULL THEN 'NULL_BOUND' END AS error FROM c",
)
def list_partitions_regex(spark, sf_dir):
    rows = spark.createDataFrame(list(_CHILDREN), "parent_table string, schema string, name string, kind string, expression string")
    return typed_partitions(described_partitions(rows).withColumn("set_name", F.lit("s"))).drop("set_name")


# -- ranges ------------------------------------------------------------------------------------------

#: Months that are taken out to make holes, and one whose bounds are turned round.
_OUT, _TURNED = ("orders_1996_03", "orders_1997_07", "orders_1997_08"), "orders_1999_05"
_OUT_SQL = ", ".join(f"'{n}'" for n in _OUT)


def _broken(spark, sf_dir):
    rows = existing(spark, sf_dir).where(~F.col("name").isin(*_OUT))
    turned = F.col("name") == _TURNED
    return rows.withColumns({"lo": F.when(turned, F.col("hi")).otherwise(F.col("lo")), "hi": F.when(turned, F.col("lo")).otherwise(F.col("hi"))})


_BROKEN = f"""
SELECT set_name, parent_table, schema, name, CASE WHEN name = '{_TURNED}' THEN hi ELSE lo END AS lo, CASE WHEN name = '{_TURNED}' THEN lo ELSE hi END AS hi
FROM ({sql_existing()}) WHERE name NOT IN ({_OUT_SQL})"""


def _sql_checked(rows: str) -> str:
    return f"""
SELECT *, CASE WHEN before IS NOT NULL AND before <> lo THEN 'GAP' WHEN lo >= hi THEN 'INCOHERENT_BOUNDS' END AS error,
  CASE WHEN before < lo THEN 'hole' WHEN before > lo THEN 'overlap' END AS detail
FROM (SELECT *, lag(hi) OVER (PARTITION BY set_name ORDER BY lo, hi, name) AS before FROM ({rows}))"""


def _sql_range(rows: str) -> str:
    return f"""
SELECT set_name, min(lo) AS lo, max(hi) AS hi, count(*) AS n_parts, count(*) FILTER (error = 'GAP') AS n_gaps,
  count(*) FILTER (error = 'INCOHERENT_BOUNDS') AS n_incoherent, (min((lo, hi, name, error)) FILTER (error IS NOT NULL))[4] AS error
FROM ({_sql_checked(rows)}) GROUP BY set_name"""


@query("global_range", _sql_range(sql_existing()))
def global_range(spark, sf_dir):
    return ranges.global_range(existing(spark, sf_dir))


@query("first_range_error", _sql_range(_BROKEN))
def first_range_error(spark, sf_dir):
    return ranges.global_range(_broken(spark, sf_dir))


@query("gap_detection", f"SELECT name, lo, hi, detail FROM ({_sql_checked(_BROKEN)}) WHERE error = 'GAP'")
def gap_detection(spark, sf_dir):
    return ranges.errors(_broken(spark, sf_dir)).where("error = 'GAP'").select("name", "lo", "hi", "detail")


@query("incoherent_bounds", f"SELECT name, lo, hi FROM ({_BROKEN}) WHERE lo >= hi")
def incoherent_bounds(spark, sf_dir):
    return _broken(spark, sf_dir).where(F.col("lo") >= F.col("hi")).select("name", "lo", "hi")


def _pairs(spark, sf_dir):
    """Each month with each of the quarters that it could meet: those of the month itself, before and after."""
    months = existing(spark, sf_dir).select("name", "lo", "hi")
    around = F.explode(F.array(*(calendar.step("lo", "quarterly", i) for i in (-1, 0, 1))))
    rows = months.select("name", "lo", "hi", around.alias("q"))
    return rows.select("name", "lo", "hi", calendar.naive("q").alias("qlo"), calendar.naive(calendar.following("q", "quarterly")).alias("qhi"))


_PAIRS = f"""
SELECT name, lo, hi, q::TIMESTAMP AS qlo, (q + INTERVAL 3 MONTH)::TIMESTAMP AS qhi
FROM (SELECT name, lo, hi, {sql_step("lo::DATE", "quarterly", "i")} AS q FROM ({sql_existing()}), (SELECT unnest([-1, 0, 1]) AS i))"""


@query("range_intersection", f"SELECT name, qlo, greatest(lo, qlo) AS both_lo, least(hi, qhi) AS both_hi FROM ({_PAIRS}) WHERE qlo <= hi AND lo <= qhi")
def range_intersection(spark, sf_dir):
    both = ranges.intersection(F.col("lo"), F.col("hi"), F.col("qlo"), F.col("qhi"))
    rows = _pairs(spark, sf_dir).withColumn("b", both).where("b is not null")
    return rows.select("name", "qlo", F.col("b.lo").alias("both_lo"), F.col("b.hi").alias("both_hi"))


@query("range_empty", f"SELECT name, qlo, greatest(lo, qlo) = least(hi, qhi) AS touches FROM ({_PAIRS}) WHERE qlo <= hi AND lo <= qhi")
def range_empty(spark, sf_dir):
    both = ranges.intersection(F.col("lo"), F.col("hi"), F.col("qlo"), F.col("qhi"))
    rows = _pairs(spark, sf_dir).withColumn("b", both).where("b is not null")
    return rows.select("name", "qlo", ranges.empty(F.col("b.lo"), F.col("b.hi")).alias("touches"))


@query(
    "range_equal",
    f"SELECT name, qlo, lo = qlo AND hi = qhi AS same, hi <= qlo OR lo >= qhi AS apart, lo < qlo AND hi > qlo AS out_left, hi > qhi AND lo < qhi AS out_right FROM ({_PAIRS})",
)
def range_equal(spark, sf_dir):
    a = [F.col(c) for c in ("lo", "hi", "qlo", "qhi")]
    return _pairs(spark, sf_dir).select(
        "name", "qlo", ranges.equal(*a).alias("same"), ranges.disjoint(*a).alias("apart"),
        ranges.sticks_out_left(*a[:3]).alias("out_left"), ranges.sticks_out_right(a[0], a[1], a[3]).alias("out_right"),
    )


# -- check -------------------------------------------------------------------------------------------


def _expected(spark, interval: str = "monthly", retention: int = 3, ahead: int = 2, policy: str = "drop"):
    c = configs(spark, ("s", interval, retention, ahead, policy))
    return c, expected_partitions(c, WORK_DATE)


_EXPECTED = sql_expected(DAY, "monthly", -3, 2)


def _sql_diff(found: str) -> str:
    return f"""
SELECT set_name, name, CASE WHEN f.lo IS NULL THEN 'missing' WHEN e.lo IS NULL THEN 'unexpected'
  WHEN e.lo = f.lo AND e.hi = f.hi THEN 'ok' ELSE 'incorrect_bounds' END AS status,
  e.lo AS expected_lo, e.hi AS expected_hi, f.lo AS found_lo, f.hi AS found_hi
FROM ({_EXPECTED}) e FULL JOIN ({found}) f USING (set_name, name)"""


def _off(spark, sf_dir):
    """The partitions of ``existing``, of which one ends a day early and one is not there."""
    rows = existing(spark, sf_dir).where("name <> 'orders_1998_12'")
    return rows.withColumn("hi", F.when(F.col("name") == "orders_1998_10", F.col("hi") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("hi")))


_OFF = f"SELECT * REPLACE (CASE WHEN name = 'orders_1998_10' THEN hi - INTERVAL 1 DAY ELSE hi END AS hi) FROM ({sql_existing()}) WHERE name <> 'orders_1998_12'"


@query("check_diff", _sql_diff(sql_existing()))
def check_diff(spark, sf_dir):
    """Is `orders` partitioned by month as configured: three months kept, two ahead, on 1998-11-20?"""
    return diff.diff(_expected(spark)[1], existing(spark, sf_dir))


_COUNTS = """
SELECT set_name, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'missing') AS n_missing,
  count(*) FILTER (status = 'unexpected') AS n_unexpected, count(*) FILTER (status = 'incorrect_bounds') AS n_incorrect_bounds FROM ({}) GROUP BY 1"""


@query("check_counts", _COUNTS.format(_sql_diff(_OFF)))
def check_counts(spark, sf_dir):
    return diff.counts(diff.diff(_expected(spark)[1], _off(spark, sf_dir)))


@query("missing_partitions", f"SELECT set_name, name, lo, hi FROM ({_EXPECTED}) e WHERE name NOT IN (SELECT name FROM ({_OFF}))")
def missing_partitions(spark, sf_dir):
    return diff.missing(_expected(spark)[1], _off(spark, sf_dir)).select("set_name", "name", "lo", "hi")


@query("unexpected_partitions", f"SELECT set_name, name, lo, hi FROM ({_OFF}) e WHERE name NOT IN (SELECT name FROM ({_EXPECTED}))")
def unexpected_partitions(spark, sf_dir):
    return diff.unexpected(_expected(spark)[1], _off(spark, sf_dir)).select("set_name", "name", "lo", "hi")


@query("incorrect_bounds", f"SELECT * FROM ({_sql_diff(_OFF)}) WHERE status = 'incorrect_bounds'")
def incorrect_bounds(spark, sf_dir):
    return diff.incorrect_bounds(_expected(spark)[1], _off(spark, sf_dir))


_CHECK = f"""
SELECT 's' AS set_name, coalesce((SELECT error FROM ({_sql_range(_OFF)})), CASE WHEN n_missing + n_unexpected + n_incorrect_bounds > 0 THEN 'LAYOUT_MISMATCH' END) AS error,
  n_ok, n_missing, n_unexpected, n_incorrect_bounds FROM ({_COUNTS.format(_sql_diff(_OFF))})"""


@query("layout_check", _CHECK)
def layout_check(spark, sf_dir):
    c, e = _expected(spark)
    return check.layout_check(c, e, _off(spark, sf_dir))


@query("run_status", f"SELECT bool_or(error IS NOT NULL) AS failed, count(error) AS n_failed FROM ({_CHECK})")
def run_status(spark, sf_dir):
    c, e = _expected(spark)
    return status.failed(check.layout_check(c, e, _off(spark, sf_dir)))


# -- provisioning ------------------------------------------------------------------------------------

_SEGMENTS = """
WITH e AS ({expected}), f AS ({found}), n AS (SELECT min(lo) AS nlo, max(hi) AS nhi FROM f), g AS (SELECT min(lo) AS glo, max(hi) AS ghi FROM e),
c AS (SELECT e.*, n.* FROM e, n, g WHERE nlo IS NULL OR NOT (glo = nlo AND ghi = nhi)),
s AS (
  SELECT name, lo, hi, 'full' AS segment FROM c WHERE nlo IS NULL OR hi <= nlo OR lo >= nhi
  UNION ALL SELECT 'orders_' || strftime(lo, '%Y%m%d') || '_' || strftime(nlo, '%Y%m%d'), lo, nlo, 'left' FROM c WHERE lo < nlo AND hi > nlo
  UNION ALL SELECT 'orders_' || strftime(nhi, '%Y%m%d') || '_' || strftime(hi, '%Y%m%d'), nhi, hi, 'right' FROM c WHERE hi > nhi AND lo < nhi
)
SELECT 's' AS set_name, row_number() OVER (ORDER BY lo, hi)::INT AS seq, 'create' AS action, 'orders' AS parent_table, 'public' AS schema, name, lo, hi, segment FROM s"""


@query("provision_full", _SEGMENTS.format(expected=sql_expected(LAST_DAY, "monthly", -3, 6), found=sql_existing()))
def provision_full(spark, sf_dir):
    e = expected_partitions(configs(spark, ("s", "monthly", 3, 6)), _last_day(spark, sf_dir))
    return provision.provisioning_plan(e, existing(spark, sf_dir))


@query("provision_left_right", _SEGMENTS.format(expected=sql_expected(DAY, "yearly", -6, 6), found=sql_existing("weekly")))
def provision_left_right(spark, sf_dir):
    return provision.provisioning_plan(_expected(spark, "yearly", 6, 6)[1], existing(spark, sf_dir, "weekly"))


@query("provision_interval_change", _SEGMENTS.format(expected=sql_expected(LAST_DAY, "weekly", -2, 10), found=sql_existing()))
def provision_interval_change(spark, sf_dir):
    e = expected_partitions(configs(spark, ("s", "weekly", 2, 10)), _last_day(spark, sf_dir))
    return provision.provisioning_plan(e, existing(spark, sf_dir))


@query("provision_from_nothing", _SEGMENTS.format(expected=_EXPECTED, found=f"SELECT * FROM ({sql_existing()}) WHERE false"))
def provision_from_nothing(spark, sf_dir):
    return provision.provisioning_plan(_expected(spark)[1], existing(spark, sf_dir).where(F.lit(False)))


# -- cleanup -----------------------------------------------------------------------------------------

_OUTDATED = f"""
WITH e AS ({_EXPECTED}), f AS ({sql_existing()}), g AS (SELECT min(lo) AS glo, max(hi) AS ghi FROM e), n AS (SELECT min(lo) AS nlo, max(hi) AS nhi FROM f)
SELECT f.* FROM f, g, n WHERE NOT (glo = nlo AND ghi = nhi) AND (f.hi <= glo OR f.lo >= ghi)"""


@query("cleanup_plan", _OUTDATED)
def cleanup_plan(spark, sf_dir):
    return cleanup.outdated(_expected(spark)[1], existing(spark, sf_dir))


@query(
    "cleanup_actions_by_policy",
    f"""SELECT p AS set_name, row_number() OVER (PARTITION BY p ORDER BY lo, hi, place)::INT AS seq, action, parent_table, schema, name, lo, hi
FROM ({_OUTDATED}) o, (VALUES ('detaching', 0, 'detach'), ('dropping', 0, 'detach'), ('dropping', 1, 'drop')) AS v(p, place, action)""",
)
def cleanup_actions_by_policy(spark, sf_dir):
    c = configs(spark, ("detaching", "monthly", 3, 2, "detach"), ("dropping", "monthly", 3, 2, "drop"))
    found = existing(spark, sf_dir).drop("set_name").withColumn("set_name", F.explode(F.array(F.lit("detaching"), F.lit("dropping"))))
    return cleanup.cleanup_plan(c, expected_partitions(c, WORK_DATE), found)


@query("cleanup_blocked_by_gap", f"SELECT set_name, error FROM ({_sql_range(_BROKEN)}) WHERE error IS NOT NULL")
def cleanup_blocked_by_gap(spark, sf_dir):
    return cleanup.blocked(_broken(spark, sf_dir))


# -- keys, configurations, servers -------------------------------------------------------------------

_KEYS = (
    ("good", "RANGE (created_at)", "date", "created_at"), ("good_uuid", "RANGE (id)", "uuid", "id"), ("list", "LIST (created_at)", "date", "created_at"),
    ("hash", "HASH (created_at)", "timestamp", "created_at"), ("other_key", "RANGE (updated_at)", "date", "created_at"), ("text_key", "RANGE (created_at)", "text", "created_at"),
    ("plain", None, "date", "created_at"), ("two", "LIST (updated_at)", "date", "created_at"), ("zoned", "RANGE (at)", "timestamp with time zone", "at"),
)


@query(
    "key_check_codes",
    f"""SELECT set_name, CASE WHEN key_type NOT IN ('date', 'timestamp', 'timestamp with time zone', 'uuid') THEN 'UNSUPPORTED_KEY_TYPE'
  WHEN definition IS NULL THEN 'NOT_PARTITIONED' WHEN regexp_extract(definition, '^(.*) \\((.*)\\)$', 2) <> wanted THEN 'KEY_MISMATCH'
  WHEN regexp_extract(definition, '^(.*) \\((.*)\\)$', 1) <> 'RANGE' THEN 'UNSUPPORTED_STRATEGY' END AS error
FROM {_values(_KEYS, "set_name", "definition", "key_type", "wanted")}""",
)
def key_check_codes(spark, sf_dir):
    c = spark.createDataFrame([(n, "public", n, w, "daily", 1, 1, "drop") for n, _, _, w in _KEYS], CONFIGS)
    s = spark.createDataFrame([("public", n, d, t) for n, d, t, _ in _KEYS], "schema string, table string, definition string, type_name string")
    return keys.key_errors(c, s)


_CONFIGS = (
    ("good", "public", "t", "k", "daily", 1, 1, "drop"), ("no_schema", "", "t", "k", "daily", 1, 1, "drop"), ("no_table", "public", None, "k", "weekly", 1, 1, "drop"),
    ("hourly", "public", "t", "k", "hourly", 1, 1, "drop"), ("zero", "public", "t", "k", "yearly", 0, 1, "detach"), ("negative", "public", "t", "k", "yearly", 1, -1, "detach"),
    ("policy", "public", "t", "k", "monthly", 1, 1, "keep"), ("empty", None, None, None, None, None, None, None),
)
_SQL_CHECKS = {
    "schema": "CASE WHEN coalesce(schema, '') = '' THEN 'required' END",
    "table": "CASE WHEN coalesce(\"table\", '') = '' THEN 'required' END",
    "partitionKey": "CASE WHEN coalesce(partition_key, '') = '' THEN 'required' END",
    "interval": "CASE WHEN coalesce(\"interval\", '') = '' THEN 'required' WHEN \"interval\" NOT IN ('daily', 'weekly', 'monthly', 'quarterly', 'yearly') THEN 'oneof' END",
    "retention": "CASE WHEN coalesce(retention, 0) = 0 THEN 'required' WHEN retention < 0 THEN 'gt' END",
    "preProvisioned": "CASE WHEN coalesce(pre_provisioned, 0) = 0 THEN 'required' WHEN pre_provisioned < 0 THEN 'gt' END",
    "cleanupPolicy": "CASE WHEN coalesce(cleanup_policy, '') = '' THEN 'required' WHEN cleanup_policy NOT IN ('drop', 'detach') THEN 'oneof' END",
}
_CONFIG_COLUMNS = ("set_name", "schema", '"table"', "partition_key", '"interval"', "retention", "pre_provisioned", "cleanup_policy")


@query(
    "config_validation_errors",
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT set_name, '{f}' AS field, {c} AS tag FROM {_values(_CONFIGS, *_CONFIG_COLUMNS)}" for f, c in _SQL_CHECKS.items())
    + ") WHERE tag IS NOT NULL",
)
def config_validation_errors(spark, sf_dir):
    return config.validation_errors(spark.createDataFrame(list(_CONFIGS), CONFIGS)).select("set_name", "field", "tag")


_SERVERS = (
    (1, "16.2 (Debian 16.2-1.pgdg120+2)", 0), (2, "14.1", 10), (3, "13.9", 0), (4, "14.1", 30), (5, "14.1", -30), (6, "garbage", 0), (7, "13.9", 60),
)


@query(
    "server_requirements",
    f"""SELECT id, CASE WHEN NOT regexp_matches(version, '^[0-9]+') THEN 'UNKNOWN_VERSION' WHEN regexp_extract(version, '^[0-9]+')::BIGINT < 14 THEN 'UNSUPPORTED_SERVER'
  WHEN abs(drift) > 10 THEN 'TIME_DRIFT' END AS error FROM {_values(_SERVERS, "id", "version", "drift")}""",
)
def server_requirements(spark, sf_dir):
    rows = spark.createDataFrame(list(_SERVERS), "id int, version string, drift int")
    here = F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp")
    return rows.select("id", keys.server_error(F.col("version"), here + F.make_dt_interval(secs=F.col("drift")), here).alias("error"))


# -- rows --------------------------------------------------------------------------------------------


@query("route_rows_equi", f"SELECT o_orderkey, 'orders_' || {sql_suffix('o_orderdate', 'monthly')} AS part_name FROM orders")
def route_rows_equi(spark, sf_dir):
    """The partition of every order by its key alone, in an unbroken monthly layout."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return routing.route_regular(rows, "o_orderdate", "monthly", "orders").select("o_orderkey", "part_name")


@query("route_rows", f"WITH p AS ({_BROKEN}) SELECT o_orderkey, p.name AS part_name FROM orders LEFT JOIN p ON o_orderdate >= p.lo AND o_orderdate < p.hi")
def route_rows(spark, sf_dir):
    """The partition of every order in a layout with holes."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return routing.route_rows(rows, "o_orderdate", _broken(spark, sf_dir)).select("o_orderkey", "part_name")


@query("prune_range", f"SELECT name, lo, hi FROM ({sql_existing()}) WHERE lo < TIMESTAMP '1998-06-15' AND hi > TIMESTAMP '1998-02-10'")
def prune_range(spark, sf_dir):
    lo, hi = (F.lit(d).cast("timestamp_ntz") for d in ("1998-02-10", "1998-06-15"))
    return routing.overlapping(existing(spark, sf_dir), lo, hi).select("name", "lo", "hi")


@query(
    "read_range_rows",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-02-10' AND o_orderdate < TIMESTAMP '1998-06-15'",
)
def read_range_rows(spark, sf_dir):
    """The orders of a range of days, read through the partitions that the range meets."""
    lo, hi = (F.lit(d).cast("timestamp_ntz") for d in ("1998-02-10", "1998-06-15"))
    rows = routing.route_regular(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "monthly", "orders")
    return routing.read_range(rows, "o_orderdate", existing(spark, sf_dir), lo, hi).select("o_orderkey", "o_orderdate")


# -- actions -----------------------------------------------------------------------------------------


def _dry_run(spark: SparkSession, found: DataFrame | None, *sets: tuple) -> tuple[Engine, FrameCatalog]:
    """An engine over a catalog in memory, with the partitions ``found`` of ``orders`` (as many as months)."""
    kept = FrameCatalog()
    kept.add_parent("public", "orders", "o_orderdate", "date")
    for r in (found.collect() if found is not None else []):
        kept.add_partition("public", r.name, "orders", r.lo.date().isoformat(), r.hi.date().isoformat())
    quiet = logger(stream=io.StringIO())
    return Engine(spark, kept, configs(spark, *sets), WORK_DATE, quiet, sleep=lambda s: None), kept


def _actions(spark: SparkSession, kept: FrameCatalog) -> DataFrame:
    """(seq, action, name, lower, upper) of what has been done, in its order."""
    rows = [(i, a, n, *((rest[1:] or (None, None)) if a == "attach" else (None, None))) for i, (a, _, n, *rest) in enumerate(kept.calls)]
    return spark.createDataFrame(rows, "seq int, action string, name string, lower string, upper string")


@query(
    "provisioning_actions",
    f"""SELECT (row_number() OVER (ORDER BY lo, place) - 1)::INT AS seq, action, name,
  CASE WHEN action = 'attach' THEN strftime(lo, '%Y-%m-%d') END AS lower, CASE WHEN action = 'attach' THEN strftime(hi, '%Y-%m-%d') END AS upper
FROM ({_EXPECTED}), (VALUES (0, 'create'), (1, 'attach'), (2, 'identity')) AS v(place, action)""",
)
def provisioning_actions(spark, sf_dir):
    """What provisioning does where nothing is: each partition is created, attached, and given its parent's identity."""
    engine, kept = _dry_run(spark, None, ("s", "monthly", 3, 2))
    engine.provision()
    engine.provision()  # nothing is done twice
    return _actions(spark, kept)


@query(
    "cleanup_actions",
    f"""SELECT (row_number() OVER (ORDER BY lo, place) - 1)::INT AS seq, action, name, NULL::VARCHAR AS lower, NULL::VARCHAR AS upper
FROM ({_OUTDATED}), (VALUES (0, 'detach'), (1, 'drop')) AS v(place, action)""",
)
def cleanup_actions(spark, sf_dir):
    """What cleanup does to the months of ``orders``: those outside of the expected range are detached and dropped."""
    engine, kept = _dry_run(spark, existing(spark, sf_dir), ("s", "monthly", 3, 2))
    engine.clean_up()
    return _actions(spark, kept)


@query(
    "detach_actions",
    f"""WITH o AS ({_OUTDATED}), first AS (SELECT min(lo) AS lo FROM o), a AS (
  SELECT o.lo, 0 AS place, 'detach' AS action, name FROM o UNION ALL SELECT o.lo, 1, 'finalize', name FROM o, first WHERE o.lo = first.lo
) SELECT (row_number() OVER (ORDER BY lo, place) - 1)::INT AS seq, action, name, NULL::VARCHAR AS lower, NULL::VARCHAR AS upper FROM a""",
)
def detach_actions(spark, sf_dir):
    """The same under a policy of detaching, where the detach of the first partition has been broken off before."""
    engine, kept = _dry_run(spark, existing(spark, sf_dir), ("s", "monthly", 3, 2, "detach"))
    kept.tables["public", min(n for _, n in kept.tables)]["state"] = "pending"
    engine.clean_up()
    return _actions(spark, kept)


@query(
    "failed_actions",
    f"""WITH o AS ({_OUTDATED}), first AS (SELECT min(lo) AS lo FROM o), a AS (
  SELECT lo, 0 AS place, 'detach' AS action, name, 1 AS k FROM o
  UNION ALL SELECT o.lo, 0, 'detach', name, k FROM o, first, (VALUES (2), (3)) AS t(k) WHERE o.lo = first.lo
  UNION ALL SELECT o.lo, 1, 'drop', name, 1 FROM o, first WHERE o.lo > first.lo
) SELECT (row_number() OVER (ORDER BY lo, place, k) - 1)::INT AS seq, action, name, NULL::VARCHAR AS lower, NULL::VARCHAR AS upper FROM a""",
)
def failed_actions(spark, sf_dir):
    """The detach of the first partition fails: it is tried three times, the partition is not dropped, and the others go."""
    engine, kept = _dry_run(spark, existing(spark, sf_dir), ("s", "monthly", 3, 2))
    kept.failing.add(("detach", min(n for _, n in kept.tables)))
    engine.clean_up()
    return _actions(spark, kept)


_CODES = (("nothing", 0), ("no_parent", 4), ("gap", 4), ("drop_fails", 6), ("other_interval", 5))


@query("exit_codes", f"SELECT scenario, code FROM {_values(_CODES, 'scenario', 'code')}")
def exit_codes(spark, sf_dir):
    """What a run of all three works ends with: provisioning, then cleanup, then the check, up to the first that fails."""
    months = existing(spark, sf_dir)
    rows = []
    for scenario, _ in _CODES:
        interval = "quarterly" if scenario == "other_interval" else "monthly"
        engine, kept = _dry_run(spark, None if scenario in ("nothing", "no_parent") else months, ("s", interval, 3, 2))
        if scenario == "no_parent":
            kept.parents.clear()
        if scenario == "gap":
            del kept.tables["public", sorted(n for _, n in kept.tables)[3]]
        if scenario == "drop_fails":
            kept.failing.add(("drop", min(n for _, n in kept.tables)))
        rows.append((scenario, engine.run_all()))
    return spark.createDataFrame(rows, "scenario string, code int")


_IDENTIFIERS = (("public", "orders"), ("my schema", "table's name"), ("a.b", "tick`ed"), ("é", "日本"))


@query(
    "qualified_names",
    "SELECT schema || '.' || name AS qualified, '`' || replace(schema, '`', '``') || '`.`' || replace(name, '`', '``') || '`' AS quoted FROM "
    + _values(_IDENTIFIERS, "schema", "name"),
)
def qualified_names(spark, sf_dir):
    rows = spark.createDataFrame([(*r, names.quoted(*r)) for r in _IDENTIFIERS], "schema string, name string, quoted string")
    return rows.select(names.qualified("schema", "name").alias("qualified"), "quoted")


_TEXTS = (
    (1, "018cc251-f400-7000-8000-000000000000"), (2, "47568E76-FB49-11EE-B9C7-325096B39F47"), (3, "018cc251f40070008000000000000000"),
    (4, "018cc251-f400-7000-8000-00000000000"), (5, "018cc251-f400-7000-8000-00000000000g"), (6, ""), (7, " 018cc251-f400-7000-8000-000000000000"),
)


@query(
    "uuid_syntax",
    f"SELECT id, regexp_full_match(lower(t), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') AS valid FROM {_values(_TEXTS, 'id', 't')}",
)
def uuid_syntax(spark, sf_dir):
    return spark.createDataFrame(list(_TEXTS), "id int, t string").select("id", uuid7.is_uuid("t").alias("valid"))
