"""Queries over the test tables, with their DuckDB equivalents.

The tables are clean, so a query first dirties them by fixed rules on keys. Those
rules are SQL that both engines read alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ISSUE_TYPES
from .functions import dates, numbers, text, types
from .operators import apply, detect_dups, detect_rows, enrich, evaluate, report, review, stats
from .plans.export import publish
from .plans.profile import profile_dataset, rule_resolution_rate
from .sources import catalog, tables
from .sources import csv as csv_source
from .storage import keep, shared_dir
from .streaming import cross_row, statistics
from .streaming.decisions import apply_stream
from .streaming.incremental import detect_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


HEADERS = ["customer_id", "full_name", "email", "phone", "signup_date", "country", "revenue", "status"]

#: Contacts with every kind of mess, one row per customer; k is the key, from 0.
CONTACTS = """
SELECT concat('r-', CAST(k + 1 AS STRING)) AS row_id, k AS row_index, CAST(k AS STRING) AS customer_id,
  CASE WHEN k % 97 = 0 THEN 'Test User' WHEN k % 71 = 0 THEN 'N/A' ELSE concat('Contact ', CAST(k AS STRING)) END AS full_name,
  CASE WHEN k % 11 = 0 THEN '' WHEN k % 19 = 0 THEN concat('user', CAST(k AS STRING), '@example,com') WHEN k % 23 = 0 THEN concat('user', CAST(k AS STRING), '@example') ELSE concat('user', CAST(k AS STRING), '@example.com') END AS email,
  CASE WHEN k % 53 = 0 THEN '(000) 000-0000' WHEN k % 7 = 0 THEN concat('555-010-', d) WHEN k % 29 = 0 THEN concat('555010', d) WHEN k % 31 = 0 THEN concat('+52 555 010 ', d) ELSE concat('(555) 010-', d) END AS phone,
  CASE WHEN k % 9 = 0 THEN concat(lpad(CAST(k % 28 + 1 AS STRING), 2, '0'), '/', lpad(CAST(k % 12 + 1 AS STRING), 2, '0'), '/2024') WHEN k % 16 = 0 THEN concat(CAST(k % 12 + 1 AS STRING), '.', CAST(k % 28 + 1 AS STRING), '.2023') ELSE concat('2024-', lpad(CAST(k % 12 + 1 AS STRING), 2, '0'), '-', lpad(CAST(k % 28 + 1 AS STRING), 2, '0')) END AS signup_date,
  CASE WHEN k % 6 = 0 THEN lower(c) WHEN k % 43 = 0 THEN 'unknown' ELSE c END AS country,
  CASE WHEN k % 37 = 0 THEN 'abc' WHEN k % 41 = 0 THEN '-' WHEN k % 101 = 0 THEN '98000000.00' WHEN k % 10 = 0 THEN concat('USD ', a, '.50') WHEN k % 14 = 0 THEN concat(a, ',50') ELSE concat(a, '.25') END AS revenue,
  CASE WHEN k % 8 = 0 THEN lower(s) ELSE s END AS status
FROM (SELECT CAST(c_custkey AS BIGINT) AS k, lpad(CAST((c_custkey * 7919) % 10000 AS STRING), 4, '0') AS d,
  CASE c_custkey % 5 WHEN 0 THEN 'Mexico' WHEN 1 THEN 'Brazil' WHEN 2 THEN 'Spain' WHEN 3 THEN 'India' ELSE 'Japan' END AS c,
  CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS STRING) AS a, c_mktsegment AS s FROM customer) base
"""


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _spread_customers(spark, sf_dir)
    return spark.sql(CONTACTS)


def _spread_customers(spark: SparkSession, sf_dir: str) -> None:
    """The table customer, its narrow columns dealt over all cores: a few MB in a file make wide rows that take long to judge."""
    narrow = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_mktsegment")
    narrow.repartition(spark.sparkContext.defaultParallelism, "c_custkey").createOrReplaceTempView("customer")


# --- DuckDB equivalents of the column functions -------------------------------------------------

MISSING = "('" + "', '".join(t for t in text.MISSING_TOKENS) + "')"
CODES = "|".join(numbers.CURRENCY_CODES)


def _missing(v: str) -> str:
    return f"(lower(trim({v})) IN {MISSING})"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def _shape(v: str) -> str:
    return f"regexp_replace(regexp_replace(trim({v}), '[a-zA-Z\\x{{C0}}-\\x{{24F}}]', 'A', 'g'), '[0-9]', 'D', 'g')"


def _email(v: str) -> str:
    return f"regexp_matches(trim({v}), '(?i)^[^\\s@]+@[^\\s@]+\\.[a-z]{{2,}}$')"


def _phone(v: str) -> str:
    return f"(regexp_matches(trim({v}), '^\\+?[0-9\\s().-]{{7,}}$') AND length({_digits(v)}) >= 7)"


def _bare(v: str) -> str:
    return f"regexp_replace(regexp_replace(trim({v}), '^({CODES})', '', 'i'), '[$€£¥\\s]', '', 'g')"


def _plain(v: str) -> str:
    b = _bare(v)
    return f"CASE WHEN regexp_matches({b}, '^[+-]?[0-9.,]+$') THEN CASE WHEN regexp_matches({b}, ',[^.]*$') THEN regexp_replace(replace({b}, '.', ''), ',', '.') ELSE replace({b}, ',', '') END END"


def _number(v: str) -> str:
    return f"TRY_CAST({_plain(v)} AS DOUBLE)"


def _valid(y: str, m: str, d: str) -> str:
    return f"coalesce({m} BETWEEN 1 AND 12 AND {y} BETWEEN 1000 AND 9999 AND {d} >= 1 AND {d} <= CASE WHEN {m} = 2 THEN CASE WHEN ({y} % 4 = 0 AND {y} % 100 <> 0) OR {y} % 400 = 0 THEN 29 ELSE 28 END WHEN {m} IN (4, 6, 9, 11) THEN 30 ELSE 31 END, false)"


def _date_parts(v: str) -> tuple[str, str, str, str]:
    """(is ISO, day-first, month-first, ISO text) of a value."""
    iso = "'^([0-9]{4})-([0-9]{2})-([0-9]{2})$'"
    mixed = "'^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})$'"
    n = lambda p, i: f"TRY_CAST(regexp_extract(trim({v}), {p}, {i}) AS INT)"
    a, b, y = n(mixed, 1), n(mixed, 2), n(mixed, 3)
    is_iso = f"(regexp_matches(trim({v}), {iso}) AND {_valid(n(iso, 1), n(iso, 2), n(iso, 3))})"
    day, month = _valid(y, b, a), _valid(y, a, b)
    made = lambda m, d: f"concat(CAST({y} AS VARCHAR), '-', lpad(CAST({m} AS VARCHAR), 2, '0'), '-', lpad(CAST({d} AS VARCHAR), 2, '0'))"
    return is_iso, day, month, f"CASE WHEN {is_iso} THEN trim({v}) WHEN {day} THEN {made(b, a)} WHEN {month} THEN {made(a, b)} END"


def _is_date(v: str) -> str:
    is_iso, day, month, _ = _date_parts(v)
    return f"({is_iso} OR {day} OR {month})"


def _boolean(v: str) -> str:
    return f"(lower(trim({v})) IN ('true', 'false', 'yes', 'no', 'y', 'n', '0', '1'))"


def _kind(v: str) -> str:
    return f"CASE WHEN {_email(v)} THEN 'email' WHEN {_is_date(v)} THEN 'date' WHEN {_boolean(v)} AND NOT regexp_matches(trim({v}), '^[0-9]+$') THEN 'boolean' WHEN {_number(v)} IS NOT NULL THEN 'number' WHEN {_phone(v)} THEN 'phone' ELSE 'string' END"


def _matches(v: str, kind: str) -> str:
    return f"CASE {kind} WHEN 'email' THEN {_email(v)} WHEN 'phone' THEN {_phone(v)} WHEN 'number' THEN {_number(v)} IS NOT NULL WHEN 'date' THEN {_is_date(v)} WHEN 'boolean' THEN {_boolean(v)} ELSE true END"


def _key(v: str) -> str:
    return f"regexp_replace(lower(strip_accents({v})), '[^a-z0-9]', '', 'g')"


CELLS_SQL = f"contacts AS MATERIALIZED ({CONTACTS}), cells AS MATERIALIZED (SELECT row_id, row_index, column_key, value FROM contacts UNPIVOT (value FOR column_key IN ({', '.join(HEADERS)})))"
STATS_SQL = f"""{CELLS_SQL},
vals AS MATERIALIZED (SELECT column_key, value, count(*) AS n, min(row_index) AS first FROM cells GROUP BY ALL),
present AS MATERIALIZED (SELECT *, {_kind("value")} AS kind, {_shape("value")} AS shape, {_number("value")} AS num FROM vals WHERE NOT {_missing("value")}),
kinds AS (SELECT column_key, kind, sum(n) AS n FROM present GROUP BY ALL),
kinds1 AS (SELECT column_key, arg_max(kind, n) AS kind, max(n) AS most, sum(n) AS total FROM kinds GROUP BY column_key),
shapes AS (SELECT column_key, shape, sum(n) AS n, min(first) AS first FROM present GROUP BY ALL),
shapes1 AS (SELECT *, sum(n) OVER (PARTITION BY column_key) AS total, row_number() OVER (PARTITION BY column_key ORDER BY n DESC, first) AS place FROM shapes),
nums AS (SELECT cells.column_key, {_number("cells.value")} AS x FROM cells WHERE NOT {_missing("cells.value")}),
quart AS (SELECT column_key, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, count(x) AS n FROM nums WHERE x IS NOT NULL GROUP BY column_key),
nulls AS (SELECT column_key, count(*) FILTER (WHERE {_missing("value")}) AS null_count FROM cells GROUP BY column_key),
dist AS (SELECT column_key, count(*) AS distinct_count FROM present GROUP BY column_key),
stats AS MATERIALIZED (SELECT nulls.column_key, null_count, coalesce(distinct_count, 0) AS distinct_count,
  CASE WHEN kinds1.most >= 0.6 * kinds1.total THEN kinds1.kind ELSE 'mixed' END AS inferred_type,
  CASE WHEN shapes1.n >= 0.5 * shapes1.total THEN shapes1.shape END AS majority_shape,
  CASE WHEN kinds1.most >= 0.6 * kinds1.total AND kinds1.kind = 'number' AND quart.n >= 8 AND q3 > q1 THEN q1 - 1.5 * (q3 - q1) END AS low,
  CASE WHEN kinds1.most >= 0.6 * kinds1.total AND kinds1.kind = 'number' AND quart.n >= 8 AND q3 > q1 THEN q3 + 1.5 * (q3 - q1) END AS high
  FROM nulls LEFT JOIN dist USING (column_key) LEFT JOIN kinds1 USING (column_key) LEFT JOIN shapes1 ON shapes1.column_key = nulls.column_key AND place = 1 LEFT JOIN quart ON quart.column_key = nulls.column_key),
long AS MATERIALIZED (SELECT cells.*, inferred_type, majority_shape, low, high FROM cells JOIN stats USING (column_key)),
spelled AS (SELECT column_key, {_key("value")} AS key, value, n, first FROM present),
spellings AS (SELECT column_key, key, value AS spelling FROM spelled WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY column_key, key ORDER BY n DESC, first) = 1 AND count(*) OVER (PARTITION BY column_key, key) > 1)"""
_POURED = f"CASE WHEN length(regexp_replace(majority_shape, '[^D]', '', 'g')) = length({_digits('value')}) AND majority_shape = '(DDD) DDD-DDDD' THEN concat('(', substr({_digits('value')}, 1, 3), ') ', substr({_digits('value')}, 4, 3), '-', substr({_digits('value')}, 7, 4)) END"
_ISO_TEXT = "regexp_matches(trim(value), '^([0-9]{4})-([0-9]{2})-([0-9]{2})$')"
_DUP = "fd AS (SELECT *, min(row_index) OVER (PARTITION BY " + ", ".join(HEADERS) + ") AS first_index FROM contacts)"
#: type, column, row, ambiguous, action and proposal of all row-level findings.
FINDINGS_SQL = f"""{STATS_SQL},
p AS MATERIALIZED (SELECT * FROM long WHERE NOT {_missing("value")}),
found AS MATERIALIZED (
  SELECT 'missing_value' AS type, column_key, row_id, trim(value) = '' AS ambiguous, CASE WHEN trim(value) <> '' THEN 'set_value' END AS action, CAST(NULL AS VARCHAR) AS proposed_value FROM long WHERE {_missing("value")}
  UNION ALL SELECT 'inconsistent_format', column_key, row_id, false, 'normalize_value', {_POURED} FROM p WHERE inferred_type = 'phone' AND {_shape("value")} <> majority_shape AND {_POURED} IS NOT NULL
  UNION ALL SELECT 'inconsistent_format', column_key, row_id, false, 'normalize_value', {_date_parts("value")[3]} FROM p WHERE inferred_type = 'date' AND NOT {_ISO_TEXT} AND {_is_date("value")}
  UNION ALL SELECT 'inconsistent_format', p.column_key, row_id, false, 'normalize_value', spelling FROM p JOIN spellings s ON s.column_key = p.column_key AND s.key = {_key("p.value")} WHERE inferred_type IN ('string', 'boolean') AND value <> spelling
  UNION ALL SELECT 'type_mismatch', column_key, row_id, false, 'normalize_value', {_plain("value")} FROM p WHERE inferred_type = 'number' AND NOT regexp_matches(trim(value), '^[+-]?[0-9]+(\\.[0-9]+)?$') AND {_number("value")} IS NOT NULL
  UNION ALL SELECT 'type_mismatch', column_key, row_id, true, NULL, NULL FROM p WHERE NOT {_matches("value", "inferred_type")}
  UNION ALL SELECT 'outlier', column_key, row_id, false, 'no_action', NULL FROM p WHERE {_number("value")} < low OR {_number("value")} > high
  UNION ALL SELECT 'suspicious_value', column_key, row_id, true, NULL, NULL FROM p WHERE (inferred_type = 'email' AND NOT {_email("value")}) OR (inferred_type = 'string' AND lower(trim(value)) = 'test user') OR (inferred_type = 'phone' AND {_phone("value")} AND length(replace({_digits("value")}, substr({_digits("value")}, 1, 1), '')) = 0)
)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level findings of the contacts, written once for the query that asks."""
    rows = contacts(spark, sf_dir)
    return keep(detect_rows.detect_row_level(rows, HEADERS, stats.column_stats(rows, HEADERS)), "findings")


def _of_type(kind: str) -> str:
    return f"WITH {FINDINGS_SQL} SELECT type, column_key, row_id, ambiguous, action, proposed_value FROM found WHERE type = '{kind}'"


_COLUMNS = ["type", "column_key", "row_id", "ambiguous", "action", "proposed_value"]


def _narrow(found: DataFrame) -> DataFrame:
    return found.select("type", "column_key", F.col("row_ids")[0].alias("row_id"), "ambiguous", "action", "proposed_value")


# --- profile and detectors ----------------------------------------------------------------------


@query(f"WITH {STATS_SQL} SELECT column_key, null_count, distinct_count, inferred_type, majority_shape, round(low, 6) AS low, round(high, 6) AS high FROM stats")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.column_stats(contacts(spark, sf_dir), HEADERS).columns
    return found.select("column_key", "null_count", "distinct_count", "inferred_type", "majority_shape", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"WITH {STATS_SQL}, s AS (SELECT column_key, value, row_number() OVER (PARTITION BY column_key ORDER BY first, value) AS place FROM present) SELECT column_key, CAST(place - 1 AS INT) AS place, value FROM s WHERE place <= 10")
def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.column_stats(contacts(spark, sf_dir), HEADERS).columns
    return found.select("column_key", F.posexplode("sample_values").alias("place", "value"))


#: Quantities in three spellings each, so both quartiles lie among equal numbers.
SPELLED = "SELECT concat('r-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS row_id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS row_index, concat(CAST(CAST(floor(l_quantity / 10) AS BIGINT) AS STRING), CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '.0' ELSE '.00' END) AS tens FROM lineitem"


@query(f"WITH t AS ({SPELLED}), n AS (SELECT CAST(tens AS DOUBLE) AS x FROM t), q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM n) SELECT 'tens' AS column_key, (SELECT count(DISTINCT tens) FROM t) AS distinct_count, a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM q")
def fences_of_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir, "lineitem")
    return stats.column_stats(spark.sql(SPELLED), ["tens"]).columns.select("column_key", "distinct_count", "low", "high")


def _detector(kind: str, judge: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = contacts(spark, sf_dir)
        known = stats.column_stats(rows, HEADERS)
        return _narrow(judge(detect_rows.with_stats(rows, HEADERS, known, spelled=kind == "inconsistent_format")))

    return run


for _name, _type, _judge in (
    ("missing_values", "missing_value", detect_rows.missing_values),
    ("inconsistent_formats", "inconsistent_format", detect_rows.inconsistent_formats),
    ("type_mismatches", "type_mismatch", detect_rows.type_mismatches),
    ("outliers_iqr", "outlier", detect_rows.outliers),
    ("suspicious_values", "suspicious_value", detect_rows.suspicious_values),
):
    QUERIES[_name], ORACLES[_name] = _detector(_type, _judge), _of_type(_type)


@query(f"WITH {FINDINGS_SQL} SELECT type, column_key, ambiguous, count(*) AS findings FROM found GROUP BY ALL")
def row_level_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).groupBy("type", "column_key", "ambiguous").agg(F.count(F.lit(1)).alias("findings"))


@query("SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS first_id FROM documents) WHERE doc_id > first_id")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("row_id"), F.col("doc_id").alias("row_index"), "text", "lang")
    found = detect_dups.exact_duplicates(docs, ["text", "lang"])
    return found.select(F.col("row_ids")[0].cast("bigint").alias("doc_id"), F.col("row_ids")[1].cast("bigint").alias("first_id"))


#: Suppliers with later near copies of one in four; the name's digits make a key per row.
SUPPLIERS = """
SELECT concat('s-', CAST(row_index AS STRING)) AS row_id, row_index, name, city, code FROM (
  SELECT CAST(2 * s_suppkey AS BIGINT) AS row_index, concat(CAST((s_suppkey * 7919) % 9973 AS STRING), ' Trading Company ', CAST((s_suppkey * 104729) % 99991 AS STRING)) AS name, concat('City ', CAST(s_suppkey % 50 AS STRING)) AS city, CAST((s_suppkey * 15485863) % 1000003 AS STRING) AS code FROM supplier
  UNION ALL
  SELECT CAST(2 * s_suppkey + 1 AS BIGINT), concat(CAST((s_suppkey * 7919) % 9973 AS STRING), ' Trading Compny ', CAST((s_suppkey * 104729) % 99991 AS STRING)), concat('CITY ', CAST(s_suppkey % 50 AS STRING)), CAST((s_suppkey * 15485863) % 1000003 AS STRING) FROM supplier WHERE s_suppkey % 4 = 0
) both_kinds
"""


@query(
    f"""WITH rows0 AS ({SUPPLIERS}), k AS (SELECT row_id, row_index, {_key("name")} AS a, {_key("city")} AS b, {_key("code")} AS c FROM rows0),
sig AS MATERIALIZED (SELECT *, concat(a, '|', b, '|', c) AS s FROM k),
pairs AS (SELECT x.row_id AS a_id, x.row_index AS a_index, y.row_id AS b_id, 1 - CAST(levenshtein(x.s, y.s) AS DOUBLE) / greatest(length(x.s), length(y.s)) AS score
  FROM sig x JOIN sig y ON x.row_index < y.row_index AND (left(x.a, 3) = left(y.a, 3) OR left(x.b, 3) = left(y.b, 3) OR left(x.c, 3) = left(y.c, 3)) WHERE abs(length(x.s) - length(y.s)) <= 0.15 * greatest(length(x.s), length(y.s)) + 1e-9)
SELECT b_id AS row_id, a_id AS other_id FROM pairs WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY score DESC, a_index) = 1"""
)
def fuzzy_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir, "supplier")
    found = detect_dups.fuzzy_duplicates(spark.sql(SUPPLIERS), ["name", "city", "code"])
    return found.select(F.col("row_ids")[0].alias("row_id"), F.col("row_ids")[1].alias("other_id"))


@query(f"WITH {CELLS_SQL} SELECT column_key, {_shape('value')} AS shape, count(*) AS n FROM cells GROUP BY ALL")
def value_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cells(contacts(spark, sf_dir), HEADERS).groupBy("column_key", text.shape_of(F.col("value")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CELLS_SQL} SELECT column_key, {_kind('value')} AS kind, count(*) AS n FROM cells GROUP BY ALL")
def classified_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cells(contacts(spark, sf_dir), HEADERS).groupBy("column_key", types.classify_value(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CELLS_SQL} SELECT row_id, column_key, {_key('value')} AS key FROM cells WHERE column_key IN ('full_name', 'country', 'email')")
def normalized_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cells(contacts(spark, sf_dir), ["full_name", "country", "email"]).select("row_id", "column_key", text.normalize_key(F.col("value")).alias("key"))


RENDERED_DATES = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strip WHEN 1 THEN concat(d, '/', m, '/', y) WHEN 2 THEN concat(m, '.', d, '.', y) ELSE concat(y, '-', m, '-', d) END AS raw FROM (SELECT o_orderkey, y, m, d, concat(' ', y, '-', m, '-', d, ' ') AS strip FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS STRING) AS y, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS m, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS d FROM orders) parts) forms"
_IS_ISO, _DAY, _MONTH, _AS_ISO = _date_parts("raw")
_MIXED_EQUAL = "TRY_CAST(regexp_extract(trim(raw), '^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})$', 1) AS INT) <> TRY_CAST(regexp_extract(trim(raw), '^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})$', 2) AS INT)"


@query(f"WITH raws AS ({RENDERED_DATES}) SELECT o_orderkey, {_AS_ISO} AS iso, NOT {_IS_ISO} AND {_DAY} AND {_MONTH} AND coalesce({_MIXED_EQUAL}, false) AS ambiguous FROM raws")
def dates_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir, "orders")
    read = dates.parse_date(F.col("raw"))
    return spark.sql(RENDERED_DATES).withColumn("d", read).select("o_orderkey", "d.iso", "d.ambiguous")


RENDERED_NUMBERS = "SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN concat('USD ', n, '.05') WHEN 1 THEN concat(n, ',50') WHEN 2 THEN concat('$', n) WHEN 3 THEN concat('1,', lpad(n, 3, '0'), '.50') WHEN 4 THEN concat('1.', lpad(n, 3, '0'), ',75') WHEN 5 THEN concat('SKU-', n) ELSE concat('-', n, '.00') END AS raw FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) AS n FROM lineitem) q"


@query(f"WITH raws AS ({RENDERED_NUMBERS}) SELECT l_orderkey, l_linenumber, CASE WHEN {_number('raw')} IS NOT NULL THEN {_plain('raw')} END AS plain, {_number('raw')} AS value FROM raws")
def numbers_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    _tables(spark, sf_dir, "lineitem")
    return spark.sql(RENDERED_NUMBERS).withColumn("n", numbers.read_number(F.col("raw"))).select("l_orderkey", "l_linenumber", "n.plain", "n.value")


_MENDED = "regexp_replace(email, ',([a-z]{2,4})$', '.\\1', 'i')"


@query(f"WITH {CELLS_SQL} SELECT row_id, CASE WHEN contains(email, '@') THEN CASE WHEN regexp_matches({_MENDED}, '(?i)^[^\\s@]+@[^\\s@]+\\.[a-z]{{2,}}$') THEN {_MENDED} WHEN split_part({_MENDED}, '@', 2) <> '' AND NOT contains(split_part({_MENDED}, '@', 2), '.') THEN concat(split_part({_MENDED}, '@', 1), '@', split_part({_MENDED}, '@', 2), '.com') END END AS repaired FROM contacts")
def emails_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts(spark, sf_dir).select("row_id", text.repair_email(F.col("email")).alias("repaired"))


@query("SELECT p_partkey, CAST(round(1 - CAST(levenshtein(p_name, other) AS DOUBLE) / greatest(length(p_name), length(other), 1), 6) AS DOUBLE) AS similarity FROM (SELECT p_partkey, p_name, lag(p_name) OVER (ORDER BY p_partkey) AS other FROM part) WHERE other IS NOT NULL")
def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    before = parts.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return parts.join(before, "p_partkey").select("p_partkey", F.round(text.similarity(F.col("p_name"), F.col("other")), 6).alias("similarity"))


@query(f"SELECT 'conversations' AS source, count(*) AS cells, count(*) FILTER (WHERE {_missing('text')}) AS missing, CAST(max(length(text)) AS BIGINT) AS longest FROM conversations UNION ALL SELECT 'documents', count(*), count(*) FILTER (WHERE {_missing('text')}), CAST(max(length(text)) AS BIGINT) FROM documents UNION ALL SELECT 'pages', count(*), count(*) FILTER (WHERE {_missing('html')}), CAST(max(length(html)) AS BIGINT) FROM pages")
def text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(name: str, column: str) -> DataFrame:
        v = F.col(column)
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").agg(F.count(F.lit(1)).alias("cells"), F.count_if(text.is_missing(v)).alias("missing"), F.max(F.length(v)).cast("bigint").alias("longest")).select(F.lit(name).alias("source"), "cells", "missing", "longest")

    return one("conversations", "text").unionByName(one("documents", "text")).unionByName(one("pages", "html"))


# --- review and apply ---------------------------------------------------------------------------

#: A reviewer's decision on each suggestion, by its row's number.
DECIDED = "CASE n % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'edited' WHEN 2 THEN 'rejected' ELSE 'pending' END"
SUGGESTED_SQL = f"{FINDINGS_SQL}, sug AS MATERIALIZED (SELECT *, concat(type, ':', column_key) AS group_key, CASE type WHEN 'missing_value' THEN 0.9 WHEN 'outlier' THEN 0.91 WHEN 'type_mismatch' THEN 0.92 ELSE CASE column_key WHEN 'phone' THEN 0.96 WHEN 'signup_date' THEN CASE WHEN day_month THEN 0.6 ELSE 0.9 END ELSE 0.94 END END AS confidence, CAST(substr(row_id, 3) AS BIGINT) AS n FROM (SELECT found.*, coalesce({_valid('y', 'b', 'a')} AND {_valid('y', 'a', 'b')} AND a <> b, false) AS day_month FROM (SELECT found.*, TRY_CAST(regexp_extract(c.signup_date, '^([0-9]+)[/.]([0-9]+)[/.]([0-9]+)$', 1) AS INT) AS a, TRY_CAST(regexp_extract(c.signup_date, '^([0-9]+)[/.]([0-9]+)[/.]([0-9]+)$', 2) AS INT) AS b, TRY_CAST(regexp_extract(c.signup_date, '^([0-9]+)[/.]([0-9]+)[/.]([0-9]+)$', 3) AS INT) AS y FROM found JOIN contacts c USING (row_id)) found) found WHERE NOT ambiguous), decided AS MATERIALIZED (SELECT *, {DECIDED} AS status FROM sug)"


def _reviewed(found: DataFrame) -> DataFrame:
    suggested = review.suggestions(found).withColumn("n", F.substring("row_id", 3, 20).cast("bigint"))
    return suggested.withColumn("status", F.expr(DECIDED)).withColumn("final_value", F.when(F.col("status") == "edited", "by hand"))


@query(f"WITH {SUGGESTED_SQL} SELECT group_key, count(*) AS size, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status <> 'pending') AS resolved, count(*) FILTER (WHERE NOT (confidence >= 0.7 AND action <> 'no_action')) AS low_confidence, count(*) FILTER (WHERE status = 'pending' AND confidence >= 0.7 AND action <> 'no_action') AS bulk_acceptable FROM decided GROUP BY group_key")
def suggestion_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.build_groups(_reviewed(_found(spark, sf_dir))).select("group_key", "size", "pending", "resolved", "low_confidence", "bulk_acceptable")


#: Severity of every row-level finding, and what its type is called.
_SEVERITY = "CASE WHEN type = 'missing_value' AND NOT ambiguous OR type = 'type_mismatch' AND NOT ambiguous OR type = 'inconsistent_format' AND column_key = 'signup_date' THEN 1 WHEN type = 'inconsistent_format' THEN 2 ELSE 0 END"
_LABEL = "concat(CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in review.LABELS.items()) + " END, ' · column \"', column_key, '\"')"


@query(f"WITH {FINDINGS_SQL} SELECT concat(type, ':', column_key) AS group_key, CASE min({_SEVERITY}) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM found GROUP BY type, column_key")
def group_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.group_severity(_found(spark, sf_dir))


@query(
    f"""WITH {SUGGESTED_SQL}, worst AS (SELECT type, column_key, min({_SEVERITY}) AS s FROM found GROUP BY type, column_key),
g AS (SELECT type, column_key, {_LABEL} AS label, count(*) AS size, count(*) FILTER (WHERE status = 'pending') AS pending FROM decided GROUP BY type, column_key)
SELECT row_number() OVER (ORDER BY pending > 0 DESC, s, size DESC, label) - 1 AS place, type, column_key, label, CASE s WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM g JOIN worst USING (type, column_key)"""
)
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the order in which they are reviewed; there is one row a type and column."""
    found = _found(spark, sf_dir)
    groups = review.build_groups(_reviewed(found), review.group_severity(found))
    return groups.coalesce(1).select(F.monotonically_increasing_id().alias("place"), "type", "column_key", "label", "severity")


@query(f"WITH {SUGGESTED_SQL} SELECT group_key, row_id FROM decided WHERE status = 'pending' AND confidence >= 0.7 AND action <> 'no_action'")
def bulk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.bulk_acceptable(_reviewed(_found(spark, sf_dir))).select("group_key", "row_id")


@query(f"WITH {SUGGESTED_SQL} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("pending", "accepted", "rejected", "edited")) + " FROM decided")
def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.totals(_reviewed(_found(spark, sf_dir)))


def _decided(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contacts, suggestions and decisions on them."""
    rows = contacts(spark, sf_dir)
    reviewed = _reviewed(_found(spark, sf_dir) if found is None else found)
    # the order in which decisions were made: by row, then by column
    decisions = reviewed.filter("status <> 'pending'").select("suggestion_id", "status", "final_value", (F.col("n") * 100 + F.array_position(F.array(*map(F.lit, HEADERS)), F.col("column_key")) * 10 + F.array_position(F.array(*map(F.lit, ISSUE_TYPES)), F.element_at(F.split("group_key", ":"), 1))).alias("decision_seq"))
    return rows, reviewed.drop("n", "status", "final_value"), decisions


def _planned(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    rows, made, decisions = _decided(spark, sf_dir, found)
    return rows, apply.plan_changes(decisions, made, rows, HEADERS)


_PLACES = "(n * 100 + list_position([" + ", ".join(f"'{h}'" for h in HEADERS) + "], column_key) * 10 + list_position([" + ", ".join(f"'{t}'" for t in ISSUE_TYPES) + "], type))"
PLANNED_SQL = f"""{SUGGESTED_SQL}, planned0 AS (SELECT d.*, {_PLACES} AS seq, c.value AS cell, CASE WHEN status = 'edited' THEN 'by hand' ELSE proposed_value END AS final_value FROM decided d JOIN cells c USING (row_id, column_key) WHERE status <> 'pending'),
planned AS MATERIALIZED (SELECT *, CASE WHEN status IN ('accepted', 'edited') AND action IN ('set_value', 'normalize_value') AND cell <> coalesce(final_value, '') THEN 'cell' END AS change_kind FROM planned0)"""


@query(f"WITH {PLANNED_SQL} SELECT row_id, column_key, status, final_value, change_kind, CASE WHEN change_kind = 'cell' THEN cell END AS before, CASE WHEN change_kind = 'cell' THEN coalesce(final_value, '') END AS after FROM planned")
def planned_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir)[1].select("row_id", "column_key", "status", "final_value", "change_kind", "before", "after")


@query(f"WITH {PLANNED_SQL} SELECT count(*) FILTER (WHERE change_kind = 'cell') AS cells_changed, CAST(0 AS BIGINT) AS rows_deleted, count(DISTINCT CASE WHEN change_kind IS NOT NULL THEN row_id END) AS rows_touched, count(*) AS recorded FROM planned")
def apply_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.summarise(_planned(spark, sf_dir)[1])


_LAST = "last_edit AS (SELECT row_id, column_key, coalesce(final_value, '') AS after FROM planned WHERE change_kind = 'cell' QUALIFY row_number() OVER (PARTITION BY row_id, column_key ORDER BY seq DESC) = 1)"


@query(f"WITH {PLANNED_SQL}, {_LAST} SELECT c.row_id, " + ", ".join(f"coalesce(max(CASE WHEN e.column_key = '{h}' THEN after END), any_value(c.{h})) AS {h}" for h in HEADERS) + ", count(e.column_key) > 0 AS dirty, false AS deleted FROM contacts c LEFT JOIN last_edit e USING (row_id) GROUP BY c.row_id")
def cells_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, planned = _planned(spark, sf_dir)
    return apply.write_back(rows, HEADERS, planned).drop("row_index")


@query(ORACLES["cells_applied"])
def cells_applied_to_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stored table, where files without a changed row are carried over."""
    rows, planned = _planned(spark, sf_dir)
    table = tables.store(rows, f"{shared_dir(spark)}/tidemark/table-{uuid.uuid4().hex}", file_rows=1000)
    return table.edited(HEADERS, keep(planned, "planned")).rows.drop("row_index")


@query(ORACLES["cells_applied"])
def decisions_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where decisions arrive in three batches, and every one of them twice more, contradicted, in the last."""
    rows, made, decisions = _decided(spark, sf_dir)
    base = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    table = tables.store(rows, f"{base}/table", file_rows=1000)
    made, decisions = keep(made, "suggested"), keep(decisions, "decisions")
    # no cell has decisions in two batches: the row tells the batch
    parted = decisions.join(made.select("suggestion_id", F.pmod(F.xxhash64("row_id"), F.lit(2)).alias("turn")), "suggestion_id")
    contrary = decisions.withColumns({"status": F.lit("edited"), "final_value": F.lit("too late"), "decision_seq": F.col("decision_seq") + 1})
    for arrives in (parted.filter("turn = 0").drop("turn"), parted.filter("turn = 1").drop("turn"), contrary.unionByName(contrary)):
        # files arrive in the order of their times
        arrives.coalesce(1).write.mode("append").parquet(f"{base}/in")
    arriving = spark.readStream.schema(decisions.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    apply_stream(arriving, made, table.folder, table.schema, HEADERS, f"{base}/out", f"{base}/state").awaitTermination()
    return tables.open_table(spark, table.folder, table.schema).rows.drop("row_index")


@query(f"SELECT row_index, customer_id, full_name FROM ({CONTACTS}) c ORDER BY row_index LIMIT 100 OFFSET (SELECT count(*) // 2 FROM customer)")
def page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 100 rows in the middle of a stored table."""
    rows = contacts(spark, sf_dir)
    table = tables.store(rows, f"{shared_dir(spark)}/tidemark/table-{uuid.uuid4().hex}", file_rows=1000)
    return table.page(rows.count() // 2, 100).select("row_index", "customer_id", "full_name")


@query(f"WITH {PLANNED_SQL} SELECT row_id, column_key, status AS review_status, final_value, CASE WHEN change_kind = 'cell' THEN cell END AS before_value, CASE WHEN change_kind = 'cell' THEN coalesce(final_value, '') END AS after_value FROM planned")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.audit(_planned(spark, sf_dir)[1]).select("row_id", "column_key", "review_status", "final_value", F.try_element_at("before_state", F.col("column_key")).alias("before_value"), F.try_element_at("after_state", F.col("column_key")).alias("after_value"))


def _published(spark: SparkSession, sf_dir: str) -> str:
    """Contacts with their decisions applied, published with the audit log; the version's path."""
    rows, planned = _planned(spark, sf_dir)
    planned = keep(planned, "planned")
    done = apply.write_back(rows, HEADERS, planned)
    return publish(spark, f"{shared_dir(spark)}/tidemark/exports", "Contacts 2024.csv", done, HEADERS, apply.audit(planned), "contacts")


@query(f"SELECT {', '.join(HEADERS)} FROM ({ORACLES['cells_applied']}) done")
def cleaned_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published CSV, read again."""
    _, rows = csv_source.read_csv(spark, f"{_published(spark, sf_dir)}/cleaned.csv", delimiter=",")
    return rows.select(*HEADERS)


@query(f"WITH {PLANNED_SQL} SELECT 'decision' AS kind, 'contacts' AS dataset_id, CAST(seq AS BIGINT) AS seq, row_id, column_key, status AS review_status, final_value, CASE WHEN change_kind = 'cell' THEN cell END AS before_value FROM planned")
def audit_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published audit log, one JSON line a decision, read again."""
    lines = spark.read.schema("kind string, dataset_id string, seq long, body string").json(f"{_published(spark, sf_dir)}/audit.json")
    body = F.from_json("body", "row_id string, column_key string, review_status string, final_value string, before_state map<string, string>")
    told = lines.select("kind", "dataset_id", "seq", body.alias("b"))
    return told.select("kind", "dataset_id", "seq", "b.row_id", "b.column_key", "b.review_status", "b.final_value", F.try_element_at("b.before_state", F.col("b.column_key")).alias("before_value"))


@query("SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS first_id FROM documents) WHERE doc_id = first_id OR doc_id % 2 = 1")
def rows_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies with an even id are deleted on accepted decisions, the others rejected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("row_id"), F.col("doc_id").alias("row_index"), "text", "lang")
    made = review.suggestions(detect_dups.exact_duplicates(docs, ["text", "lang"]))
    status = F.when(F.col("row_id").cast("bigint") % 2 == 0, "accepted").otherwise("rejected")
    decisions = made.select("suggestion_id", status.alias("status"), F.lit(None).cast("string").alias("final_value"), F.lit(1).alias("decision_seq"))
    planned = apply.plan_changes(decisions, made, docs, ["lang"])
    kept = apply.write_back(docs, ["text", "lang"], planned).filter("not deleted")
    return kept.select(F.col("row_index").alias("doc_id"))


# --- reports ------------------------------------------------------------------------------------


@query(f"WITH {FINDINGS_SQL} SELECT t.type, count(found.type) AS issues FROM (VALUES " + ", ".join(f"('{t}')" for t in ISSUE_TYPES) + ") t(type) LEFT JOIN found USING (type) GROUP BY t.type")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.issue_counts(_found(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT type, count(*) AS issues FROM found GROUP BY type")
def health_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.health_ranking(_found(spark, sf_dir))


@query(f"WITH {STATS_SQL} SELECT round((n * 8 - m) / (n * 8), 4) AS completeness FROM (SELECT CAST((SELECT count(*) FROM contacts) AS DOUBLE) AS n, (SELECT sum(null_count) FROM stats) AS m)")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contacts(spark, sf_dir)
    return report.completeness(stats.column_stats(rows, HEADERS).columns, rows.count())


@query(f"WITH {FINDINGS_SQL} SELECT round(avg(CASE WHEN ambiguous THEN 0.0 ELSE 1.0 END), 9) AS rate FROM found")
def resolution_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_resolution_rate(_found(spark, sf_dir)).select(F.round("rate", 9).alias("rate"))


@query(f"WITH {PLANNED_SQL} SELECT f.type, f.column_key, f.row_id, CAST(substr(f.row_id, 3) AS BIGINT) AS row_number, f.ambiguous, f.action, p.status AS review_status FROM found f LEFT JOIN planned p USING (type, column_key, row_id)")
def finding_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    rows, planned = _planned(spark, sf_dir, found)
    traced = report.trace(found, review.suggestions(found), apply.audit(planned), rows)
    number = F.col("row_numbers")[0]
    return traced.select("type", "column_key", F.concat(F.lit("r-"), number.cast("string")).alias("row_id"), number.alias("row_number"), "ambiguous", "action", "review_status")


@query(f"WITH {PLANNED_SQL}, o AS (SELECT event_type AS dataset_id, count(*) AS row_count FROM events GROUP BY 1) SELECT dataset_id, row_count, CAST(CASE WHEN dataset_id = 'click' THEN (SELECT count(*) FROM decided) ELSE 0 END AS BIGINT) AS suggestion_count, CAST(CASE WHEN dataset_id = 'click' THEN (SELECT count(*) FROM decided WHERE status = 'pending') ELSE 0 END AS BIGINT) AS pending_count FROM o")
def datasets_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("dataset_id")).agg(F.count(F.lit(1)).alias("row_count"), F.max("ts").alias("created_at"))
    listed = catalog.list_datasets(kinds, _reviewed(_found(spark, sf_dir)).withColumn("dataset_id", F.lit("click")))
    return listed.select("dataset_id", "row_count", "suggestion_count", "pending_count")


# --- enrichment and evaluation ------------------------------------------------------------------


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(enrich.candidates(enrich.work_queue(_found(spark, sf_dir), None), contacts(spark, sf_dir), HEADERS), "candidates")


_BUILTIN = f"""{FINDINGS_SQL}, asked AS (SELECT f.*, c.value FROM found f JOIN cells c USING (row_id, column_key) WHERE ambiguous),
mended AS MATERIALIZED (SELECT *, regexp_replace(value, ',([a-z]{{2,4}})$', '.\\1', 'i') AS m FROM asked),
told AS MATERIALIZED (SELECT type, column_key, row_id, value, CASE WHEN type = 'suspicious_value' AND contains(value, '@') THEN CASE WHEN regexp_matches(m, '(?i)^[^\\s@]+@[^\\s@]+\\.[a-z]{{2,}}$') THEN m WHEN split_part(m, '@', 2) <> '' AND NOT contains(split_part(m, '@', 2), '.') THEN concat(m, '.com') END END AS fixed FROM mended)"""

_SURE = "CAST(CASE WHEN fixed IS NOT NULL THEN 0.8 WHEN type = 'suspicious_value' THEN 0.4 WHEN type = 'missing_value' THEN 0.3 ELSE 0.45 END AS DOUBLE)"


@query(f"WITH {_BUILTIN} SELECT type, column_key, row_id, CASE WHEN fixed IS NOT NULL THEN 'set_value' ELSE 'no_action' END AS action, fixed AS proposed_value, {_SURE} AS confidence FROM told")
def builtin_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    told = enrich.builtin_verdicts(asked).join(asked.select("candidate_id", "type", "column_key"), "candidate_id")
    return told.select("type", "column_key", "row_id", "action", "proposed_value", "confidence")


def _noisy(asked: DataFrame) -> DataFrame:
    """Verdicts with every fault: strangers, foreign rows, repeats, odd confidences, empty rewrites."""
    n = F.substring(F.col("rows")[0]["row_id"], 3, 20).cast("bigint")
    base = asked.withColumn("n", n)
    say = lambda seq, candidate, row, action, value, confidence: base.select(candidate.alias("candidate_id"), row.alias("row_id"), action.alias("action"), value.alias("proposed_value"), confidence.alias("confidence"), F.lit("  why  ").alias("rationale"), F.lit(seq).alias("seq"))
    own, row = F.col("candidate_id"), F.col("rows")[0]["row_id"]
    first = say(1, F.when(F.col("n") % 5 == 0, "stranger").otherwise(own), F.when(F.col("n") % 3 == 0, "r-0").otherwise(row), F.lit("set_value"), F.when(F.col("n") % 2 == 0, "x"), F.when(F.col("n") % 7 == 0, F.lit(float("nan"))).otherwise(F.lit(1.5)))
    second = say(2, own, row, F.lit("delete_row"), F.lit(None).cast("string"), F.lit(0.25)).filter("candidate_id is not null")
    return first.unionByName(second.join(base.filter("n % 3 <> 1").select("candidate_id"), "candidate_id", "left_semi"))


_N = "CAST(substr(row_id, 3) AS BIGINT)"
_FIRST = f"({_N} % 5 <> 0 AND {_N} % 3 <> 0)"


@query(f"WITH {_BUILTIN} SELECT type, column_key, row_id, CASE WHEN {_FIRST} THEN CASE WHEN {_N} % 2 = 0 THEN 'set_value' ELSE 'no_action' END ELSE 'delete_row' END AS action, CASE WHEN {_FIRST} AND {_N} % 2 = 0 THEN 'x' END AS proposed_value, CAST(CASE WHEN {_FIRST} THEN CASE WHEN {_N} % 7 = 0 THEN 0 ELSE 1 END ELSE 0.25 END AS DOUBLE) AS confidence, 'why' AS rationale FROM told WHERE {_FIRST} OR {_N} % 3 <> 1")
def verdicts_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    clean = enrich.sanitise(_noisy(asked), asked).join(asked.select("candidate_id", "type", "column_key"), "candidate_id")
    return clean.select("type", "column_key", "row_id", "action", "proposed_value", "confidence", "rationale")


@query(f"WITH {_BUILTIN} SELECT type, column_key, row_id, CAST(0.3 AS DOUBLE) AS confidence, 'no_action' AS action, 'llm' AS source FROM told WHERE NOT ({_FIRST} OR {_N} % 3 <> 1)")
def unanswered_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    # no verdict here says 0.3: that confidence marks the cards of unanswered candidates
    cards = enrich.cards(asked, enrich.sanitise(_noisy(asked), asked)).filter("confidence = 0.3")
    made = cards.join(asked.select(F.col("candidate_id").alias("issue_id"), "type"), "issue_id")
    return made.select("type", "column_key", "row_id", "confidence", "action", "source")


@query(f"WITH {_BUILTIN}, s AS (SELECT *, CASE WHEN {_N} % 2 = 0 THEN 'set_value' ELSE 'no_action' END AS expected, CASE WHEN {_N} % 2 = 0 THEN concat(replace(replace(value, ',com', ''), '.com', ''), '.com') END AS expected_value, CASE WHEN fixed IS NOT NULL THEN 'set_value' ELSE 'no_action' END AS action, {_SURE} AS confidence FROM told) SELECT 'builtin' AS model, count(*) AS total, count(*) AS answered, count(*) FILTER (WHERE action = expected) AS action_correct, count(*) FILTER (WHERE action = expected) AS effective_correct, CAST(0 AS BIGINT) AS noop_merges, count(expected_value) AS value_expected, count(*) FILTER (WHERE expected_value IS NOT NULL AND lower(trim(coalesce(fixed, ''))) = lower(trim(expected_value))) AS value_correct, round(coalesce(avg(CASE WHEN action = expected THEN confidence END), 0), 6) AS confidence_right, round(coalesce(avg(CASE WHEN action <> expected THEN confidence END), 0), 6) AS confidence_wrong FROM s")
def evaluation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = evaluate.score(*_answers(spark, sf_dir))
    return scored.withColumns({c: F.round(c, 6) for c in ("confidence_right", "confidence_wrong")})


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates with made-up answers, and the built-in reviewer's verdicts."""
    asked = _asked(spark, sf_dir)
    cell = F.coalesce(F.col("current_value"), F.lit(""))
    named = asked.withColumn("row_id", F.col("rows")[0]["row_id"])
    even = F.substring("row_id", 3, 20).cast("bigint") % 2 == 0
    guess = F.concat(F.replace(F.replace(cell, F.lit(",com"), F.lit("")), F.lit(".com"), F.lit("")), F.lit(".com"))
    specs = named.select(F.lit(1).alias("seq"), "column_key", "row_id", F.when(even, "set_value").otherwise("no_action").alias("action"), F.when(even, guess).alias("proposed_value"))
    return evaluate.truth_for(named, specs), enrich.builtin_verdicts(asked).withColumn("model", F.lit("builtin"))


_JUDGED = f"{_BUILTIN}, s AS (SELECT type, column_key, row_id, {_SURE} AS confidence, CASE WHEN {_N} % 2 = 0 THEN 'set_value' ELSE 'no_action' END AS expected, CASE WHEN fixed IS NOT NULL THEN 'set_value' ELSE 'no_action' END AS action FROM told)"


@query(f"WITH {_JUDGED} SELECT 'builtin' AS model, type, count(*) AS total, count(*) FILTER (WHERE action = expected) AS correct FROM s GROUP BY type")
def evaluation_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_by_type(*_answers(spark, sf_dir))


@query(f"WITH {_JUDGED} SELECT 'builtin' AS model, type, column_key, row_id, expected, action AS got, confidence FROM s WHERE action <> expected")
def evaluation_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.misses(*_answers(spark, sf_dir)).drop("candidate_id")


_ID = "sha256(concat(type, chr(31), column_key, chr(31), row_id))"


@query(f"WITH {FINDINGS_SQL} SELECT type, column_key, row_id FROM (SELECT *, {_ID} AS issue_id FROM found WHERE ambiguous) ORDER BY issue_id LIMIT 25")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first batch that goes to review."""
    return enrich.work_queue(_found(spark, sf_dir)).select("type", "column_key", F.col("row_ids")[0].alias("row_id"))


@query(f"WITH {FINDINGS_SQL} SELECT type, column_key, row_id, CAST((row_number() OVER (ORDER BY {_ID}) - 1) // 25 AS BIGINT) AS batch FROM found WHERE ambiguous")
def review_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.batched(_asked(spark, sf_dir)).select("type", "column_key", F.col("rows")[0]["row_id"].alias("row_id"), "batch")


@query(f"WITH {FINDINGS_SQL} SELECT type, count(*) FILTER (WHERE ambiguous AND {_N} % 2 = 1) AS waiting, count(*) FILTER (WHERE ambiguous) AS queued FROM found GROUP BY type")
def queue_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguous findings before and after those of even rows were asked about."""
    found = _found(spark, sf_dir)
    asked = found.filter("ambiguous").filter(F.substring(F.col("row_ids")[0], 3, 20).cast("bigint") % 2 == 0)
    after = enrich.clear_queue(found, asked.select("issue_id"))
    queued = found.groupBy("type").agg(F.count_if("ambiguous").alias("queued"))
    return after.groupBy("type").agg(F.count_if("ambiguous").alias("waiting")).join(queued, "type")


_PAIRS_SQL = f"""rows0 AS ({SUPPLIERS}), k AS (SELECT row_id, row_index, {_key("name")} AS a, {_key("city")} AS b, {_key("code")} AS c FROM rows0),
sig AS MATERIALIZED (SELECT *, concat(a, '|', b, '|', c) AS s FROM k),
pairs AS (SELECT x.row_id AS a_id, x.row_index AS a_index, y.row_id AS b_id, 1 - CAST(levenshtein(x.s, y.s) AS DOUBLE) / greatest(length(x.s), length(y.s)) AS score
  FROM sig x JOIN sig y ON x.row_index < y.row_index AND (left(x.a, 3) = left(y.a, 3) OR left(x.b, 3) = left(y.b, 3) OR left(x.c, 3) = left(y.c, 3)) WHERE abs(length(x.s) - length(y.s)) <= 0.15 * greatest(length(x.s), length(y.s)) + 1e-9)"""


@query(f"WITH {_PAIRS_SQL} SELECT b_id AS row_id, CASE WHEN score > 0.9 THEN 'delete_row' ELSE 'no_action' END AS action, round(score, 2) AS confidence FROM pairs WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY score DESC, a_index) = 1")
def fuzzy_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in reviewer's verdicts on similar suppliers."""
    _tables(spark, sf_dir, "supplier")
    rows, names = spark.sql(SUPPLIERS), ["name", "city", "code"]
    queue = keep(enrich.work_queue(detect_dups.fuzzy_duplicates(rows, names), None), "queue")
    return enrich.builtin_verdicts(enrich.candidates(queue, rows, names)).select("row_id", "action", "confidence")


# --- decisions ----------------------------------------------------------------------------------


@query(f"WITH {SUGGESTED_SQL} SELECT type, column_key, row_id, CASE WHEN n % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS now, 'accepted' AS undone, 'pending' AS reset FROM sug")
def decisions_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accepted in a first batch, every third row rejected in a second; the second undone; all reset."""
    made = _reviewed(_found(spark, sf_dir)).drop("status", "final_value")
    none = F.lit(None).cast("string")
    event = lambda df, status, seq: df.select("suggestion_id", F.lit(status).alias("status"), none.alias("final_value"), F.lit(seq).alias("batch"), F.lit(seq).alias("seq"))
    events = event(made, "accepted", 1).unionByName(event(made.filter("n % 3 = 0"), "rejected", 2))
    status = lambda of, name: review.with_status(made, review.current_decisions(of)).select("suggestion_id", F.col("status").alias(name))
    out = made.select("suggestion_id", F.element_at(F.split("group_key", ":"), 1).alias("type"), "column_key", "row_id")
    for of, name in ((events, "now"), (review.undo(events), "undone"), (review.reset(events), "reset")):
        out = out.join(status(of, name), "suggestion_id")
    return out.drop("suggestion_id")


@query(f"WITH {SUGGESTED_SQL} SELECT type, column_key, row_id, status, CASE status WHEN 'rejected' THEN NULL WHEN 'edited' THEN 'by hand' ELSE proposed_value END AS final_value, CAST(row_number() OVER (ORDER BY {_ID}) AS INT) AS decision_seq FROM decided WHERE status <> 'pending'")
def decision_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = _reviewed(_found(spark, sf_dir)).withColumn("type", F.element_at(F.split("group_key", ":"), 1))
    return review.decision_list(reviewed, "type", "column_key", "row_id").drop("suggestion_id")


@query(f"WITH {PLANNED_SQL} SELECT d.type, d.column_key, d.row_id, d.status, p.final_value FROM decided d LEFT JOIN planned p USING (type, column_key, row_id)")
def statuses_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions after apply: pending ones stay, others carry what was decided."""
    found = _found(spark, sf_dir)
    _, planned = _planned(spark, sf_dir, found)
    done = apply.update_statuses(review.suggestions(found), planned)
    return done.select(F.element_at(F.split("group_key", ":"), 1).alias("type"), "column_key", "row_id", "status", "final_value")


@query(f"WITH {_BUILTIN}, q AS (SELECT count(*) AS n FROM told), r AS (SELECT count(*) AS n FROM found WHERE NOT ambiguous) SELECT round(CAST(r.n AS DOUBLE) / (r.n + q.n), 9) AS rule_share FROM q, r")
def rule_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rules among all suggestions, those of the built-in reviewer included."""
    found = _found(spark, sf_dir)
    asked = keep(enrich.candidates(enrich.work_queue(found, None), contacts(spark, sf_dir), HEADERS), "candidates")
    cards = enrich.cards(asked, enrich.sanitise(enrich.verdicts_of(asked, None), asked))
    return report.rule_share(review.suggestions(found).unionByName(cards, allowMissingColumns=True)).select(F.round("rule_share", 9).alias("rule_share"))


class House:
    """A reviewer that leaves everything as it is, and counts ten tokens a question and one an answer. It refuses to read about phones."""

    provider, model = "house", "small"

    def review(self, prompt: str, batch: list[dict]) -> tuple[list[dict], enrich.Usage]:
        told = [{"candidateId": c["candidate_id"], "rowId": c["rows"][0]["row_id"], "action": "no_action", "confidence": 0.5, "rationale": "seen"} for c in batch if c["column_key"] != "phone"]
        return told, enrich.Usage(self.provider, self.model, 10 * len(batch), len(told))


@query(f"WITH {PLANNED_SQL} SELECT (SELECT count(*) FROM found) AS findings, (SELECT count(*) FROM sug) AS suggested, (SELECT count(*) FROM sug) AS by_rule, (SELECT count(*) FROM planned) AS decided, (SELECT CAST(count(*) * 10 + count(*) FILTER (WHERE column_key <> 'phone') AS BIGINT) FROM found WHERE ambiguous) AS tokens")
def trace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    rows, planned = _planned(spark, sf_dir, found)
    traced = report.trace(found, review.suggestions(found), apply.audit(planned), rows)
    asked = keep(enrich.candidates(enrich.work_queue(found, None), contacts(spark, sf_dir), HEADERS), "candidates")
    return report.trace_stats(traced, report.record_usage(enrich.reviewed(asked, House(), "").calls))


@query(f"WITH {FINDINGS_SQL} SELECT 'house' AS provider, 'small' AS model, CAST(0 AS BIGINT) AS failed_calls, count(*) AS asked, CAST(10 * count(*) AS BIGINT) AS input_tokens, CAST(count(*) FILTER (WHERE column_key <> 'phone') AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cached_tokens FROM found WHERE ambiguous")
def usage_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all calls of an outside reviewer used."""
    return report.usage_summary(enrich.reviewed(_asked(spark, sf_dir), House(), "").calls).drop("calls", "tries")


@query(f"WITH {FINDINGS_SQL} SELECT type, column_key, row_id, {_N} % 5 = 0 AS asked_again, column_key <> 'phone' AS answered FROM found WHERE ambiguous")
def review_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review done twice with one ledger; between the runs every fifth row is edited, and only those are asked again."""
    rows = contacts(spark, sf_dir)
    queue = enrich.work_queue(_found(spark, sf_dir), None)
    ledger = f"{shared_dir(spark)}/tidemark/ledger-{uuid.uuid4().hex}"
    asked = keep(enrich.candidates(queue, rows, HEADERS), "candidates")
    enrich.resumed(asked, House(), ledger)
    edited = rows.withColumn("status", F.when((F.col("row_index") + 1) % 5 == 0, "edited").otherwise(F.col("status")))
    later = keep(enrich.candidates(queue, edited, HEADERS), "candidates")
    before = enrich.read_ledger(spark, ledger).select("key").distinct().withColumn("known", F.lit(True))
    again = keep(later.withColumn("key", enrich.question_key(later)).join(before, "key", "left").select("candidate_id", "type", "column_key", F.col("rows")[0]["row_id"].alias("row_id"), F.col("known").isNull().alias("asked_again")), "again")
    answered = enrich.resumed(later, House(), ledger).verdicts.select("candidate_id", F.lit(True).alias("answered"))
    return again.join(answered, "candidate_id", "left").select("type", "column_key", "row_id", "asked_again", F.coalesce("answered", F.lit(False)).alias("answered"))


# --- files --------------------------------------------------------------------------------------


@query(f"WITH {CELLS_SQL} SELECT row_index, {', '.join(HEADERS)} FROM contacts")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts written as CSV in several files and read again."""
    path = f"{shared_dir(spark)}/tidemark/csv-{uuid.uuid4().hex}"
    csv_source.write_csv(contacts(spark, sf_dir), path, HEADERS)
    _, rows = csv_source.read_csv(spark, path, delimiter=",")
    return rows.drop("row_id")


_TRIMMED = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, CAST(doc_id AS VARCHAR) AS doc_id, {_TRIMMED.format('text')} AS text, {_TRIMMED.format('source')} AS source FROM documents")
def csv_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, with line ends and quotes in them, written as CSV files and read again in parallel."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("row_index"), F.col("doc_id").cast("string").alias("doc_id"), "text", "source")
    path = f"{shared_dir(spark)}/tidemark/csv-{uuid.uuid4().hex}"
    csv_source.write_csv(docs, path, ["doc_id", "text", "source"])
    _, rows = csv_source.read_csv(spark, path, delimiter=",")
    return rows.drop("row_id")


# --- whole profiles and streams -----------------------------------------------------------------

#: Contacts, copies of every fiftieth and near copies of some others behind them.
TWICE = f"""
SELECT * FROM ({CONTACTS}) once
UNION ALL SELECT concat(row_id, 'c'), row_index + 100000000, {", ".join(HEADERS)} FROM ({CONTACTS}) copied WHERE row_index % 50 = 0
UNION ALL SELECT concat(row_id, 'n'), row_index + 200000000, customer_id, concat(full_name, 'x'), {", ".join(HEADERS[2:])} FROM ({CONTACTS}) close WHERE row_index % 60 = 1
"""
_PREFIXES = " OR ".join(f"(x.k{i} <> '' AND left(x.k{i}, 3) = left(y.k{i}, 3))" for i in range(len(HEADERS)))
_ALL = f"""{FINDINGS_SQL.replace(CONTACTS, TWICE)},
copies AS (SELECT row_id, row_index, min_by(row_id, row_index) OVER w AS first_id, min(row_index) OVER w AS first_index FROM contacts WINDOW w AS (PARTITION BY {", ".join(HEADERS)})),
keyed AS MATERIALIZED (SELECT contacts.row_id, contacts.row_index, {", ".join(f"{_key(h)} AS k{i}" for i, h in enumerate(HEADERS))} FROM contacts JOIN copies USING (row_id) WHERE contacts.row_index = first_index),
sig AS MATERIALIZED (SELECT *, concat_ws('|', {", ".join(f"k{i}" for i in range(len(HEADERS)))}) AS s FROM keyed),
pairs AS (SELECT x.row_id AS a_id, x.row_index AS a_index, y.row_id AS b_id, 1 - CAST(levenshtein(x.s, y.s) AS DOUBLE) / greatest(length(x.s), length(y.s)) AS score FROM sig x JOIN sig y ON x.row_index < y.row_index AND abs(length(x.s) - length(y.s)) <= 0.15 * greatest(length(x.s), length(y.s)) + 1e-9 AND ({_PREFIXES}))"""


@query(
    f"""WITH {_ALL} SELECT type, column_key, row_id AS rows, ambiguous, proposed_value FROM found
UNION ALL SELECT 'exact_duplicate', NULL, concat(row_id, ',', first_id), false, NULL FROM copies WHERE row_index > first_index
UNION ALL SELECT 'fuzzy_duplicate', NULL, concat(b_id, ',', a_id), true, NULL FROM (SELECT * FROM pairs WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY score DESC, a_index) = 1) best"""
)
def whole_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors together over contacts with copies."""
    _spread_customers(spark, sf_dir)
    found = profile_dataset(spark.sql(TWICE), HEADERS).findings
    return found.select("type", "column_key", F.array_join("row_ids", ",").alias("rows"), "ambiguous", "proposed_value")


@query(
    f"""WITH {_ALL} SELECT 'exact_duplicate' AS type, concat(row_id, ',', first_id) AS rows, false AS ambiguous FROM copies WHERE row_index > first_index
UNION ALL SELECT 'fuzzy_duplicate', concat(b_id, ',', a_id), true FROM (SELECT * FROM pairs WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY score DESC, a_index) = 1) best"""
)
def streamed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts, then their copies, then near copies, a micro-batch each: the cross-row findings of a batch run."""
    _spread_customers(spark, sf_dir)
    rows = spark.sql(TWICE)
    base = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    for k in range(3):
        # files arrive in the order of their times
        rows.filter(F.floor(F.col("row_index") / 100_000_000) == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    cross_row.cross_row_stream(arriving, HEADERS, f"{base}/out", f"{base}/state").awaitTermination()
    return cross_row.found_so_far(spark, f"{base}/out").select("type", F.array_join("row_ids", ",").alias("rows"), "ambiguous")


@query(f"WITH {FINDINGS_SQL} SELECT type, column_key, row_id, ambiguous, action, proposed_value FROM found")
def streamed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts that arrive in files, one a micro-batch: the findings of a batch run."""
    rows = contacts(spark, sf_dir)
    known = stats.column_stats(rows, HEADERS)
    base = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    rows.repartition(3, "row_index").write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    detect_stream(arriving, HEADERS, known, f"{base}/out", f"{base}/state").awaitTermination()
    return _narrow(spark.read.parquet(f"{base}/out"))


@query(ORACLES["column_profile"])
def streamed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts that arrive in files: statistics from value counts of the batches alone."""
    rows = contacts(spark, sf_dir)
    base = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    rows.repartition(3, "row_index").write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    statistics.count_stream(arriving, HEADERS, f"{base}/counts", f"{base}/state").awaitTermination()
    found = statistics.stats_so_far(spark, f"{base}/counts", HEADERS).columns
    return found.select("column_key", "null_count", "distinct_count", "inferred_type", "majority_shape", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


#: A table in which nothing is wrong.
CLEAN = "SELECT concat('r-', CAST(p_partkey AS STRING)) AS row_id, CAST(p_partkey AS BIGINT) AS row_index, md5(CAST(p_partkey AS STRING)) AS code, CAST(p_partkey % 40 + 100 AS STRING) AS stock, concat('2024-0', CAST(p_partkey % 9 + 1 AS STRING), '-1', CAST(p_partkey % 10 AS STRING)) AS seen FROM part"


@query(f"WITH t AS ({CLEAN}) SELECT 'all rows' AS what, count(*) AS n FROM t UNION ALL SELECT 'findings', count(*) FROM t WHERE trim(code) IN {MISSING} OR NOT regexp_matches(stock, '^1[0-3][0-9]$') OR NOT regexp_matches(seen, '^2024-0[1-9]-1[0-9]$') OR code IN (SELECT code FROM t GROUP BY code HAVING count(*) > 1)")
def profile_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without issues gives no row-level finding."""
    _tables(spark, sf_dir, "part")
    rows, names = spark.sql(CLEAN), ["code", "stock", "seen"]
    found = detect_rows.detect_row_level(rows, names, stats.column_stats(rows, names)).unionByName(detect_dups.exact_duplicates(rows, names))
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return count(rows, "all rows").unionByName(count(found, "findings"))
