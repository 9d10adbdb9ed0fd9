"""Dates in ISO and in day-first or month-first notation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind, trim

_ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
_PARTS = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})$"
_EITHER = r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4})$"


def is_valid_ymd(year: Column, month: Column, day: Column) -> Column:
    return year.between(1000, 9999) & _is_day(_is_leap(year), month, day)


def _is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def _is_day(leap: Column, month: Column, day: Column) -> Column:
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return month.between(1, 12) & (day >= 1) & (day <= last)


def _numbers(t: Column, pattern: str) -> Column:
    return F.array(*[F.regexp_extract(t, pattern, i).try_cast("int") for i in (1, 2, 3)])


def _made(year: Column, month: Column, day: Column, unsure: Column) -> Column:
    text = F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0"))
    return F.struct(text.alias("iso"), unsure.alias("ambiguous"))


def trimmed_date(t: Column) -> Column:
    """parse_date of a trimmed text."""

    # binding keeps the three numbers from being repeated dozens of times
    def iso(n: Column) -> Column:
        return F.when(is_valid_ymd(n[0], n[1], n[2]), F.struct(t.alias("iso"), F.lit(False).alias("ambiguous")))

    def parts(n: Column) -> Column:
        day_first, month_first = is_valid_ymd(n[2], n[1], n[0]), is_valid_ymd(n[2], n[0], n[1])
        return F.when(day_first, _made(n[2], n[1], n[0], month_first & (n[0] != n[1]))).when(month_first, _made(n[2], n[0], n[1], F.lit(False)))

    return F.when(t.rlike(_ISO), bind(_numbers(t, _ISO), iso)).when(t.rlike(_PARTS), bind(_numbers(t, _PARTS), parts))


def with_date(df: DataFrame, text: str, out: str, where: Column | None = None) -> DataFrame:
    """df with trimmed_date of a column of trimmed texts, step by step in columns of their own, so that generated code computes each once."""
    n, usual, month = (f"{out}_{x}" for x in ("numbers", "usual", "month"))
    df = _with_readings(df, F.col(text) if where is None else F.when(where, F.col(text)), n, usual, month)
    a, b, c = (F.col(n)[i] for i in range(3))
    made = F.when(F.col(usual) & (a > c), F.struct(F.col(text).alias("iso"), F.lit(False).alias("ambiguous")))
    made = made.when(F.col(usual), _made(c, b, a, F.col(month) & (a != b))).when(F.col(month), _made(c, a, b, F.lit(False)))
    return df.withColumn(out, made).drop(n, usual, month)


def with_dated(df: DataFrame, text: str, out: str, where: Column) -> DataFrame:
    """df with true where a column of trimmed texts holds a date, else null: with_date without the date."""
    n, usual, month = (f"{out}_{x}" for x in ("numbers", "usual", "month"))
    df = _with_readings(df, F.when(where, F.col(text)), n, usual, month)
    return df.withColumn(out, F.when(F.col(usual) | F.col(month), True)).drop(n, usual, month)


def _with_readings(df: DataFrame, t: Column, n: str, usual: str, month: str) -> DataFrame:
    """df with the three numbers of a date, whether they are one as ISO or day first, and whether month first."""
    found = f"{n}_found"
    df = df.withColumn(found, F.regexp_extract(t, _EITHER, 0))
    df = df.withColumn(n, F.when(F.col(found) != "", F.split(found, "[/.-]").try_cast("array<int>"))).drop(found)
    a, b, c = (F.col(n)[i] for i in range(3))
    # the year is at one end, first in ISO, and more than the other end; a lesser one is none
    year, leap, other = f"{n}_year", f"{n}_leap", f"{n}_other"
    df = df.withColumns({year: F.greatest(a, c), other: F.least(a, c)}).withColumn(leap, F.when(F.col(year).between(1000, 9999), _is_leap(F.col(year))))
    known = F.col(leap).isNotNull()
    return df.withColumns({usual: known & _is_day(F.col(leap), b, F.col(other)), month: known & (a < c) & _is_day(F.col(leap), F.col(other), b)}).drop(year, leap, other)


def parse_date(v: Column) -> Column:
    """struct(iso, ambiguous) or null.

    Parts before a year are day then month where that is a date, else month then
    day; ambiguous where both readings are dates and differ.
    """
    return bind(trim(v), trimmed_date)


def looks_like_date(v: Column) -> Column:
    return parse_date(v).isNotNull()


def trimmed_iso(t: Column) -> Column:
    return t.rlike(_ISO)


def is_iso_date(v: Column) -> Column:
    return trimmed_iso(trim(v))
