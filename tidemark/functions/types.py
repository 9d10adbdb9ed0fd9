"""Semantic types of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import trimmed_date
from .numbers import looks_like_number, read_number
from .text import bind, trim, trimmed_boolean, trimmed_email, trimmed_phone

#: Which type wins where two are equally common.
PRIORITY = ("email", "date", "boolean", "number", "phone", "string")


def kind_of(t: Column, date: Column, number: Column) -> Column:
    """Kind of a trimmed text whose date and number (null where it is none) are known."""
    worded = trimmed_boolean(t) & ~t.rlike("^[0-9]+$")
    return F.when(trimmed_email(t), "email").when(date.isNotNull(), "date").when(worded, "boolean").when(number.isNotNull(), "number").when(trimmed_phone(t), "phone").otherwise("string")


def trimmed_kind(t: Column) -> Column:
    return kind_of(t, trimmed_date(t), read_number(t))


def classify_value(v: Column) -> Column:
    """The narrowest type that a non-missing value fits."""
    return bind(trim(v), trimmed_kind)


def matches_type(v: Column, kind: Column) -> Column:
    """Whether a value may stand in a column of a type; looser than classify_value."""

    def fits(t: Column) -> Column:
        return (
            F.when(kind == "email", trimmed_email(t))
            .when(kind == "phone", trimmed_phone(t))
            .when(kind == "number", looks_like_number(t))
            .when(kind == "date", trimmed_date(t).isNotNull())
            .when(kind == "boolean", trimmed_boolean(t))
            .otherwise(F.lit(True))
        )

    return bind(trim(v), fits)
