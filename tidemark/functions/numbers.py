"""Numbers as people write them: currency codes, signs, both decimal marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _SPACE, bind, trim

# Currency codes that may lead a number.
CURRENCY_CODES = ("USD", "EUR", "GBP", "CAD", "AUD", "NZD", "CHF", "JPY", "CNY", "INR", "MXN", "BRL", "ARS", "CLP", "COP", "PEN", "UYU", "SEK", "NOK", "DKK", "PLN", "CZK", "ZAR", "KRW", "SGD", "HKD")


_CODE = f"(?:{'|'.join(CURRENCY_CODES)})"
_BEFORE = f"(?i)^{_CODE}|[$€£¥{_SPACE}]"
# the same for an untrimmed text; no part matches the empty text, or the next sign would be skipped
_UNTRIMMED = f"(?i)^[{_SPACE}]+{_CODE}?|^{_CODE}|[$€£¥{_SPACE}]"


def strip_currency(v: Column) -> Column:
    """Without a leading currency code, currency signs and white space."""
    return F.regexp_replace(v, _BEFORE, "")


def read_number(v: Column) -> Column:
    """struct(value, plain): the double that a text stands for and how it is plainly written; null for other texts.

    The last of comma and dot is the decimal mark, the other groups digits. A
    comma mark turns only the first comma into a point, so a number with several
    grouping commas and no dot doesn't parse.
    """

    def plain(bare: Column) -> Column:
        by_comma = F.regexp_replace(F.translate(bare, ".", ""), "^([^,]*),", "$1.")
        return F.when(bare.rlike("^[+-]?[0-9.,]+$"), F.when(bare.rlike(",[^.]*$"), by_comma).otherwise(F.translate(bare, ",", "")))

    def read(text: Column) -> Column:
        value = text.try_cast("double")
        return F.when(F.abs(value) < float("inf"), F.struct(value.alias("value"), text.alias("plain")))

    return bind(bind(F.regexp_replace(v, _UNTRIMMED, ""), plain), read)


def with_number(df: DataFrame, text: str, out: str, where: Column | None = None) -> DataFrame:
    """df with read_number of a column, step by step in columns of their own, so that generated code computes each once."""
    plain, value = f"{out}_plain", f"{out}_value"
    df = with_value(df, F.col(text) if where is None else F.when(where, F.col(text)), plain, value)
    made = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("value"), F.col(plain).alias("plain")))
    return df.withColumn(out, made).drop(plain, value)


def with_value(df: DataFrame, v: Column, plain: str, value: str) -> DataFrame:
    """df with the plain text of a number and its value, which is null for texts that are none."""
    bare = f"{plain}_bare"
    df = df.withColumn(bare, F.regexp_replace(v, _UNTRIMMED, ""))
    by_comma = F.regexp_replace(F.translate(F.col(bare), ".", ""), "^([^,]*),", "$1.")
    df = df.withColumn(plain, F.when(F.col(bare).rlike("^[+-]?[0-9.,]+$"), F.when(F.col(bare).rlike(",[^.]*$"), by_comma).otherwise(F.translate(F.col(bare), ",", ""))))
    df = df.withColumn(value, F.col(plain).try_cast("double"))
    return df.withColumn(value, F.when(F.abs(F.col(value)) < float("inf"), F.col(value))).drop(bare)


def parse_number(v: Column) -> Column:
    """The double that a text stands for, or null."""
    return read_number(v)["value"]


def looks_like_number(v: Column) -> Column:
    return read_number(v).isNotNull()


def trimmed_canonical(t: Column) -> Column:
    return t.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")


def is_canonical_number(v: Column) -> Column:
    return trimmed_canonical(trim(v))


def canonical_number(v: Column) -> Column:
    """The number as plain text with its written precision, or null."""
    return read_number(v)["plain"]
