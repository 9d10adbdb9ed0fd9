"""Missing values, keys, shapes, e-mail and phone tests, similarity."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value, and for a boolean.
MISSING_TOKENS = ("", "-", "--", "?", "n/a", "na", "nil", "none", "null", "unknown")
BOOLEAN_TOKENS = ("true", "false", "yes", "no", "y", "n", "0", "1")
# White space as ECMAScript trims it.
_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same, sign by sign.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: Letters of shapes: ASCII, and Latin from U+00C0 to U+024F.
LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)]))
# Fixed patterns.
EMAIL = rf"(?i)^[^@{_SPACE}]+@[^@{_SPACE}]+\.[a-z]{{2,}}$"
PHONE = rf"^\+?[0-9{_SPACE}().-]{{7,}}$"


def bind(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value) with value computed once; as a plain expression it would be repeated at every use."""
    return F.transform(F.array(value), make)[0]


def trim(v: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(v, F.lit(SPACES))


def trimmed_missing(t: Column) -> Column:
    return t.isNull() | F.lower(t).isin(*MISSING_TOKENS)


def is_missing(v: Column) -> Column:
    """Null, blank, or a token that stands for nothing."""
    return v.isNull() | F.lower(trim(v)).isin(*MISSING_TOKENS)


def is_empty(v: Column) -> Column:
    """Null or blank."""
    return v.isNull() | (trim(v) == "")


@lru_cache(maxsize=1)
def accent_pairs() -> tuple[str, str]:
    """Letters that decompose to an ASCII letter or digit, and that letter."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1CD, 0x234), *range(0x1E00, 0x1F00), 0x212A, 0x212B]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if base.isascii() and base.isalnum() and len(base) == 1:
            pairs[chr(code)] = base.lower()
    return "".join(pairs), "".join(pairs.values())


def normalize_key(v: Column) -> Column:
    """Letters and digits only, lower case, accents folded."""
    accented, plain = accent_pairs()
    return F.regexp_replace(F.lower(F.translate(v, accented, plain)), "[^a-z0-9]", "")


def shape_of(v: Column) -> Column:
    """The trimmed text with letters as A and digits as D."""
    return trimmed_shape(trim(v))


def trimmed_shape(t: Column) -> Column:
    """shape_of a trimmed text; signs are replaced in one pass, so no D is mistaken for a letter."""
    return F.translate(t, f"{LETTERS}0123456789", "A" * len(LETTERS) + "D" * 10)


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def apply_shape(shape: Column, digits: Column) -> Column:
    """Digits poured into the D places of a shape; null where their numbers differ."""
    marks = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))
    poured = F.aggregate(
        marks,
        start,
        lambda a, c: F.struct(
            F.concat(a["out"], F.when(c == "D", F.substring(digits, a["used"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (a["used"] + F.when(c == "D", 1).otherwise(0)).alias("used"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.length(F.regexp_replace(shape, "[^D]", "")) == F.length(digits), poured)


def trimmed_email(t: Column) -> Column:
    return t.rlike(EMAIL)


def looks_like_email(v: Column) -> Column:
    return trimmed_email(trim(v))


def trimmed_phone(t: Column) -> Column:
    return t.rlike(PHONE) & (F.length(digits_of(t)) >= 7)


def looks_like_phone(v: Column) -> Column:
    return bind(trim(v), trimmed_phone)


def trimmed_boolean(t: Column) -> Column:
    return F.lower(t).isin(*BOOLEAN_TOKENS)


def is_boolean_text(v: Column) -> Column:
    return trimmed_boolean(trim(v))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def similar(a: Column, b: Column, threshold: float) -> Column:
    """similarity(a, b) where it reaches the threshold, else null; far pairs stop early."""
    longer = F.greatest(F.length(a), F.length(b))
    budget = F.floor((1 - threshold) * longer + 1e-9).cast("int")
    near = (F.abs(F.length(a) - F.length(b)) <= budget) & (F.call_function("levenshtein", a, b, budget) >= 0)
    return F.when(near, similarity(a, b))


def signature(columns: list[Column]) -> Column:
    """Normalised keys of all values, joined by a bar."""
    return F.concat_ws("|", *[F.coalesce(normalize_key(c), F.lit("")) for c in columns])


def repair_email(v: Column) -> Column:
    """An address with a comma before its ending, or without one, mended; else null."""
    mended = F.regexp_replace(v, r"(?i),([a-z]{2,4})$", ".$1")
    parts = F.split(mended, "@")
    domain = F.get(parts, F.lit(1))
    bare = (F.coalesce(domain, F.lit("")) != "") & ~F.contains(domain, F.lit("."))
    return F.when(F.contains(v, F.lit("@")), F.when(mended.rlike(EMAIL), mended).when(bare, F.concat(F.get(parts, F.lit(0)), F.lit("@"), domain, F.lit(".com"))))
