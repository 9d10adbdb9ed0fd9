"""Detectors that look at one row at a time, given column statistics.

All are a map over cells joined with the broadcast statistics (one row per
column): every cell gives an array of findings in one pass. Only casing drift
joins a table that grows, the spellings. All together run by type of column: the
code for one type is short enough for the JVM to compile it, that for all is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.dates import trimmed_iso, with_date
from ..functions.numbers import trimmed_canonical, with_number
from ..functions.text import apply_shape, digits_of, normalize_key, trim, trimmed_boolean, trimmed_email, trimmed_missing, trimmed_phone, trimmed_shape
from .stats import Stats, cells

FINDING = ["issue_id", "type", "severity", "column_key", "row_ids", "row_index", "detected_by", "evidence", "ambiguous", "action", "current_value", "proposed_value", "confidence", "rationale", "group_key"]


def said(kind: str, severity: str, evidence: Column, action: str | None = None, proposed: Column | None = None, confidence: Column | float | None = None, rationale: Column | str | None = None) -> Column:
    """One finding as a struct. Without an action it is ambiguous and carries no suggestion."""
    plain = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        evidence.alias("evidence"),
        F.lit(action is None).alias("ambiguous"),
        F.lit(action).cast("string").alias("action"),
        plain(proposed).cast("string").alias("proposed_value"),
        plain(confidence).cast("double").alias("confidence"),
        plain(rationale).cast("string").alias("rationale"),
    )


def _named(df: DataFrame) -> DataFrame:
    """Rows of the findings table from row_ids, row_index, column_key, value and the struct f.

    Ids are hashes of type, column and rows, so a rerun gives the same ids.
    """
    made = {
        "issue_id": F.sha2(F.concat(F.col("f.type"), F.lit("\x1f"), F.coalesce("column_key", F.lit("")), F.lit("\x1f"), F.array_join("row_ids", ",")), 256),
        "detected_by": F.lit("rule"),
        "current_value": F.col("value"),
        "group_key": F.coalesce(F.concat(F.col("f.type"), F.lit(":"), F.col("column_key")), F.col("f.type")),
    }
    inner = ("type", "severity", "evidence", "ambiguous", "action", "proposed_value", "confidence", "rationale")
    return df.select(*[made[c].alias(c) if c in made else F.col(f"f.{c}").alias(c) if c in inner else F.col(c) for c in FINDING])


def row_findings(df: DataFrame, told: Column) -> DataFrame:
    """Findings about whole rows: df has row_ids and row_index."""
    none = F.lit(None).cast("string")
    return _named(df.select("row_ids", "row_index", none.alias("column_key"), none.alias("value"), told.alias("f")))


def with_stats(rows: DataFrame, headers: list[str], stats: Stats, config: Config = DEFAULT, spelled: bool = True) -> DataFrame:
    """Cells with their column's statistics (one row a column, broadcast) and the usual spelling of text cells.

    Only cells of text columns meet the table of spellings; keys with a single spelling
    cannot drift in the rows that were counted and then stay out of it.
    """
    texts = {h for h, kind in _types(headers, stats).items() if kind in config.casing_types} if spelled else set()
    parts = []
    if plain := [h for h in headers if h not in texts]:
        parts.append(_unspelled(rows, plain))
    if worded := [h for h in headers if h in texts]:
        parts += _spelled(rows, worded, stats, config)
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(stats.columns), "column_key")


def _types(headers: list[str], stats: Stats) -> dict[str, str]:
    """The inferred type of every header that has statistics: one name a column."""
    known = {r.column_key: r.inferred_type for r in stats.columns.select("column_key", "inferred_type").collect()}
    return {h: known[h] for h in headers if h in known}


def _unspelled(rows: DataFrame, headers: list[str]) -> DataFrame:
    return cells(rows, headers).withColumn("spelling", F.lit(None).cast("string"))


def _spelled(rows: DataFrame, headers: list[str], stats: Stats, config: Config) -> list[DataFrame]:
    """Cells of text columns with their usual spelling, as tables to be put together."""
    usual = stats.spellings.filter(F.col("column_key").isin(*headers))
    keyed = cells(rows, headers).withColumn("key", normalize_key(F.col("value")))
    return [p.select("row_id", "row_index", "column_key", "value", "spelling") for p in with_spelling(keyed, usual.filter("spellings > 1") if stats.complete else usual, config)]


#: Words of the filter of drifting keys, which goes to every task.
FILTER_WORDS = 1 << 20


def with_spelling(keyed: DataFrame, usual: DataFrame, config: Config = DEFAULT) -> list[DataFrame]:
    """Cells with the usual spelling of their key, or null, as tables to be put together.

    keyed: row_id, column_key, key; usual: as Stats.spellings. Few spellings go to every
    task and no cell moves. Otherwise a Bloom filter of their keys goes there: cells that
    it rules out stay where they are, and only the others move to the spellings. Keys
    that hold more than a task's share of all cells are dealt over several tasks. The
    filter has a 64-bit word for four keys and four bits in it a key, up to FILTER_WORDS;
    more keys only let more cells move.
    """
    on = ["column_key", "key"]
    size = usual.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("column_key") + F.octet_length("key") + F.octet_length("spelling") + 64), F.lit(0)).alias("bytes"), F.sum("cells").alias("cells")).first()
    known = usual.select(*on, "spelling")
    if size.bytes <= config.spelling_bytes:
        return [keyed.join(F.broadcast(known), on, "left")]
    words = min(FILTER_WORDS, 1 << max(0, (size.n - 1) // 4).bit_length())
    word = F.pmod(F.xxhash64(*on), F.lit(words)).alias("word")
    mask = F.expr("shiftleft(1L, cast(h & 63 AS int)) | shiftleft(1L, cast(shiftright(h, 6) & 63 AS int)) | shiftleft(1L, cast(shiftright(h, 12) & 63 AS int)) | shiftleft(1L, cast(shiftright(h, 18) & 63 AS int))")
    marked = lambda df: df.withColumns({"word": word, "h": F.xxhash64("key", "column_key")}).withColumn("mask", mask).drop("h")
    sieve = marked(known).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    met = marked(keyed).join(F.broadcast(sieve), "word", "left")
    may = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    out = met.filter(~may).withColumn("spelling", F.lit(None).cast("string"))
    # fewer hot keys than tasks, and fewer than twice as many parts of them
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = usual.filter(F.col("cells") * tasks > size.cells).select(*on, F.ceil(F.col("cells") * tasks / size.cells).alias("deals"))
    dealt = lambda df: df.join(F.broadcast(hot), on, "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    spread = dealt(known).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).drop("deals")
    moved = dealt(met.filter(may)).withColumn("deal", F.pmod(F.xxhash64("row_id"), F.col("deals")))
    return [out, moved.join(spread, [*on, "deal"], "left")]


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _missing(config: Config) -> list[Column]:
    v, t = F.col("value"), F.col("t")
    token = said("missing_value", "medium", F.concat(_quoted(v), F.lit(" stands for a missing value.")), "set_value", None, config.confidence_missing, "A placeholder is no value; the cell is emptied.")
    empty = said("missing_value", "high", F.concat(F.lit("Empty "), F.col("column_key"), F.lit(".")))
    return [F.when(F.col("missing") & (t != ""), token), F.when(F.col("missing") & (t == ""), empty)]


def _formats(config: Config) -> list[Column]:
    v, t, kind, shape = F.col("value"), F.col("t"), F.col("inferred_type"), F.col("majority_shape")
    present = ~F.col("missing")
    p = F.col("poured")
    phone = F.when(p.isNotNull(), said("inconsistent_format", "low", F.concat(F.lit("Most values have the shape "), shape, F.lit(".")), "normalize_value", p, config.confidence_phone, "Same digits in the column's usual shape."))
    d = F.col("date")
    sure = F.when(d["ambiguous"], config.confidence_date_ambiguous).otherwise(config.confidence_date)
    why = F.when(d["ambiguous"], "Day and month could be the other way round; read day first.").otherwise("Only one reading is a date.")
    date = F.when(d.isNotNull() & ~trimmed_iso(t), said("inconsistent_format", "medium", F.lit("Not an ISO date."), "normalize_value", d["iso"], sure, why))
    usual = F.col("spelling")
    text = F.when(kind.isin(*config.casing_types) & present & (v != usual), said("inconsistent_format", "low", F.concat(_quoted(usual), F.lit(" is the usual spelling.")), "normalize_value", usual, config.confidence_text, "The dominant spelling of the same value."))
    return [phone, date, text]


def _mismatches(config: Config) -> list[Column]:
    v, t, kind, number = F.col("value"), F.col("t"), F.col("inferred_type"), F.col("number")
    present = ~F.col("missing")
    rewritten = said("type_mismatch", "medium", F.concat(_quoted(v), F.lit(" is a number in another notation.")), "normalize_value", number["plain"], config.confidence_number, "The same number, plainly written.")
    wrong = said("type_mismatch", "high", F.concat(_quoted(v), F.lit(" is not a "), kind, F.lit(".")))
    fits = F.when(kind == "number", number.isNotNull()).when(kind == "email", trimmed_email(t)).when(kind == "phone", F.col("called")).when(kind == "date", F.col("date").isNotNull()).when(kind == "boolean", trimmed_boolean(t)).otherwise(True)
    return [F.when((kind == "number") & present & number.isNotNull() & ~trimmed_canonical(t), rewritten), F.when(present & ~fits, wrong)]


def _outliers(config: Config) -> list[Column]:
    x = F.col("number")["value"]
    told = said("outlier", "high", F.concat(F.col("value"), F.lit(" lies beyond the interquartile fences.")), "no_action", None, config.confidence_outlier, "Extreme but possible; reported only.")
    return [F.when((x < F.col("low")) | (x > F.col("high")), told)]


def _suspicious(config: Config) -> list[Column]:
    t, kind = F.col("t"), F.col("inferred_type")
    email = (kind == "email") & ~trimmed_email(t)
    name = (kind == "string") & F.lower(t).isin(*config.placeholder_names)
    phone = (kind == "phone") & F.col("called") & F.col("digits").rlike(rf"^([0-9])\1{{{config.filler_digits - 1},}}$")
    why = F.when(F.col("missing"), None).when(email, "Not a valid address.").when(name, "A placeholder name.").when(phone, "All digits are the same.")
    # evidence is null where nothing is suspicious
    return [F.when(F.coalesce(email | name | phone, F.lit(False)) & ~F.col("missing"), said("suspicious_value", "high", why))]


def _emit(long: DataFrame, found: list[Column], only: str | None = None) -> DataFrame:
    """Findings of one pass over the cells: each yields an array with a place for every kind, most often all null.

    only: the type of all columns in long, if it is one; then what other types need stays null.
    """
    seen = long.withColumn("t", trim(F.col("value"))).withColumn("missing", trimmed_missing(F.col("t")))
    of_kind = lambda k: (F.col("inferred_type") == k) & ~F.col("missing")
    none = {"number": "struct<value: double, plain: string>", "date": "struct<iso: string, ambiguous: boolean>", "digits": "string", "called": "boolean", "poured": "string"}
    if only in (None, "number"):
        seen = with_number(seen, "t", "number", of_kind("number"))
    if only in (None, "date"):
        seen = with_date(seen, "t", "date", of_kind("date"))
    if only in (None, "phone"):
        shape = F.col("majority_shape")
        seen = seen.withColumns({"digits": F.when(of_kind("phone"), digits_of(F.col("t"))), "called": of_kind("phone") & trimmed_phone(F.col("t"))})
        seen = seen.withColumn("poured", F.when(of_kind("phone") & (trimmed_shape(F.col("t")) != shape), apply_shape(shape, F.col("digits"))))
    seen = seen.withColumns({c: F.lit(None).cast(kind) for c, kind in none.items() if c not in seen.columns})
    # explode would infer a filter on the array, which is pushed below all columns it is made of and computes each many times over
    told = seen.select(F.array("row_id").alias("row_ids"), "row_index", "column_key", "value", F.explode_outer(F.array(*found)).alias("f"))
    return _named(told.filter(F.col("f").isNotNull()))


def missing_values(long: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Tokens that stand for nothing are emptied; empty cells go to review."""
    return _emit(long, _missing(config))


def inconsistent_formats(long: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Phones off the column's shape, dates not in ISO, texts off their dominant spelling."""
    return _emit(long, _formats(config))


def type_mismatches(long: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Numbers not plainly written are rewritten; values that don't fit their column go to review."""
    return _emit(long, _mismatches(config))


def outliers(long: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Numbers beyond the column's fences: reported, never changed."""
    return _emit(long, _outliers(config))


def suspicious_values(long: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Malformed addresses, placeholder names and filler phones go to review."""
    return _emit(long, _suspicious(config))


def detect_row_level(rows: DataFrame, headers: list[str], stats: Stats, config: Config = DEFAULT) -> DataFrame:
    """All findings about single cells, one pass over the columns of each type."""
    types, found = _types(headers, stats), []
    for kind in dict.fromkeys(types.values()):
        own = [h for h in headers if types.get(h) == kind]
        for part in _spelled(rows, own, stats, config) if kind in config.casing_types else [_unspelled(rows, own)]:
            # the type as a constant: Spark leaves out what other types need
            long = part.join(F.broadcast(stats.columns.drop("inferred_type")), "column_key").withColumn("inferred_type", F.lit(kind))
            found.append(_emit(long, _of_kind(kind, config), kind))
    return reduce(DataFrame.unionByName, found)


def _of_kind(kind: str, config: Config) -> list[Column]:
    """What may be found in a cell of a column of this type. Findings that rule each other out share a place."""
    (phone, date, text), (rewritten, wrong), missing = _formats(config), _mismatches(config), _missing(config)
    drift = [text] if kind in config.casing_types else []
    # a missing value is nothing else
    first, others = {
        "number": ([rewritten, wrong], _outliers(config)),
        "email": ([wrong], _suspicious(config)),
        "phone": ([wrong], [phone, *_suspicious(config)]),
        "date": ([wrong, date], []),
        "boolean": ([wrong], []),
        "string": ([], _suspicious(config)),
    }.get(kind, ([], []))
    return [F.coalesce(*missing, *first), *others, *drift]
