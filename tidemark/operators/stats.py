"""Column statistics from distinct values.

Cells are first counted per column and value, with partial aggregation before
the only large shuffle. Types and numbers are computed once per distinct
value and written; every statistic is a narrow aggregation of that table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.dates import with_dated
from ..functions.numbers import with_value
from ..functions.text import is_missing, normalize_key, shape_of, trim, trimmed_missing
from ..functions.types import PRIORITY, kind_of
from ..storage import discard, keep

CELLS = ["row_id", "row_index", "column_key", "value"]


def cells(rows: DataFrame, headers: list[str]) -> DataFrame:
    """Long form: one row per cell; null cells become "". """
    clean = rows.select("row_id", "row_index", *[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in headers])
    return clean.unpivot(["row_id", "row_index"], [F.col(f"`{h}`") for h in headers], "column_key", "value")


@dataclass
class Stats:
    """Written tables. columns: one row per column; spellings: the dominant spelling of
    each key of a text column (Config.casing_types), how many there are and in how many
    cells. complete: taken over all rows, so a key with one spelling cannot drift.
    """

    columns: DataFrame
    spellings: DataFrame
    complete: bool = True


def value_counts(long: DataFrame) -> DataFrame:
    """column_key, value, n and the first row a value is seen in."""
    return long.groupBy("column_key", "value").agg(F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first"))


def _modal(counts: DataFrame, of: str, tie: str) -> DataFrame:
    """The most common `of` per column, its count and the total."""
    best = F.max_by(F.struct(F.col(of).alias("v"), F.col("n").alias("n")), F.struct("n", tie))
    return counts.groupBy("column_key").agg(best.alias("best"), F.sum("n").alias("total")).select("column_key", F.col("best.v").alias(of), F.col("best.n").alias("most"), "total")


def quantiles(numbers: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """column_key, share and quantile: exact, with linear interpolation between neighbours.

    numbers: column_key, number and n, how often it occurs; equal numbers in several
    rows (other spellings) count as one. Numbers are dealt into ranges over all
    columns, so a column's numbers never meet in one task; counts of ranges tell
    which ranges hold the wanted ranks, and only those are sorted.
    """
    spark = numbers.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # -0.0 and 0.0 are one number
    one = numbers.groupBy("column_key", (F.col("number") + 0.0).alias("number")).agg(F.sum("n").alias("n"))
    laid = keep(one.repartitionByRange(parts, "column_key", "number").withColumn("part", F.spark_partition_id()), "numbers")
    sums = laid.groupBy("column_key", "part").agg(F.sum("n").alias("n"))
    column = Window.partitionBy("column_key")
    # one row per column and range
    sums = sums.withColumns({"before": F.sum("n").over(column.orderBy("part")) - F.col("n"), "total": F.sum("n").over(column)})
    wanted = sums.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("place", (F.col("total") - 1) * F.col("share"))
    wanted = wanted.withColumn("rank", F.explode(F.array(F.floor("place"), F.ceil("place")))).filter("rank >= before and rank < before + n")
    wanted = wanted.groupBy("column_key", "part", "before").agg(F.collect_set(F.struct("share", "rank", "place")).alias("wanted"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("column_key", "part").orderBy("number"))
    near = laid.join(F.broadcast(wanted), ["column_key", "part"]).withColumn("upto", upto)
    hit = near.select("column_key", "number", F.explode(F.expr("filter(wanted, w -> w.rank < upto and w.rank >= upto - n)")).alias("w"))
    # one or two neighbours for each share
    ends = hit.groupBy("column_key", "w.share", "w.place").agg(F.min_by("number", "w.rank").alias("lo"), F.max_by("number", "w.rank").alias("hi"))
    found = keep(ends.select("column_key", "share", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("place") - F.floor("place"))).alias("quantile")), "quantiles")
    discard(laid)
    return found


def column_stats(rows: DataFrame, headers: list[str], config: Config = DEFAULT) -> Stats:
    """Profile every column of wide rows.

    columns: column_key, position, null_count, distinct_count, inferred_type,
    sample_values, majority_shape (null without a dominant one), low and high
    fences (null where none can be set).
    """
    if config.stats_rows is not None:
        rows = rows.filter(F.col("row_index") < config.stats_rows)
    return stats_of(value_counts(cells(rows, headers)), headers, config)


def merged(counts: DataFrame) -> DataFrame:
    """Value counts of several tables of rows, added up."""
    return counts.groupBy("column_key", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def stats_of(counts: DataFrame, headers: list[str], config: Config = DEFAULT) -> Stats:
    """Statistics from value counts alone (column_key, value, n, first), one row a value."""
    counted = counts.withColumn("t", trim(F.col("value"))).withColumn("missing", trimmed_missing(F.col("t")))
    counted = with_value(counted, F.when(~F.col("missing"), F.col("t")), "plain", "number")
    counted = with_dated(counted, "t", "date", ~F.col("missing"))
    kind = F.when(~F.col("missing"), kind_of(F.col("t"), F.col("date"), F.col("number")))
    values = keep(counted.select("column_key", "value", "n", "first", "missing", kind.alias("kind"), "number"), "values")
    present = values.filter("not missing")
    base = values.groupBy("column_key").agg(
        F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if(~F.col("missing")).alias("distinct_count"),
        F.sum(F.when(F.col("number").isNotNull(), F.col("n"))).alias("numbers"),
    )
    rank = F.lit(len(PRIORITY))
    for i, name in enumerate(PRIORITY):
        rank = F.when(F.col("kind") == name, i).otherwise(rank)
    kinds = present.groupBy("column_key", "kind").agg(F.sum("n").alias("n")).withColumn("tie", -rank)
    kinds = _modal(kinds, "kind", "tie").withColumn("inferred_type", F.when(F.col("most") >= config.type_share * F.col("total"), F.col("kind")).otherwise("mixed")).select("column_key", "inferred_type")
    shapes = present.groupBy("column_key", shape_of(F.col("value")).alias("shape")).agg(F.sum("n").alias("n"), F.min("first").alias("first")).withColumn("tie", -F.col("first"))
    shapes = _modal(shapes, "shape", "tie").filter(F.col("most") >= config.shape_share * F.col("total")).select("column_key", F.col("shape").alias("majority_shape"))
    # Spark keeps the first rows of each group before the shuffle
    order = Window.partitionBy("column_key").orderBy("first", "value")
    seen = present.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= config.sample_size)
    samples = seen.groupBy("column_key").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("s")).select("column_key", F.col("s.value").alias("sample_values"))
    cuts = quantiles(present.filter("number is not null"), (0.25, 0.75)).groupBy("column_key").agg(F.min_by("quantile", "share").alias("q1"), F.max_by("quantile", "share").alias("q3"))
    spread = F.col("q3") - F.col("q1")
    cuts = cuts.filter(spread > 0).select("column_key", (F.col("q1") - config.fence_k * spread).alias("low"), (F.col("q3") + config.fence_k * spread).alias("high"))
    names = counts.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, headers))).alias("position", "column_key"))
    columns = F.broadcast(names).join(base, "column_key", "left")
    for part in (kinds, samples, shapes, cuts):
        columns = columns.join(part, "column_key", "left")
    none = F.array().cast("array<string>")
    fenced = (F.col("inferred_type") == "number") & (F.col("numbers") >= config.fence_min_values)
    columns = columns.select(
        "column_key", "position", F.coalesce("null_count", F.lit(0)).alias("null_count"), F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), F.coalesce("inferred_type", F.lit("string")).alias("inferred_type"),
        F.coalesce("sample_values", none).alias("sample_values"), "majority_shape", F.when(fenced, F.col("low")).alias("low"), F.when(fenced, F.col("high")).alias("high"),
    )
    columns = keep(columns.coalesce(1), "columns")
    worded = F.broadcast(columns.filter(F.col("inferred_type").isin(*config.casing_types)).select("column_key"))
    keyed = present.join(worded, "column_key", "left_semi").withColumn("key", normalize_key(F.col("value"))).filter("key <> ''")
    spellings = keyed.groupBy("column_key", "key").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("spelling"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("cells"))
    found = Stats(columns, keep(spellings, "spellings"), config.stats_rows is None)
    discard(values)
    return found


def count_nulls(rows: DataFrame, column: str) -> DataFrame:
    """null_count of one column."""
    return rows.agg(F.count_if(is_missing(F.col(f"`{column}`"))).alias("null_count"))
