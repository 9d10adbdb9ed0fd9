"""Detectors of duplicate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import signature
from ..storage import keep
from .detect_rows import row_findings, said
from .similar import similar_pairs


def row_key(headers: list[str]):
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(f"`{h}`"), F.lit("")) for h in headers])), 256)


def _later_copies(rows: DataFrame, headers: list[str]) -> DataFrame:
    """row_id and row_index of rows equal to an earlier one, with the first such row.

    Groups are counted with partial aggregation, and only keys that repeat are
    joined back, so a key with many rows is never gathered in one place.
    """
    keyed = rows.select("row_id", "row_index", row_key(headers).alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("row_index", "row_id")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(first.select("key", F.col("f.row_index").alias("first_index"), F.col("f.row_id").alias("first_id")), "key").filter("row_index > first_index")


def exact_duplicates(rows: DataFrame, headers: list[str], config: Config = DEFAULT) -> DataFrame:
    """Later rows equal in every column to an earlier one are to be deleted."""
    return copies_found(_later_copies(rows, headers), config)


def copies_found(copies: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Findings of copies: row_id, row_index, first_id and first_index."""
    hit = copies.withColumn("row_ids", F.array("row_id", "first_id"))
    return row_findings(hit, said("exact_duplicate", "high", F.concat(F.lit("Equal to row "), F.col("first_index") + 1, F.lit(" in every column.")), "delete_row", None, config.confidence_exact, "The first occurrence stays."))


def fuzzy_duplicates(rows: DataFrame, headers: list[str], config: Config = DEFAULT) -> DataFrame:
    """Each later row with its most similar earlier row that shares a column's prefix (ties: the earliest), for review.

    Rows that are exact copies of earlier ones take no part. Rows of equal signatures
    are one in the search: the first stands for all, and the others match it best.
    """
    copies = _later_copies(rows, headers).select("row_index")
    signed = rows.join(copies, "row_index", "left_anti").select("row_index", signature([F.col(f"`{h}`") for h in headers]).alias("sig"))
    signed = signed.filter(F.regexp_replace("sig", r"\|", "") != "")
    classes = keep(signed.groupBy("sig").agg(F.min("row_index").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    pairs = similar_pairs(classes.select("id", "sig"), config.fuzzy_threshold, config.block_prefix, config.max_block)
    best = best_partner(pairs)
    alike = signed.join(classes.filter("n > 1").select("sig", "id"), "sig").filter("row_index > id").select(F.col("row_index").alias("b"), F.col("id").alias("a"), F.lit(1.0).alias("score"))
    ids = rows.select("row_index", "row_id")
    named = best.unionByName(alike).join(ids.withColumnsRenamed({"row_index": "b", "row_id": "row_id"}), "b").join(ids.withColumnsRenamed({"row_index": "a", "row_id": "other"}), "a")
    return partners_found(named)


def best_partner(pairs: DataFrame) -> DataFrame:
    """b with its most similar a (ties: the least) and score."""
    best = pairs.groupBy("b").agg(F.max(F.struct("score", (-F.col("a")).alias("minus"))).alias("m"))
    return best.select("b", (-F.col("m.minus")).alias("a"), F.col("m.score").alias("score"))


def partners_found(named: DataFrame) -> DataFrame:
    """Findings of similar rows: b and row_id of the later, a and other of the earlier row, and score."""
    hit = named.select("row_id", F.col("b").alias("row_index"), F.array("row_id", "other").alias("row_ids"), "a", "score")
    return row_findings(hit, said("fuzzy_duplicate", "high", F.concat(F.round(F.col("score") * 100).cast("int"), F.lit("% identical to row "), F.col("a") + 1, F.lit(" once formatting is stripped."))))


def detect_cross_row(rows: DataFrame, headers: list[str], config: Config = DEFAULT) -> DataFrame:
    return exact_duplicates(rows, headers, config).unionByName(fuzzy_duplicates(rows, headers, config))
