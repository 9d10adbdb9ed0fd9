"""Counts, completeness, trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ISSUE_TYPES


def issue_counts(findings: DataFrame) -> DataFrame:
    """type and issues for every issue type, 0 where there are none."""
    # made by Spark itself: rows from the driver's Python would start Python workers
    kinds = findings.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ISSUE_TYPES))).alias("type"))
    counts = findings.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(F.broadcast(counts), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("issues"))


def health_ranking(findings: DataFrame) -> DataFrame:
    """Issue types that occur, most frequent first."""
    return issue_counts(findings).filter("issues > 0").orderBy(F.col("issues").desc(), "type")


def completeness(columns: DataFrame, row_count: int) -> DataFrame:
    """Share of cells with a value, 4 decimals; 1 without cells."""
    found = columns.agg(F.count(F.lit(1)).alias("columns"), F.coalesce(F.sum("null_count"), F.lit(0)).alias("missing"))
    total = F.lit(row_count) * F.greatest("columns", F.lit(1))
    return found.select(F.when(total == 0, 1.0).otherwise(F.round((total - F.col("missing")) / total, 4)).alias("completeness"))


def rule_share(suggested: DataFrame, empty: float = 1.0) -> DataFrame:
    """Share of suggestions made by rules; `empty` without suggestions."""
    return suggested.agg(F.coalesce(F.avg(F.when(F.col("source") == "rule", 1.0).otherwise(0.0)), F.lit(empty)).alias("rule_share"))


def trace(findings: DataFrame, suggested: DataFrame, audited: DataFrame, rows: DataFrame) -> DataFrame:
    """Issue, suggestion and decision side by side, with row numbers from 1.

    Of several suggestions of an issue, or decisions of a suggestion, the last counts.
    """
    last_s = suggested.groupBy("issue_id").agg(F.max_by(F.struct(*[c for c in suggested.columns if c != "issue_id"]), "suggestion_id").alias("s")).select("issue_id", "s")
    last_a = audited.groupBy("suggestion_id").agg(F.max_by(F.struct("review_status", "before_state", "after_state"), "decision_seq").alias("a")).select(F.col("suggestion_id").alias("_sid"), "a")
    told = ["issue_id", "type", "severity", "column_key", "evidence", "detected_by", "ambiguous"]
    # a finding of one row, as most are, takes its number where it meets the row; only the others are put together again
    ids = rows.select(F.col("row_id").alias("_rid"), "row_index").groupBy("_rid").agg(F.sort_array(F.collect_list(F.col("row_index") + 1)).alias("_n"))
    alone = findings.filter(F.size("row_ids") == 1).select(*told, F.col("row_ids")[0].alias("_rid")).join(ids, "_rid", "left").select(*told, F.col("_n").alias("row_numbers"))
    several = findings.filter(~F.coalesce(F.size("row_ids") == 1, F.lit(False)))
    placed = several.select("issue_id", F.posexplode("row_ids").alias("p", "_rid")).join(ids, "_rid").groupBy("issue_id").agg(F.array_sort(F.collect_list(F.struct("p", "_n"))).alias("r"))
    gathered = several.select(*told).join(placed.select("issue_id", F.flatten("r._n").alias("row_numbers")), "issue_id", "left")
    out = alone.unionByName(gathered).join(last_s, "issue_id", "left")
    out = out.join(last_a, F.col("s.suggestion_id") == F.col("_sid"), "left")
    none = F.array().cast("array<bigint>")
    return out.select("issue_id", "type", "severity", "column_key", "evidence", "detected_by", "ambiguous", F.coalesce("row_numbers", none).alias("row_numbers"), F.col("s.suggestion_id").alias("suggestion_id"), "s.action", "s.source", "s.confidence", "s.proposed_value", "a.review_status", "a.before_state", "a.after_state").orderBy("type", F.coalesce("column_key", F.lit("")), F.coalesce(F.get("row_numbers", F.lit(0)), F.lit(0)))


def trace_stats(traced: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """findings, suggested, by_rule, decided and the tokens spent."""
    made = F.col("suggestion_id").isNotNull()
    out = traced.agg(F.count(F.lit(1)).alias("findings"), F.count_if(made).alias("suggested"), F.count_if(made & (F.col("source") == "rule")).alias("by_rule"), F.count_if(F.col("review_status").isNotNull()).alias("decided"))
    if usage is None:
        return out.withColumn("tokens", F.lit(0).cast("long"))
    spent = usage.agg(F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("tokens"))
    return out.withColumn("_k", F.lit(1)).join(F.broadcast(spent.withColumn("_k", F.lit(1))), "_k").drop("_k")


def record_usage(calls: DataFrame) -> DataFrame:
    """provider, model and tokens of calls that spent any; calls: those of a review."""
    return calls.filter("input_tokens > 0 OR output_tokens > 0").select("provider", "model", "input_tokens", "output_tokens", "cached_tokens")


def usage_summary(calls: DataFrame) -> DataFrame:
    """By provider and model: calls, failed ones, tries, candidates and tokens."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("failed").isNotNull()).alias("failed_calls"), total("tries"), total("asked"), total("input_tokens"), total("output_tokens"), total("cached_tokens"))
