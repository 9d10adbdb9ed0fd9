"""Suggestions under review: decisions, groups, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ACTIONS, BULK_CONFIDENCE, DETECTED_BY, INFERRED_TYPES, ISSUE_TYPES, REVIEW_STATUSES, SEVERITIES
from ..storage import numbered

# How issue types are called.
LABELS = {
    "missing_value": "Missing values",
    "exact_duplicate": "Exact duplicates",
    "fuzzy_duplicate": "Possible duplicates",
    "inconsistent_format": "Inconsistent format",
    "type_mismatch": "Type mismatch",
    "outlier": "Outliers",
    "suspicious_value": "Suspicious values",
}


def suggestions(findings: DataFrame) -> DataFrame:
    """One suggestion per resolved finding."""
    made = findings.filter("not ambiguous")
    return made.select(F.col("issue_id").alias("suggestion_id"), "issue_id", "action", F.col("row_ids")[0].alias("row_id"), "column_key", "current_value", "proposed_value", "confidence", "rationale", F.lit("rule").alias("source"), "group_key")


#: Enumerations of the columns of findings and suggestions.
ENUMERATIONS = {"type": ISSUE_TYPES, "severity": SEVERITIES, "detected_by": DETECTED_BY, "source": DETECTED_BY, "action": ACTIONS, "status": REVIEW_STATUSES, "inferred_type": INFERRED_TYPES}


def misnamed(df: DataFrame) -> DataFrame:
    """Rows with a value outside its column's enumeration, and `misnamed`, the names of those columns. Null is allowed."""
    odd = [F.when(~F.col(c).isin(*names), F.lit(c)) for c, names in ENUMERATIONS.items() if c in df.columns]
    return df.withColumn("misnamed", F.array_compact(F.array(*odd))).filter(F.size("misnamed") > 0)


def group_key(kind: Column, column: Column) -> Column:
    return F.coalesce(F.concat(kind, F.lit(":"), F.nullif(column, F.lit(""))), kind)


def describe_group(kind: Column, column: Column) -> Column:
    label = kind
    for name, text in LABELS.items():
        label = F.when(kind == name, text).otherwise(label)
    return F.coalesce(F.concat(label, F.lit(' · column "'), column, F.lit('"')), label)


def is_editable(action: Column) -> Column:
    return action.isin("set_value", "normalize_value")


def is_bulk_acceptable(confidence: Column, action: Column) -> Column:
    return (confidence >= BULK_CONFIDENCE) & (action != "no_action")


def current_decisions(events: DataFrame) -> DataFrame:
    """Last decision per suggestion. events: suggestion_id, status, final_value, batch, seq."""
    last = events.groupBy("suggestion_id").agg(F.max_by(F.struct("status", "final_value"), "seq").alias("d"))
    return last.select("suggestion_id", "d.status", "d.final_value")


def undo(events: DataFrame) -> DataFrame:
    """events without their latest batch; earlier decisions hold again."""
    last = events.agg(F.max("batch").alias("_last"))
    return events.join(F.broadcast(last), events["batch"] == last["_last"], "left_anti")


def reset(events: DataFrame) -> DataFrame:
    return events.limit(0)


def with_status(suggested: DataFrame, decisions: DataFrame) -> DataFrame:
    """suggestions with status (pending by default) and the decision's final value."""
    return suggested.join(decisions, "suggestion_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def effective_value(status: Column, final_value: Column, proposed: Column) -> Column:
    """An edit's own value, else the proposal."""
    return F.when(status == "edited", final_value).otherwise(proposed)


def severity_rank(severity: Column) -> Column:
    out = F.lit(SEVERITIES.index("medium"))
    for i, name in enumerate(SEVERITIES):
        out = F.when(severity == name, i).otherwise(out)
    return out


def group_severity(findings: DataFrame) -> DataFrame:
    """The worst severity of each group's issues."""
    worst = findings.groupBy("group_key").agg(F.min(severity_rank(F.col("severity"))).alias("r"))
    return worst.select("group_key", F.get(F.array(*map(F.lit, SEVERITIES)), F.col("r")).alias("severity"))


def build_groups(reviewed: DataFrame, severities: DataFrame | None = None) -> DataFrame:
    """Groups of suggestions in review order.

    Pending groups first, then by severity, size and label. Counts stay counts:
    the ids that may be accepted in bulk are a query (`bulk_acceptable`), not a list.
    """
    pending = F.col("status") == "pending"
    bulk = is_bulk_acceptable(F.col("confidence"), F.col("action"))
    groups = reviewed.groupBy("group_key").agg(F.count(F.lit(1)).alias("size"), F.count_if(pending).alias("pending"), F.count_if(~pending).alias("resolved"), F.count_if(~F.coalesce(bulk, F.lit(False))).alias("low_confidence"), F.count_if(pending & bulk).alias("bulk_acceptable"))
    parts = F.split("group_key", ":", 2)
    groups = groups.withColumns({"type": parts[0], "column_key": F.nullif(F.get(parts, F.lit(1)), F.lit(""))})
    groups = groups.join(severities, "group_key", "left") if severities is not None else groups.withColumn("severity", F.lit(None).cast("string"))
    groups = groups.withColumns({"severity": F.coalesce("severity", F.lit("medium")), "label": describe_group(F.col("type"), F.col("column_key"))})
    return groups.orderBy((F.col("pending") > 0).desc(), severity_rank(F.col("severity")), F.col("size").desc(), "label")


def bulk_acceptable(reviewed: DataFrame) -> DataFrame:
    """Pending suggestions that may be accepted together."""
    return reviewed.filter((F.col("status") == "pending") & is_bulk_acceptable(F.col("confidence"), F.col("action")))


def totals(reviewed: DataFrame) -> DataFrame:
    """One row: total and the number of each status."""
    return reviewed.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "accepted", "rejected", "edited")])


def decision_list(reviewed: DataFrame, *also: str) -> DataFrame:
    """What apply is sent: decided suggestions, their final value null when rejected, and columns of reviewed named in also."""
    value = F.when(F.col("status") == "rejected", F.lit(None).cast("string")).otherwise(effective_value(F.col("status"), F.col("final_value"), F.col("proposed_value")))
    decided = reviewed.filter("status <> 'pending'").select("suggestion_id", "status", value.alias("final_value"), *also)
    return numbered(decided, "suggestion_id", name="_n").withColumn("decision_seq", (F.col("_n") + 1).cast("int")).drop("_n")
