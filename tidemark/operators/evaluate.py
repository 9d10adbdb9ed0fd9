"""Scores of a reviewer's verdicts against known answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effect(action: Column) -> Column:
    """What an action does to the data; merges are never applied and stand apart."""
    return F.when(action.isin("set_value", "normalize_value"), "write").when(action == "delete_row", "delete").when(action == "merge_rows", "merge").when(action == "no_action", "keep")


def truth_for(candidates: DataFrame, specs: DataFrame) -> DataFrame:
    """candidates with the expected action and value.

    specs: seq, column_key, row_id, action, proposed_value. The last spec of a
    cell counts; a row whose deletion is specified answers for any of its cells.
    """
    cell = specs.groupBy(F.coalesce("column_key", F.lit("")).alias("_c"), "row_id").agg(F.max_by(F.struct("action", "proposed_value"), "seq").alias("cell"))
    gone = specs.filter("action = 'delete_row'").select("row_id").distinct().withColumn("gone", F.lit(True))
    both = candidates.withColumn("_c", F.coalesce("column_key", F.lit(""))).join(cell, ["_c", "row_id"], "left").join(gone, "row_id", "left")
    action = F.coalesce("cell.action", F.when(F.col("gone"), "delete_row"))
    return both.withColumns({"expected_action": action, "expected_value": F.col("cell.proposed_value")}).drop("_c", "cell", "gone")


def _scored(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    told = verdicts.select("model", "candidate_id", "action", "proposed_value", "confidence")
    models = told.select("model").distinct()
    # every model is asked about every candidate; the model list is small
    asked = candidates.filter("expected_action is not null").withColumn("_all", F.lit(1)).join(F.broadcast(models.withColumn("_all", F.lit(1))), "_all").drop("_all")
    out = asked.join(told, ["model", "candidate_id"], "left")
    right = F.coalesce(effect(F.col("action")) == effect(F.col("expected_action")), F.lit(False))
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return out.withColumns({"right": right, "value_right": F.col("expected_value").isNotNull() & (plain("proposed_value") == plain("expected_value"))})


def score(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per model: answered, action and effect matches, values, confidence when right and wrong."""
    s = _scored(candidates, verdicts)
    answered = F.col("action").isNotNull()
    return s.groupBy("model").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(answered).alias("answered"),
        F.count_if(F.col("action") == F.col("expected_action")).alias("action_correct"),
        F.count_if(F.col("right")).alias("effective_correct"),
        F.count_if(F.col("action") == "merge_rows").alias("noop_merges"),
        F.count_if(F.col("expected_value").isNotNull()).alias("value_expected"),
        F.count_if(F.col("value_right")).alias("value_correct"),
        F.coalesce(F.avg(F.when(F.col("right"), F.col("confidence"))), F.lit(0.0)).alias("confidence_right"),
        F.coalesce(F.avg(F.when(~F.col("right") & answered, F.col("confidence"))), F.lit(0.0)).alias("confidence_wrong"),
    )


def score_by_type(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    return _scored(candidates, verdicts).groupBy("model", "type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("right")).alias("correct"))


def misses(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    return _scored(candidates, verdicts).filter("not right").select("model", "candidate_id", "type", "column_key", "row_id", F.col("expected_action").alias("expected"), F.coalesce("action", F.lit("(no answer)")).alias("got"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
