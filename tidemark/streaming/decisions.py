"""Decisions that arrive as a stream, applied to a stored table batch by batch.

The state of a suggestion is its first decision, a streaming aggregation kept by
Spark: first is who arrived in an earlier batch, then who has the lower decision_seq.
Later decisions on it are recorded as late and change nothing. Every batch publishes
exactly one version of the table, so the version tells which batches are in it: a
batch that runs again and finds its version published changes nothing, and one
that died before publishing starts from the same version as before.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.apply import audit, plan_changes
from ..sources.tables import open_table
from .state import on_disk

DECISION = ["suggestion_id", "status", "final_value", "decision_seq"]
PLANNED = "suggestion_id string, row_id string, column_key string, action string, source string, status string, final_value string, decision_seq long, change_kind string, before string, after string"


def _with_firsts(events: DataFrame) -> DataFrame:
    """Decisions as they arrive (first: null), and the first decision of each suggestion that has one in the batch."""
    own = events.select("suggestion_id", "status", "final_value", F.col("decision_seq").cast("long").alias("decision_seq"))
    seen = own.withColumn("arrived", F.current_timestamp())
    firsts = seen.groupBy("suggestion_id").agg(F.min(F.struct("arrived", "decision_seq", "status", "final_value")).alias("first"), F.count(F.lit(1)).alias("n"))
    return own.unionByName(firsts.select("suggestion_id", "first", "n"), allowMissingColumns=True)


def apply_stream(events: DataFrame, suggested: DataFrame, folder: str, schema: T.StructType, headers: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Decisions applied to the table in a folder as they arrive; its latest version, when the stream first starts, is what batch 0 edits.

    events: suggestion_id, status, final_value, decision_seq; of two decisions on one
    suggestion within a batch the lower decision_seq holds. Decisions on unknown
    suggestions, and accepted or edited ones whose row is gone, are left out, as in a
    batch run. An empty batch publishes the same files again. Only this stream may
    write the table. Under out, by batch: planned, audit and late.
    """
    spark = events.sparkSession
    base = _base(spark, folder, schema, out)

    def step(batch: DataFrame, number: int) -> None:
        session, own = batch.sparkSession, f"batch={number}"
        before = base + number
        # state is read and written by this one pass, also where the batch is in the table already
        batch.write.mode("overwrite").parquet(f"{out}/seen/{own}")
        if open_table(session, folder, schema).version > before:
            return
        seen = session.read.schema(batch.schema).parquet(f"{out}/seen/{own}")
        arrived, firsts = seen.filter("first IS NULL").select(*DECISION), seen.filter("first IS NOT NULL")
        # all that arrived is in this batch where the state counts no more than the batch does
        counted = arrived.groupBy("suggestion_id").agg(F.count(F.lit(1)).alias("here"))
        new = firsts.join(counted, "suggestion_id").filter("n = here").select("suggestion_id", "first.status", "first.final_value", "first.decision_seq")
        held = new.select("suggestion_id", F.col("decision_seq").alias("_held"))
        late = arrived.join(held, "suggestion_id", "left").filter(F.col("_held").isNull() | (F.col("decision_seq") > F.col("_held")))
        late.select(*DECISION).write.mode("overwrite").parquet(f"{out}/late/{own}")
        table = open_table(session, folder, schema, before)
        plan_changes(new, suggested, table.rows.filter("not deleted"), headers).write.mode("overwrite").parquet(f"{out}/planned/{own}")
        planned = session.read.schema(PLANNED).parquet(f"{out}/planned/{own}")
        audit(planned, table.rows, headers).write.mode("overwrite").parquet(f"{out}/audit/{own}")
        # last: what readers see
        table.edited(headers, planned, again=True)

    with on_disk(spark):
        return _with_firsts(events).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _base(spark: SparkSession, folder: str, schema: T.StructType, out: str) -> int:
    """The version that the stream began with, written when it first starts."""
    try:
        found = spark.read.schema("version int").parquet(f"{out}/base").first()
        if found:
            return found.version
    except AnalysisException:
        pass
    version = open_table(spark, folder, schema).version
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{out}/base")
    return version
