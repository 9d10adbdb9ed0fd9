"""Duplicate rows over a stream: every batch's rows against all that have arrived.

Two kinds of keys have state, kept by Spark: the digest of a row and its signature.
The state of a key is the first row that arrived with it and how many did, a
streaming aggregation, so copies are combined before they move and a key with very
many rows takes one row of state. The same query carries the batch's rows beside the
aggregated keys; both are written in one pass and joined there, so a batch costs what
it holds, however much came before. Similar rows need more: new signatures meet all
earlier ones, whose lists of rare grams are kept by batch.

First is who arrived in an earlier batch, then who has the lower row_index. Where
batches arrive in the order of row_index, the findings of all batches together are
those of a batch run. A batch that runs again overwrites its own files and sees
only those of earlier batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..functions.text import signature
from ..operators.detect_dups import best_partner, copies_found, partners_found, row_key
from ..operators.similar import Budget, gram_lists, gram_ranks, similar_pairs
from ..storage import discard
from ..workers import ship
from .state import on_disk

CLASSES = "id long, row_id string, sig string"
GRAMS = "id long, gram long, place long"


def _earlier(spark: SparkSession, folder: str, schema: str, number: int) -> DataFrame:
    """What batches before a number wrote to a folder."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(folder).filter(F.col("batch") < number).drop("batch")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _ranks(spark: SparkSession, folder: str, fresh: DataFrame, budget: Budget) -> np.ndarray:
    """Ranks of grams, fixed by the first signatures that arrive: any order of grams loses no pair, it only costs more or less."""
    try:
        known = spark.read.schema("gram long, rank long").parquet(f"{folder}/ranks").orderBy("gram").toArrow()
        if known.num_rows:
            return known["rank"].to_numpy()
    except AnalysisException:
        pass
    rank = gram_ranks(fresh, budget.q)
    # a few ten thousand numbers
    spark.createDataFrame(list(enumerate(rank.tolist())), "gram long, rank long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranks")
    return rank


def _with_keys(rows: DataFrame, headers: list[str]) -> DataFrame:
    """Rows with their keys (kind "row") and, by key, the first row and the number of rows (kinds "digest", "signature")."""
    keyed = rows.select("row_id", "row_index", row_key(headers).alias("digest"), signature([F.col(f"`{h}`") for h in headers]).alias("sig"))
    keys = F.array(F.struct(F.lit("digest").alias("kind"), F.col("digest").alias("key")), F.struct(F.lit("signature").alias("kind"), F.col("sig").alias("key")))
    # the time of a batch is one for all its rows and the same when it runs again
    seen = keyed.withColumns({"arrived": F.current_timestamp(), "k": F.explode(keys)})
    firsts = seen.groupBy("k.kind", "k.key").agg(F.min(F.struct("arrived", "row_index", "row_id")).alias("f"), F.count(F.lit(1)).alias("n"))
    own = keyed.withColumn("kind", F.lit("row"))
    return own.unionByName(firsts.select("kind", "key", F.col("f.row_index").alias("first_index"), F.col("f.row_id").alias("first_id"), "n"), allowMissingColumns=True)


def cross_row_stream(rows: DataFrame, headers: list[str], folder: str, checkpoint: str, config: Config = DEFAULT) -> StreamingQuery:
    """Findings of every micro-batch under folder/findings/batch=<id>.

    rows: row_id, row_index (unique, not null) and the headers; further columns are
    left out. Null cells count as empty; rows without any letter or digit are similar
    to none. An empty batch has no findings.
    """
    spark, budget = rows.sparkSession, Budget(config.fuzzy_threshold)

    def judge(batch: DataFrame, number: int) -> None:
        own = f"batch={number}"
        # state is read and written by this one pass
        batch.write.mode("overwrite").parquet(f"{folder}/seen/{own}")
        session = batch.sparkSession
        seen = session.read.schema(batch.schema).parquet(f"{folder}/seen/{own}")
        arrived = seen.filter("kind = 'row'").select("row_id", "row_index", "digest", "sig")
        first = lambda kind, key: seen.filter((F.col("kind") == kind) & (F.col("n") > 1)).select(F.col("key").alias(key), "first_index", "first_id")
        copies = arrived.join(first("digest", "digest"), "digest").filter("row_id <> first_id")
        copies_found(copies, config).write.mode("overwrite").parquet(f"{folder}/findings/{own}/kind=exact")

        lone = arrived.join(copies.select("row_id"), "row_id", "left_anti").filter(F.regexp_replace("sig", r"\|", "") != "")
        alike = lone.join(first("signature", "sig"), "sig").filter("row_id <> first_id").select("row_id", F.col("row_index").alias("b"), F.col("first_id").alias("other"), F.col("first_index").alias("a"), F.lit(1.0).alias("score"))
        # signatures whose first row is in this batch
        named = seen.filter("kind = 'signature'").select(F.col("key").alias("sig"), F.col("first_id").alias("row_id"))
        lone.join(named, ["sig", "row_id"]).select(F.col("row_index").alias("id"), "row_id", "sig").write.mode("overwrite").parquet(f"{folder}/classes/{own}")
        fresh = session.read.schema(CLASSES).parquet(f"{folder}/classes/{own}")
        if fresh.isEmpty():
            partners_found(alike).write.mode("overwrite").parquet(f"{folder}/findings/{own}/kind=fuzzy")
            return
        old, lists = _earlier(session, f"{folder}/classes", CLASSES, number), None
        if budget.q:
            ship(session)
            gram_lists(fresh, budget, _ranks(session, folder, fresh, budget)).write.mode("overwrite").parquet(f"{folder}/grams/{own}")
            lists = _earlier(session, f"{folder}/grams", GRAMS, number + 1)
        known = fresh.withColumn("fresh", F.lit(True)).unionByName(old.withColumn("fresh", F.lit(False)))
        pairs = similar_pairs(known.select("id", "sig", "fresh"), config.fuzzy_threshold, config.block_prefix, config.max_block, lists)
        # the later of a pair is the fresh one; of two fresh ones that with the greater row_index
        before = old.select(F.col("id").alias("b"), F.lit(True).alias("_old"))
        turned = pairs.join(before, "b", "left").select(F.when(F.col("_old"), F.col("a")).otherwise(F.col("b")).alias("b"), F.when(F.col("_old"), F.col("b")).otherwise(F.col("a")).alias("a"), "score")
        names = known.select("id", "row_id")
        best = best_partner(turned).join(names.withColumnRenamed("id", "b"), "b").join(names.withColumnsRenamed({"id": "a", "row_id": "other"}), "a")
        partners_found(best.unionByName(alike)).write.mode("overwrite").parquet(f"{folder}/findings/{own}/kind=fuzzy")
        discard(pairs)

    with on_disk(spark):
        return _with_keys(rows, headers).writeStream.outputMode("update").foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def found_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of all batches."""
    return spark.read.option("basePath", f"{folder}/findings").parquet(f"{folder}/findings").drop("batch", "kind")
