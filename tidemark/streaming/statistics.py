"""Column statistics over a stream: as of every batch, those of a run over all rows so far.

What is kept is the value counts of each batch. They add up, so statistics follow from
them without reading old rows; after every COMPACT batches those so far are merged
into one table. A batch that runs again overwrites its own counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..operators.stats import Stats, cells, merged, stats_of, value_counts

COMPACT = 16
COUNTS = "column_key string, value string, n long, first long"


def _read(spark: SparkSession, folder: str) -> DataFrame:
    """Counts under folder with the number of their batch; empty where nothing is written yet."""
    try:
        return spark.read.schema(f"{COUNTS}, batch long").parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], f"{COUNTS}, batch long")


def counts_so_far(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """Value counts of all batches (up to one): the latest merged table, and the batches since."""
    within = F.lit(True) if upto is None else F.col("batch") <= upto
    base = _read(spark, f"{folder}/merged").filter(within)
    last = base.agg(F.max("batch")).first()[0]
    last = -1 if last is None else last
    since = _read(spark, f"{folder}/batches").filter(within & (F.col("batch") > last))
    return merged(base.filter(F.col("batch") == last).unionByName(since))


def count_stream(rows: DataFrame, headers: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Value counts of every micro-batch under folder, merged now and then."""
    spark = rows.sparkSession

    def count(batch: DataFrame, number: int) -> None:
        value_counts(cells(batch, headers)).write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")
        if number % COMPACT == COMPACT - 1:
            counts_so_far(spark, folder, number).write.mode("overwrite").parquet(f"{folder}/merged/batch={number}")

    return rows.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stats_so_far(spark: SparkSession, folder: str, headers: list[str], config: Config = DEFAULT, upto: int | None = None) -> Stats:
    """Statistics of all rows that have arrived."""
    return stats_of(counts_so_far(spark, folder, upto), headers, config)
