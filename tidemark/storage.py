"""Tables written once to the shared folder: plans stay short, and lost executors cost nothing that is written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in spark.checkpoint.dir.

    A temporary folder of the driver takes its place in local mode only; on a
    cluster executors could not see it, so a missing setting is an error there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def keep(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that `keep` made."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark/" in name:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *order, name: str) -> DataFrame:
    """df with contiguous numbers from 0 in the given order.

    Rows are range-sorted and written with their partition and place, so the
    numbers hold however the table is read; counts, one a partition, are summed apart.
    """
    laid = keep(df.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id()), "ordered")
    # high bits of the id are the partition, low 33 bits the position in it
    sizes = laid.groupBy(F.shiftright("_mono", 33).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    # one row a partition
    offsets = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_start"))
    return laid.withColumn("_p", F.shiftright("_mono", 33)).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_start") + F.col("_mono").bitwiseAND((1 << 33) - 1)).drop("_p", "_start", "_mono")
