"""Cleaned data and audit log, published together.

All outputs go into a new version folder; the marker file that readers look for
is written last, so a failed export is never seen.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.apply import clean_rows
from ..sources.csv import write_csv


def slug(filename: str) -> str:
    """A file name of letters, digits and dashes."""
    return re.sub(r"[^a-z0-9]+", "-", filename.rsplit(".", 1)[0].lower()).strip("-") or "dataset"


def audit_document(audited: DataFrame, dataset_id: str, usage: DataFrame | None = None) -> DataFrame:
    """One JSON line per decision, in order; usage lines follow with kind "usage"."""
    lines = audited.select(F.lit("decision").alias("kind"), F.lit(dataset_id).alias("dataset_id"), F.col("decision_seq").alias("seq"), F.to_json(F.struct(*audited.columns)).alias("body"))
    if usage is not None:
        lines = lines.unionByName(usage.select(F.lit("usage").alias("kind"), F.lit(dataset_id).alias("dataset_id"), F.lit(None).cast("int").alias("seq"), F.to_json(F.struct(*usage.columns)).alias("body")))
    return lines.orderBy("kind", "seq")


def publish(spark: SparkSession, folder: str, filename: str, rows: DataFrame, headers: list[str], audited: DataFrame, dataset_id: str) -> str:
    """Write a version and its marker; returns the version's path."""
    path = f"{folder.rstrip('/')}/{slug(filename)}-{uuid.uuid4().hex}"
    write_csv(clean_rows(rows, headers), f"{path}/cleaned.csv", headers)
    audit_document(audited, dataset_id).write.json(f"{path}/audit.json")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_PUBLISHED")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at).close()
    return path
