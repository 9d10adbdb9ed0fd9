"""Datasets as metadata rows: registration, listing, health."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DATASET_STATUSES

SCHEMA = "dataset_id string, filename string, row_count long, headers array<string>, status string, progress double, created_at timestamp"


@dataclass
class Dataset:
    dataset_id: str
    filename: str
    row_count: int = 0
    headers: list[str] = field(default_factory=list)
    status: str = "uploaded"
    progress: float = 0.0
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def __post_init__(self) -> None:
        if self.status not in DATASET_STATUSES:
            raise ValueError(f"unknown status {self.status}")


def register(spark: SparkSession, datasets: list[Dataset]) -> DataFrame:
    return spark.createDataFrame([(d.dataset_id, d.filename, d.row_count, d.headers, d.status, d.progress, d.created_at) for d in datasets], SCHEMA)


def list_datasets(datasets: DataFrame, suggestions: DataFrame, limit: int = 25) -> DataFrame:
    """The newest datasets with all and pending suggestions counted (0 without any)."""
    newest = datasets.orderBy(F.col("created_at").desc(), "dataset_id").limit(limit)
    counts = suggestions.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("suggestion_count"), F.count_if(F.col("status") == "pending").alias("pending_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return newest.join(counts, "dataset_id", "left").select(*newest.columns, zero("suggestion_count"), zero("pending_count"))


def demo_contacts(spark: SparkSession, n: int = 40) -> DataFrame:
    """n made-up contacts with every kind of mess, by fixed rules on their number: a table to try the engine on."""
    k = F.col("id")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    digits = F.lpad(((k * 7919) % 10_000).cast("string"), 4, "0")
    day, month = F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lpad((k % 12 + 1).cast("string"), 2, "0")
    town = F.element_at(F.array(*map(F.lit, ("Lima", "Oslo", "Pune", "Turin"))), (k % 4 + 1).cast("int"))
    amount = (k * 37 % 900 + 100).cast("string")
    return spark.range(n).select(
        F.format_string("r-%02d", k + 1).alias("row_id"),
        k.alias("row_index"),
        F.when(k % 17 == 11, "Test User").when(k % 13 == 9, "n/a").otherwise(text("Person ", k.cast("string"))).alias("name"),
        F.when(k % 11 == 7, "").when(k % 9 == 5, text("p", k.cast("string"), "@mail,org")).otherwise(text("p", k.cast("string"), "@mail.org")).alias("email"),
        F.when(k % 7 == 3, text("555-01-", digits)).otherwise(text("(555) 01-", digits)).alias("phone"),
        F.when(k % 8 == 6, text(day, "/", month, "/2024")).otherwise(text("2024-", month, "-", day)).alias("joined"),
        F.when(k % 10 == 4, F.upper(town)).otherwise(town).alias("town"),
        F.when(k % 19 == 12, "abc").when(k % 23 == 20, "9900000").when(k % 6 == 2, text("USD ", amount)).otherwise(amount).alias("spent"),
    )


def health(spark: SparkSession) -> bool:
    return spark.range(1).count() == 1


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page of an ordered table."""
    return df.orderBy(*order).offset(offset).limit(limit)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")
