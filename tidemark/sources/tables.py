"""Stored rows in files by range of row_index: pages and edits touch only the files that hold them.

A table is a folder of Parquet files and of versions. A version is a list of files
with the first and last row_index and the number of rows of each; it is written last,
in one commit, so a reader sees a version whole or not at all. An edit writes anew the
files that hold changed rows and carries the others over by name.

row_index is unique and not null. Rows keep their place when they are edited; deleted
rows stay, marked. An empty table has one version without files.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.apply import write_back

FILES = "file string, first long, last long, rows long"
#: Rows of a file.
FILE_ROWS = 1_000_000


@dataclass
class Table:
    """One version of the table in a folder."""

    spark: SparkSession
    folder: str
    version: int
    schema: T.StructType

    @property
    def files(self) -> DataFrame:
        """The version's files, one row each."""
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/versions/version={self.version}")

    def _of(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    @property
    def rows(self) -> DataFrame:
        return self._of([r.file for r in self.files.select("file").collect()])

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset to offset + limit by row_index, from the files that hold them."""
        order = Window.orderBy("first")
        # one row a file
        placed = self.files.withColumn("before", F.sum("rows").over(order) - F.col("rows"))
        held = placed.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)).orderBy("first").collect()
        return self._of([r.file for r in held]).orderBy("row_index").offset(offset - held[0].before if held else 0).limit(limit)

    def after(self, cursor: int, limit: int) -> DataFrame:
        """The next rows behind a row_index, wherever that is; the last one's row_index is the next cursor."""
        names, found = [], 0
        # files from the cursor on, until they hold enough; the first may hold rows before the cursor
        for r in self.files.filter(F.col("last") > cursor).orderBy("first").toLocalIterator():
            names.append(r.file)
            found += r.rows if r.first > cursor else 0
            if found >= limit:
                break
        return self._of(names).filter(F.col("row_index") > cursor).orderBy("row_index").limit(limit)

    def edited(self, headers: list[str], planned: DataFrame, again: bool = False) -> Table:
        """A new version with planned changes written back; files without changed rows are carried over.

        A next version that is there already is an error; with again, for a sole writer
        that tries again, it is what a try that died has left, and replaced.
        """
        changed = planned.filter("change_kind IS NOT NULL").select("row_id").distinct()
        touched = self.rows.select("row_id", F.col("_metadata.file_path").alias("file")).join(changed, "row_id", "left_semi").select("file").distinct()
        names = {r.file for r in touched.collect()}
        old = {r.file for r in self.files.select("file").collect()} & names
        if not old:
            return _publish(self.spark, self.folder, self.version + 1, self.files, self.schema, again)
        into = f"{self.folder}/data/{uuid.uuid4().hex}"
        done = write_back(self._of(sorted(old)), headers, planned).select(self.schema.names)
        done.repartitionByRange(len(old), "row_index").sortWithinPartitions("row_index").write.parquet(into)
        kept = self.files.filter(~F.col("file").isin(*old))
        return _publish(self.spark, self.folder, self.version + 1, kept.unionByName(_listed(self.spark.read.schema(self.schema).parquet(into))), self.schema, again)


def _listed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("row_index").alias("first"), F.max("row_index").alias("last"), F.count(F.lit(1)).alias("rows"))


def _publish(spark: SparkSession, folder: str, version: int, files: DataFrame, schema: T.StructType, again: bool = False) -> Table:
    files.select("file", "first", "last", "rows").coalesce(1).write.mode("overwrite" if again else "errorifexists").parquet(f"{folder}/versions/version={version}")
    return Table(spark, folder, version, schema)


def store(rows: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> Table:
    """rows as a new table: range-sorted by row_index into files of about file_rows rows, with dirty and deleted."""
    spark = rows.sparkSession
    for name in ("dirty", "deleted"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(False))
    into = f"{folder}/data/{uuid.uuid4().hex}"
    parts = max(1, -(-rows.count() // file_rows))
    rows.repartitionByRange(parts, "row_index").sortWithinPartitions("row_index").write.parquet(into)
    return _publish(spark, folder, 0, _listed(spark.read.schema(rows.schema).parquet(into)), rows.schema)


def open_table(spark: SparkSession, folder: str, schema: T.StructType, version: int | None = None) -> Table:
    """A version of the table in a folder, by default the latest."""
    if version is None:
        try:
            version = spark.read.schema(f"{FILES}, version int").parquet(f"{folder}/versions").agg(F.max("version")).first()[0]
        except AnalysisException as error:
            raise ValueError(f"no table in {folder}") from error
    return Table(spark, folder, version or 0, schema)
