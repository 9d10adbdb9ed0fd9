"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import shared_dir

_shipped: set[str] = set()
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 1024


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so workers can import it.

    Arrow batches of texts are cut to ARROW_ROWS rows unless the session has set a size.
    """
    context = spark.sparkContext
    if spark.conf.get(_ARROW) == "10000":
        spark.conf.set(_ARROW, str(ARROW_ROWS))
    if context.applicationId not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        with tempfile.TemporaryDirectory() as there:
            shutil.copytree(os.path.join(top, "tidemark"), f"{there}/zip/tidemark", ignore=shutil.ignore_patterns("__pycache__"))
            name = shutil.make_archive(os.path.join(tempfile.mkdtemp(), f"tidemark-{uuid.uuid4().hex}"), "zip", f"{there}/zip")
        context.addPyFile(name)
        _shipped.add(context.applicationId)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Folders that the operator at work has written, where it deletes what it no longer needs.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def _path_of(df: DataFrame) -> str | None:
    names = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    return next((n for n in names if "/tidemark/" in n), None)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write a Parquet table to the shared folder and read it back.

    The files survive the loss of any executor, later readers prune columns, and
    the writer's commit protocol makes retried tasks harmless.
    """
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table that `materialise` made."""
    if name := _path_of(df):
        _delete(spark, name)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written, and all tables that it wrote on the way deleted.

    The first argument is a DataFrame. For operators whose result is narrow.
    """

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        spark, made = df.sparkSession, []
        token = _made.set(made)
        try:
            out = operator(df, *args, **kwargs)
            _made.set(None)
            return materialise(spark, out, operator.__name__)
        finally:
            _made.reset(token)
            for path in made:
                _delete(spark, path)

    return run


def partitions(spark: SparkSession, amount: int, each: int) -> int:
    """Tasks for an amount of work of which a task takes about `each`, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def crc32_mod(column: str, n: int):
    """crc32 of a column's text form, modulo n (null ids hash as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def append(
    df: DataFrame,
    fields: list[T.StructField],
    compute: Callable[[pa.RecordBatch], Iterable[pa.Array]],
    rows: int = 2000,
) -> DataFrame:
    """All columns of df, then `fields`, whose arrays compute() makes of a batch.

    A computed column replaces an input column of the same name (in any case).
    Batches are cut to `rows` rows, so a worker's memory is bounded by the
    longest texts of one batch and not by the partition.
    """
    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    kept = [f.name for f in keep]
    schema = T.StructType(keep + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part = whole.slice(at, rows)
                made = list(compute(part))
                columns = [part.column(part.schema.get_field_index(n)) for n in kept] + made
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
