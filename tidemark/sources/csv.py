"""CSV in and out: messy headers, ragged rows, every cell a string."""

from __future__ import annotations

import csv
import io
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trim
from ..storage import discard, keep
from .csv_scan import block_starts, places, records, scan, spanning

#: Names of the row columns beside the data.
ROW_ID, ROW_INDEX = "row_id", "row_index"
DELIMITERS = ",\t|;"
#: Lines with text that the driver reads first to find the delimiter.
HEAD_LINES = 50


def normalise_headers(raw: list[str]) -> list[str]:
    """Trimmed names; blanks become column_N, the nth repeat of a name gets _n."""
    seen: Counter = Counter()
    out = []
    for i, name in enumerate(raw, 1):
        base = name.strip() or f"column_{i}"
        seen[base] += 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def sniff_delimiter(head: str) -> str:
    """The candidate that splits the first records into the most equal, widest rows."""
    best, found = (0.0, 0), ","
    for mark in DELIMITERS:
        widths = [len(r) for r in list(csv.reader(io.StringIO(head), delimiter=mark))[:20] if any(c.strip() for c in r)]
        if widths and widths[0] > 1:
            score = (sum(w == widths[0] for w in widths) / len(widths), widths[0])
            if score > best:
                best, found = score, mark
    return found


def find_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of the first lines with text of the first file, by name, that has any."""
    for file in sorted(spark.read.text(path).inputFiles()):
        lines = spark.read.text(file).filter(F.col("value").rlike(f'[^\\s"{DELIMITERS}\\x{{FEFF}}]'))
        if head := [r[0] for r in lines.take(HEAD_LINES)]:
            return sniff_delimiter("\n".join(head).removeprefix("\ufeff"))
    return ","


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, cap: int | None = None, multi_line: bool = True, headers_everywhere: bool = True) -> tuple[list[str], DataFrame]:
    """(headers, rows): row_id, row_index and one string column per header; rows are written to the shared folder.

    The first record with any text, of the first file by name, is the header. Every
    other file of a folder begins with the same record, or it is an error; with
    headers_everywhere=False those that begin otherwise hold data from the start.
    Records without text are skipped, cells trimmed, short rows padded with "" and
    extra cells dropped. row_index counts from 0 in file order, files by name. cap
    keeps the first rows only. Files are read once, in as many tasks as they have
    blocks, also where cells hold line ends; multi_line=False takes every line for
    a record of its own.
    """
    mark = delimiter or find_delimiter(spark, path)
    scanned = scan(spark, path, mark, multi_line)
    starts = keep(block_starts(scanned), "starts")
    spans = spanning(scanned, starts, mark)
    blocks = keep(places(starts, spans), "blocks")
    found = records(scanned, starts, spans)
    firsts = found.join(blocks.filter("before = 0 AND n > 0").select("file", "block"), ["file", "block"]).filter("ord = 0").select("file", "text")
    first = firsts.orderBy("file").limit(1).collect()
    cells = next(csv.reader(io.StringIO(first[0].text), delimiter=mark), []) if first else []
    headers = normalise_headers(cells)
    if not headers:
        out = spark.createDataFrame([], T.StructType([T.StructField(ROW_ID, T.StringType()), T.StructField(ROW_INDEX, T.LongType())]))
    else:
        # a head is the header where all its cells are
        is_head = F.transform(_cells(mark, len(cells) + 1), lambda c: trim(F.coalesce(c, F.lit("")))) == F.array(*[trim(F.lit(c)) for c in [*cells, ""]])
        files = blocks.groupBy("file").agg(F.sum("n").alias("n")).filter("n > 0")
        # one row a file
        files = files.withColumn("skip", F.lit(1).cast("long")) if headers_everywhere else files.join(firsts.select("file", is_head.cast("long").alias("skip")), "file")
        files = files.select("file", "skip", (F.sum(F.col("n") - F.col("skip")).over(Window.orderBy("file")) - F.col("n")).alias("start"))
        laid = keep(blocks.join(files, "file").select("file", "block", "start", "before", "skip"), "places")
        at = F.col("before") + F.col("ord")
        rows = found.join(laid, ["file", "block"]).select("file", "text", at.alias("at"), "skip", (F.col("start") + at).alias(ROW_INDEX))
        other = F.concat("file", F.lit(" begins with another header than the first file; headers_everywhere=False reads it as data"))
        rows = rows.filter(F.when(F.col("at") >= F.col("skip"), True).when(is_head, False).otherwise(F.raise_error(other).cast("boolean")))
        rows = rows.select(ROW_INDEX, _cells(mark, len(headers)).alias("c"))
        if cap is not None:
            rows = rows.filter(F.col(ROW_INDEX) < cap)
        columns = [F.coalesce(trim(F.col("c")[i]), F.lit("")).alias(h) for i, h in enumerate(headers)]
        out = keep(rows.select(F.format_string("r-%02d", F.col(ROW_INDEX) + 1).alias(ROW_ID), ROW_INDEX, *columns), "csv")
        discard(laid)
    for table in (scanned, starts, blocks):
        discard(table)
    return headers, out


def _cells(mark: str, width: int) -> Column:
    """The first `width` cells of a record's text."""
    parsed = F.from_csv("text", ", ".join(f"c{i} string" for i in range(width)), {"sep": mark, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxColumns": "1000000"})
    return F.array(*[parsed[f"c{i}"] for i in range(width)])


def truncated(total_rows: int, cap: int | None) -> bool:
    return cap is not None and total_rows > cap


def write_csv(df: DataFrame, path: str, headers: list[str], one_file: bool = False) -> None:
    """Rows by row_index, quoted only where needed, missing cells empty. Every part file has the header; read_csv skips them."""
    out = df.orderBy(ROW_INDEX).select(*[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in headers])
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


#: Upload guard: accepted content types and the largest size.
CONTENT_TYPES = ("text/csv", "application/csv", "application/vnd.ms-excel", "text/plain")
MAX_BYTES = 50 * 1024 * 1024


def check_upload(content_type: str, size: int, max_bytes: int = MAX_BYTES) -> str | None:
    """Why a file is refused, or None."""
    if content_type not in CONTENT_TYPES:
        return f"content type {content_type} is not CSV"
    return f"{size} bytes is over the limit of {max_bytes}" if size > max_bytes else None
