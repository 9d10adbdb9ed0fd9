"""Quoted CSV in parallel: every file block is cut into records without knowing where it starts.

A block may begin outside or inside a quoted cell. Each task reads its blocks once
and cuts them both ways at the same time; the two ways agree from the first line
that both begin outside quotes, mostly after a few lines, and only lines before it
are cut twice. What a block does to the state (which state it ends in, from either
start) is one row a block; windows over these rows tell every block's true start.
Records that run over block ends are put together from their pieces.

A quote opens a cell only where the cell begins; within it a doubled quote is a
quote, and any other quote closes it, whatever follows up to the delimiter. Line
ends within cells become "\\n". A cell that is never closed runs to the end of its file.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import keep
from ..workers import ship

# White space as ECMAScript trims it.
SPACE = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
BATCH_ROWS, BATCH_CHARS = 4096, 4 << 20
#: ways: 0 cut alike from both starts, 1 from outside only, 2 from inside only, 3 the block's own row.
SCAN = "file string, block long, line long, ways int, ord_out long, ord_in long, text string, end_out boolean, end_in boolean, close_line long, tail_out_line long, tail_out string, tail_in_line long, tail_in string"


def ends_inside(line: str, inside: bool, mark: str) -> bool:
    """Whether a line that begins inside (or outside) a quoted cell ends inside one."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line.startswith('"', at):
                at += 1
            else:
                at = line.find(mark, at) + 1
                if not at:
                    return False
                continue
        inside = False
        while True:
            at = line.find('"', at) + 1
            if not at:
                return True
            if not line.startswith('"', at):
                break
            at += 1
        at = line.find(mark, at) + 1
        if not at:
            return False


def is_blank(text: str, mark: str) -> bool:
    """Whether a record has no text in any cell."""
    if text.strip(SPACE + mark + '"'):
        return False
    return '"' not in text or not any(c.strip(SPACE) for r in csv.reader(text.split("\n"), delimiter=mark) for c in r)


@dataclass
class _Way:
    """A block cut from one start: the open record's lines and first line, records so far."""

    inside: bool
    lines: list[str] = field(default_factory=list)
    first: int = 0
    count: int = 0


class _Cutter:
    """Rows of SCAN from the lines of one block."""

    def __init__(self, file: str, block: int, mark: str, spanning: bool):
        self.file, self.block, self.mark, self.spanning = file, block, mark, spanning
        self.out, self.within = _Way(False), _Way(True)
        # from the block's start, or as soon as both begin a line outside, there is one way only
        self.one = block == 0 or not spanning
        self.close: int | None = None
        self.cut: tuple[int, str] | None = None
        self.line = 0

    def _row(self, line: int, ways: int, text: str, blank: bool) -> tuple:
        out, within = (None if blank else w.count for w in (self.out, self.within))
        return self.file, self.block, line, ways, out if ways < 2 else None, within if ways != 1 else None, text, *[None] * 7

    def _step(self, way: _Way, text: str) -> tuple[int, str] | None:
        """The record (first line, text) that ends with this line."""
        if not way.inside:
            if not self.spanning or not ends_inside(text, False, self.mark):
                return self.line, text
            way.inside, way.lines, way.first = True, [text], self.line
            return None
        way.lines.append(text)
        if ends_inside(text, True, self.mark):
            return None
        way.inside = False
        whole, way.lines = "\n".join(way.lines), []
        return way.first, whole

    def add(self, text: str) -> Iterator[tuple]:
        if self.line == 0 and self.block == 0:
            text = text.removeprefix("\ufeff")
        if self.one:
            if done := self._step(self.out, text):
                if not is_blank(done[1], self.mark):
                    yield self._row(done[0], 0, done[1], False)
                    self.out.count += 1
                    self.within.count += 1
        else:
            if done := self._step(self.out, text):
                blank = is_blank(done[1], self.mark)
                yield self._row(done[0], 1, done[1], blank)
                self.out.count += not blank
            if self.close is None:
                # lines before the close are the end of another block's record; they need not be held
                if not ends_inside(text, True, self.mark):
                    self.close, self.within.inside = self.line, False
                    if self.out.inside:
                        self.cut = self.out.first, "\n".join(self.out.lines)
            elif (done := self._step(self.within, text)) and not is_blank(done[1], self.mark):
                yield self._row(done[0], 2, done[1], False)
                self.within.count += 1
            self.one = not self.out.inside and not self.within.inside
        self.line += 1

    def end(self) -> Iterator[tuple]:
        if self.cut:
            # the part of a record cut from outside that a record from inside takes
            yield self.file, self.block, self.cut[0], 4, None, None, self.cut[1], *[None] * 7
        within = self.out if self.one else self.within
        tails = [(w.first, "\n".join(w.lines)) if w.inside and w.lines else (None, None) for w in (self.out, within)]
        yield self.file, self.block, self.line, 3, self.out.count, self.within.count, None, self.out.inside, within.inside, self.close, *tails[0], *tails[1]


def scan(spark: SparkSession, path: str, mark: str, spanning: bool = True) -> DataFrame:
    """Rows of SCAN of all files under path, written."""
    ship(spark)
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in SCAN.split(", "))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(arrow), arrow)], schema=arrow)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now: _Cutter | None = None
        for b in batches:
            files, blocks, lines = (b.column(k) for k in range(3))
            for file, block, line in zip(files.to_pylist(), blocks.to_pylist(), lines.to_pylist()):
                if now is None or (now.file, now.block) != (file, block):
                    if now is not None:
                        yield from now.end()
                    now = _Cutter(file, block, mark, spanning)
                yield from now.add(line)
        if now is not None:
            yield from now.end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += len(row[6] or "")
            if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
                yield batch(held)
                held, size = [], 0
        yield batch(held)

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return keep(lines.mapInArrow(run, SCAN), "scan")


def block_starts(scanned: DataFrame) -> DataFrame:
    """Each block's row with `inside`, its true start, and `span`, the block in which the record open at its start began.

    A block's effect on the state is fixed, or it keeps it, or it turns it over: the state
    is the last fixed one, turned over as often as blocks since did that.
    """
    blocks = scanned.filter("ways = 3").drop("ways", "text", "line")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    turns = F.when(F.col("end_out") & ~F.col("end_in"), 1).otherwise(0)
    blocks = blocks.withColumn("turns", F.sum(turns).over(upto))
    fixed = F.when(F.col("end_out") == F.col("end_in"), F.struct(F.col("end_out").cast("int").alias("state"), "turns"))
    blocks = blocks.withColumns({"fixed": F.last(fixed, ignorenulls=True).over(before), "turned": F.coalesce(F.lag("turns").over(Window.partitionBy("file").orderBy("block")), F.lit(0))})
    state = F.coalesce(F.col("fixed.state"), F.lit(0)) + F.col("turned") - F.coalesce(F.col("fixed.turns"), F.lit(0))
    blocks = blocks.withColumn("inside", state % 2 == 1)
    tail = F.when(F.when(F.col("inside"), F.col("tail_in")).otherwise(F.col("tail_out")).isNotNull(), F.col("block"))
    blocks = blocks.withColumn("span", F.when(F.col("inside"), F.last(tail, ignorenulls=True).over(before)))
    return blocks.drop("turns", "turned", "fixed")


def spanning(scanned: DataFrame, starts: DataFrame, mark: str) -> DataFrame:
    """file, block, ord and text of records that run over block ends; a block's last record is the one that does."""
    # pieces: tails, and what lies before a block's close, cut from outside
    tails = starts.select("file", F.col("block").alias("span"), "block", F.expr("if(inside, tail_in_line, tail_out_line)").alias("line"), F.expr("if(inside, tail_in, tail_out)").alias("text"))
    cuts = scanned.filter("ways = 4").select("file", "block", F.col("line").alias("cut_line"), F.col("text").alias("cut"))
    open_ = starts.filter("inside").join(cuts, ["file", "block"], "left")
    ends = open_.select("file", "span", "block", F.expr("if(close_line IS NULL, tail_out_line, cut_line)").alias("line"), F.expr("if(close_line IS NULL, tail_out, cut)").alias("text"))
    bounds = open_.select("file", "span", "block", F.expr("coalesce(cut_line, close_line + 1, 9223372036854775807L)").alias("upto"))
    heads = scanned.filter("ways = 1").join(bounds, ["file", "block"]).filter("line < upto").select("file", "span", "block", "line", "text")
    pieces = tails.unionByName(ends).unionByName(heads).filter("text IS NOT NULL AND span IS NOT NULL")
    whole = pieces.groupBy("file", "span").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))), lambda p: p["text"]), "\n").alias("text"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not is_blank(t, mark) for t in b.column(2).to_pylist()], pa.bool_()))

    last = starts.select("file", F.col("block").alias("span"), F.expr("if(inside, ord_in, ord_out)").alias("ord"))
    return whole.mapInArrow(full, whole.schema).join(last, ["file", "span"]).select("file", F.col("span").alias("block"), "ord", "text")


def places(starts: DataFrame, spans: DataFrame) -> DataFrame:
    """file, block and before: how many records that are not blank precede the block's in its file; n: how many it has."""
    more = spans.groupBy("file", "block").agg(F.count(F.lit(1)).alias("more"))
    counts = starts.select("file", "block", F.expr("if(inside, ord_in, ord_out)").alias("own")).join(more, ["file", "block"], "left")
    counts = counts.select("file", "block", (F.col("own") + F.coalesce("more", F.lit(0))).alias("n"))
    return counts.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n"))


def records(scanned: DataFrame, starts: DataFrame, spans: DataFrame) -> DataFrame:
    """file, block, ord (from 0 within the block) and text of every record that is not blank.

    starts: the written result of block_starts. It has one row a block, and Spark
    broadcasts it while it is small; however it is joined, no order is needed.
    """
    chosen = scanned.filter("ways < 3").join(starts.select("file", "block", "inside"), ["file", "block"])
    own = chosen.filter("ways = 0 OR (ways = 1 AND NOT inside) OR (ways = 2 AND inside)").select("file", "block", F.when(F.col("inside"), F.col("ord_in")).otherwise(F.col("ord_out")).alias("ord"), "text")
    return own.filter("ord IS NOT NULL").unionByName(spans)
