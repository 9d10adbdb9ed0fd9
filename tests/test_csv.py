"""Quoted CSV cut in parallel: against a parser that reads from start to end."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources.csv import read_csv
from tidemark.sources.csv_scan import SPACE, ends_inside, is_blank


def whole(text, mark=","):
    """Records with text, cells trimmed, by the standard parser."""
    return [[c.strip(SPACE) for c in r] for r in csv.reader(io.StringIO(text), delimiter=mark) if any(c.strip(SPACE) for c in r)]


def shown(rows):
    return [tuple(r)[2:] for r in sorted(rows.collect(), key=lambda r: r.row_index)]


@pytest.fixture()
def blocks_of(spark):
    """Cuts a file of a text into about n blocks from now on."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def cut(text, n):
        spark.conf.set(keys[0], str(len(text.encode()) // n))
        spark.conf.set(keys[1], "10")

    yield cut
    for k, v in before.items():
        spark.conf.set(k, v)


def messy(n, seed, long=0):
    draw = random.Random(seed)
    cell = lambda: draw.choice(["", "x", "a,b", 'say "hi"', "two\nlines", "\n\n", '"', ",", '",\n"', "é" * 3, "word " * draw.randint(1, 9), "line\n" * long])
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["k", "a", "b", "c"])
    for k in range(n):
        if draw.random() < 0.1:
            out.write(draw.choice(["\n", " , ,,\n", '"",""\n', '"\n",\n']))
        writer.writerow([k, cell(), cell(), cell()])
    return out.getvalue()


@pytest.mark.parametrize("seed, n, long", [(1, 300, 0), (2, 400, 3), (3, 60, 900)])
def test_quoted_line_ends_over_many_blocks(spark, tmp_path, blocks_of, seed, n, long):
    text = messy(n, seed, long)
    (tmp_path / "m.csv").write_text(text)
    blocks_of(text, 9)
    assert spark.read.text(str(tmp_path / "m.csv")).rdd.getNumPartitions() >= 8
    headers, rows = read_csv(spark, str(tmp_path / "m.csv"), delimiter=",")
    want = whole(text)
    assert headers == want[0] and shown(rows) == [tuple(r) for r in want[1:]]
    assert [r.row_index for r in rows.orderBy("row_index").collect()] == list(range(len(want) - 1))


def test_blocks_without_quotes_inside_a_cell(spark, tmp_path, blocks_of):
    inner = "\n".join(f"row {k},looks like data" for k in range(600))
    text = f'a,b\n1,"{inner}"\n2,after\n3,"{inner}",dropped\n\n4\n'
    (tmp_path / "i.csv").write_text(text)
    blocks_of(text, 11)
    headers, rows = read_csv(spark, str(tmp_path / "i.csv"))
    assert headers == ["a", "b"] and shown(rows) == [("1", inner), ("2", "after"), ("3", inner), ("4", "")]
    (tmp_path / "open.csv").write_text("a,b\n1,x\n2," + '"never closed\n' + inner)
    _, rows = read_csv(spark, str(tmp_path / "open.csv"), delimiter=",")
    assert shown(rows) == [("1", "x"), ("2", "never closed\n" + inner)]


@pytest.mark.parametrize("multi_line", [True, False])
def test_numbers_hold_when_partitions_change(spark, tmp_path, multi_line):
    for k in range(8):
        (tmp_path / f"part-{k}.csv").write_text("k,v\n" + "".join(f"{k},{i}\n" for i in range(10 + k)))
    want = [(str(k), str(i)) for k in range(8) for i in range(10 + k)]
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    _, rows = read_csv(spark, str(tmp_path), multi_line=multi_line)
    try:
        for n in ("8", "1"):
            spark.conf.set("spark.sql.files.minPartitionNum", n)
            assert shown(rows) == want and rows.count() == len(want)
            assert shown(read_csv(spark, str(tmp_path), multi_line=multi_line)[1]) == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_headers_of_all_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n\nx, y\n1,2\n")
    (tmp_path / "b.csv").write_text(" ,\n x,y \n3,4\n")
    (tmp_path / "c.csv").write_text("\n \n")
    assert shown(read_csv(spark, str(tmp_path))[1]) == [("1", "2"), ("3", "4")]
    (tmp_path / "d.csv").write_text("x,z\n5,6\n" * 50)
    with pytest.raises(Exception, match="d.csv"):
        read_csv(spark, str(tmp_path))
    headers, rows = read_csv(spark, str(tmp_path), headers_everywhere=False)
    assert headers == ["x", "y"] and shown(rows)[:4] == [("1", "2"), ("3", "4"), ("x", "z"), ("5", "6")] and rows.count() == 102
    (tmp_path / "e.csv").write_text("x,y,more\n")
    (tmp_path / "d.csv").unlink()
    with pytest.raises(Exception, match="e.csv"):
        read_csv(spark, str(tmp_path))


def test_lines_end_where_cells_do():
    cases = {'a,"b': True, 'a,"b"': False, 'a,"b""': True, 'a,"b"""': False, 'a,b"c': False, '"a"b,"c': True, '"",""': False, '"a, "b,"c': True, "": False, '"': True}
    assert {k: ends_inside(k, False, ",") for k in cases} == cases
    assert [ends_inside(t, True, ",") for t in ('x",y', "x", 'x""', 'x","', '"', '",""')] == [False, True, True, True, False, False]
    assert is_blank(' ,"","",', ",") and not is_blank('","', ",") and not is_blank(",,x", ",") and is_blank('"\n ",\t', ",")


def test_one_pass_of_wide_files(spark, tmp_path):
    names = ",".join(f"h{i}" for i in range(80))
    (tmp_path / "w.csv").write_text(names + "\n" + ",".join(str(i) for i in range(85)) + "\n1\n")
    headers, rows = read_csv(spark, str(tmp_path / "w.csv"), delimiter=",")
    assert len(headers) == 80 and rows.select(F.col("h79")).collect()[0][0] in ("79", "")
    assert shown(rows)[1] == ("1", *[""] * 79)
