"""Tables in range-clustered files: pages and edits against the whole table."""

from pyspark.sql import functions as F

from tidemark.sources.tables import open_table, store


def made(spark, n=1000):
    # gaps in row_index, rows out of order
    return spark.range(n).select(F.concat(F.lit("r-"), F.col("id")).alias("row_id"), (F.col("id") * 3 + 7).alias("row_index"), F.concat(F.lit("name "), F.col("id")).alias("name"), F.lit("x").alias("note")).orderBy(F.hash("id")).repartition(7)


def plain(df):
    return [tuple(r) for r in df.collect()]


def plan(spark, *changes):
    rows = [(f"s{k}", row, column, "set_value", "rule", "accepted", after, k, kind, "", after) for k, (row, column, kind, after) in enumerate(changes)]
    return spark.createDataFrame(rows, "suggestion_id string, row_id string, column_key string, action string, source string, status string, final_value string, decision_seq int, change_kind string, before string, after string")


def test_pages_read_the_files_that_hold_them(spark, tmp_path):
    table = store(made(spark), f"{tmp_path}/t", file_rows=100)
    whole = made(spark).orderBy("row_index")
    assert 8 <= table.files.count() <= 12 and table.rows.count() == 1000
    for offset, limit in ((0, 10), (95, 10), (950, 100), (1000, 5), (320, 250), (5000, 1)):
        page = table.page(offset, limit)
        assert plain(page.select("row_id", "row_index", "name", "note")) == plain(whole.offset(offset).limit(limit))
        assert len(page.inputFiles()) <= limit // 80 + 2
    seen, cursor = [], -1
    while rows := table.after(cursor, 137).collect():
        seen += [r.row_index for r in rows]
        cursor = rows[-1].row_index
    assert seen == [r.row_index for r in whole.collect()]
    assert len(table.after(seen[500], 20).inputFiles()) <= 2


def test_edits_rewrite_touched_files_only(spark, tmp_path):
    first = store(made(spark), f"{tmp_path}/t", file_rows=100)
    names = lambda t: {r.file for r in t.files.collect()}
    second = first.edited(["name", "note"], plan(spark, ("r-500", "name", "cell", "new"), ("r-9999", "name", "cell", "no such row"), ("r-1", "note", None, None)))
    assert len(names(first) - names(second)) == len(names(second) - names(first)) == 1
    third = second.edited(["name", "note"], plan(spark, ("r-500", "note", "cell", "again"), ("r-3", None, "delete", None)))
    assert len(names(second) & names(third)) == len(names(second)) - 2
    assert third.edited(["name"], plan(spark, ("r-1", "name", None, None))).version == 3
    latest = open_table(spark, f"{tmp_path}/t", first.schema)
    assert latest.version == 3 and latest.rows.count() == 1000
    got = {r.row_id: r for r in latest.rows.filter("dirty OR deleted").collect()}
    assert set(got) == {"r-500", "r-3"} and (got["r-500"].name, got["r-500"].note, got["r-3"].deleted) == ("new", "again", True)
    assert plain(latest.page(499, 3).select("row_id")) == [("r-499",), ("r-500",), ("r-501",)]
    # an old version reads as it was
    assert open_table(spark, f"{tmp_path}/t", first.schema, version=0).rows.filter("dirty OR deleted").count() == 0


def test_an_empty_table(spark, tmp_path):
    table = store(made(spark).limit(0), f"{tmp_path}/t")
    assert table.rows.count() == table.page(0, 5).count() == table.after(0, 5).count() == 0
    assert open_table(spark, f"{tmp_path}/t", table.schema).rows.count() == 0
