"""Streams against batch runs: duplicates and decisions that arrive bit by bit."""

import os
import random
from dataclasses import replace

import pytest

from tidemark.config import DEFAULT
from tidemark.operators.detect_dups import detect_cross_row
from tidemark.sources import tables
from tidemark.streaming import cross_row
from tidemark.streaming.decisions import apply_stream


def _arrive(spark, rows, headers, folder, batches, **options):
    """Rows in files of one batch each, through the cross-row stream."""
    for k in range(batches):
        rows.filter(f"batch = {k}").drop("batch").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    arriving = spark.readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    cross_row.cross_row_stream(arriving, headers, f"{folder}/out", f"{folder}/state", **options).awaitTermination()
    return sorted((r.type, *r.row_ids) for r in cross_row.found_so_far(spark, f"{folder}/out").collect())


@pytest.mark.parametrize("max_block", [7, 1000])
def test_duplicates_of_a_stream_are_those_of_a_batch_run(spark, tmp_path, max_block):
    rng = random.Random(5)
    names = [f"{rng.choice(['ana', 'bob', 'eve'])} {rng.randrange(10**9)} {rng.randrange(10**6)}" for _ in range(60)]
    made = []
    for i in range(240):
        name = rng.choice(names)
        if rng.random() < 0.4:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("xyz") + name[at + 1 :]
        # a third of all rows are one row; some are empty or null
        made.append((f"r{i}", i, *rng.choice([(name, "town"), (name.upper(), "Town"), (names[0], "town"), (None, ""), ("", None)]), i // 60))
    rows = spark.createDataFrame(made, "row_id string, row_index long, name string, city string, batch int")
    config = replace(DEFAULT, max_block=max_block)
    found = _arrive(spark, rows, ["name", "city"], str(tmp_path), 4, config=config)
    whole = detect_cross_row(rows, ["name", "city"], config)
    assert found == sorted((r.type, *r.row_ids) for r in whole.collect())
    assert {f[0] for f in found} == {"exact_duplicate", "fuzzy_duplicate"}
    # the last batch runs again: the same findings
    os.remove(f"{tmp_path}/state/commits/3")
    os.remove(f"{tmp_path}/state/commits/.3.crc")
    arriving = spark.readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    cross_row.cross_row_stream(arriving, ["name", "city"], f"{tmp_path}/out", f"{tmp_path}/state", config).awaitTermination()
    assert found == sorted((r.type, *r.row_ids) for r in cross_row.found_so_far(spark, f"{tmp_path}/out").collect())


def test_who_arrives_first_stays(spark, tmp_path):
    made = [("late", 9, "same", 0), ("early", 1, "same", 1), ("near", 2, "a longer text of some words", 1), ("nearer", 7, "a longer text of some worts", 0)]
    rows = spark.createDataFrame(made, "row_id string, row_index long, name string, batch int")
    assert _arrive(spark, rows, ["name"], str(tmp_path), 2) == [("exact_duplicate", "early", "late"), ("fuzzy_duplicate", "near", "nearer")]


def test_decisions_as_they_arrive(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i}", i, f"v{i}", "x") for i in range(40)], "row_id string, row_index long, name string, city string")
    table = tables.store(rows, f"{tmp_path}/table", file_rows=10)
    made = [(f"s{i}", f"r{i}", "name", "set_value", f"new {i}", "rule") for i in range(8)] + [("gone", "r39", None, "delete_row", None, "rule"), ("lost", "r99", "name", "set_value", "y", "rule")]
    suggested = spark.createDataFrame(made, "suggestion_id string, row_id string, column_key string, action string, proposed_value string, source string")
    batches = [
        [("s0", "accepted", None, 1), ("s1", "edited", "by hand", 2), ("s1", "rejected", None, 3), ("lost", "accepted", None, 4)],
        [("s0", "rejected", None, 5), ("s2", "rejected", None, 6), ("gone", "accepted", None, 7), ("unknown", "accepted", None, 8)],
        [("s2", "accepted", None, 9), ("s1", "edited", "again", 10), ("gone", "rejected", None, 11)],
    ]
    schema = "suggestion_id string, status string, final_value string, decision_seq int"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        apply_stream(arriving, suggested, table.folder, table.schema, ["name", "city"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        now = tables.open_table(spark, table.folder, table.schema)
        late = spark.read.parquet(f"{tmp_path}/out/late").collect()
        log = spark.read.parquet(f"{tmp_path}/out/audit").collect()
        return now, sorted((r.batch, r.suggestion_id, r.decision_seq) for r in late), sorted((r.batch, r.suggestion_id, r.review_status) for r in log)

    def changed(t):
        return {r.row_id: (r.name, r.deleted) for r in t.rows.filter("dirty OR deleted").collect()}

    now, late, log = run()
    assert now.version == 3
    assert changed(now) == {"r0": ("new 0", False), "r1": ("by hand", False), "r39": ("v39", True)}
    assert late == [(0, "s1", 3), (1, "s0", 5), (2, "gone", 11), (2, "s1", 10), (2, "s2", 9)]
    assert log == [(0, "s0", "accepted"), (0, "s1", "edited"), (1, "gone", "accepted"), (1, "s2", "rejected")]
    # files 1 and 2 were never rewritten
    carried = {r.file for r in tables.open_table(spark, table.folder, table.schema, 0).files.collect()} & {r.file for r in now.files.collect()}
    assert len(carried) == 2
    # the last batch runs again
    for name in ("2", ".2.crc"):
        os.remove(f"{tmp_path}/state/commits/{name}")
    again, late2, log2 = run()
    assert (again.version, late2, log2) == (3, late, log)
    assert changed(again) == changed(now)
