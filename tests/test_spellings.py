"""The usual spelling of text cells, by both ways to look it up."""

from collections import Counter
from dataclasses import replace

import pytest

from tidemark.config import DEFAULT
from tidemark.operators import detect_rows, stats


@pytest.fixture(scope="module")
def rows(spark):
    """One key in nine of ten rows, spelled two ways; many others once or twice, some of them empty or null."""
    made = []
    for i in range(3000):
        word = "Mexico" if i % 10 else f"Place {'abcdefghij'[i // 10 % 10]}{'klmnopqrst'[i // 100 % 10]}"
        word = word.lower() if i % 7 == 0 else word
        made.append((f"r{i}", i, None if i % 310 == 0 else "" if i % 320 == 0 else word, f"only {i}"))
    return spark.createDataFrame(made, "row_id string, row_index long, place string, note string")


def by_hand(rows):
    out = set()
    for c in ("place", "note"):
        cells = [(r.row_id, r[c]) for r in rows.collect() if r[c]]
        times = Counter(v for _, v in cells)
        first = {}
        for at, (_, v) in enumerate(cells):
            first.setdefault(v, at)
        best = {}
        for v in times:
            key = "".join(x for x in v.lower() if x.isalnum())
            best[key] = max(best.get(key, v), v, key=lambda w: (times[w], -first[w]))
        out |= {(i, c, v, best[k]) for i, v in cells if (k := "".join(x for x in v.lower() if x.isalnum())) and best[k] != v}
    return out


@pytest.mark.parametrize("sent", [DEFAULT.spelling_bytes, 0])
@pytest.mark.parametrize("complete", [True, False])
def test_drifting_spellings(spark, rows, sent, complete):
    config = replace(DEFAULT, spelling_bytes=sent)
    known = replace(stats.column_stats(rows, ["place", "note"]), complete=complete)
    long = detect_rows.with_stats(rows, ["place", "note"], known, config)
    assert long.count() == 6000
    found = {(r.row_ids[0], r.column_key, r.current_value, r.proposed_value) for r in detect_rows.inconsistent_formats(long, config).collect()}
    assert found == by_hand(rows) and len(found) > 400


def test_cells_stay_where_they_are(spark, rows):
    known = stats.column_stats(rows, ["place", "note"])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan(detect_rows.with_stats(rows, ["place", "note"], known))
    keyed = stats.cells(rows, ["place", "note"]).withColumn("key", detect_rows.normalize_key(detect_rows.F.col("value")))
    usual = known.spellings.filter("spellings > 1")
    out, moved = detect_rows.with_spelling(keyed, usual, replace(DEFAULT, spelling_bytes=0))
    # no note drifts, and few pass the filter
    assert moved.filter("column_key = 'note'").count() < 300
    assert moved.filter("key = 'mexico'").select("deal").distinct().count() > 1
    assert out.count() + moved.count() == 6000


def test_no_spellings(spark, rows):
    none = rows.limit(0)
    known = stats.column_stats(none, ["place", "note"])
    assert detect_rows.with_stats(rows, ["place", "note"], known, replace(DEFAULT, spelling_bytes=-1)).filter("spelling IS NOT NULL").isEmpty()
