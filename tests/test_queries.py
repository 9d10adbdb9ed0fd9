"""Every engine query against its DuckDB equivalent, on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

from tidemark import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


@pytest.fixture(scope="module", autouse=True)
def findings_once():
    """The queries' findings of the contacts, computed by the first test that asks."""
    found, make = {}, queries._found

    def once(spark, sf_dir):
        if sf_dir not in found:
            found[sf_dir] = make(spark, sf_dir)
        return found[sf_dir]

    queries._found = once
    yield
    queries._found = make


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    mine = sorted(str(tuple(r)) for r in found.select(*columns).collect())
    spark.catalog.clearCache()
    theirs = sorted(map(str, duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()))
    assert mine == theirs


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_findings_computed_once(spark):
    """The plan of the findings holds every pattern a bounded number of times, and rows are dealt over all cores before they are widened."""
    from tidemark.operators import detect_rows, stats

    rows = queries.contacts(spark, SF)
    found = detect_rows.detect_row_level(rows, queries.HEADERS, stats.column_stats(rows, queries.HEADERS))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 30 and plan.count("regexp_replace") <= 30 and "size(" not in plan
    assert "RepartitionByExpression" in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_code_of_findings_is_compiled(spark, monkeypatch):
    """No stage of the statistics and of the findings has a method that the JVM leaves uncompiled (over 8000 bytes)."""
    from tidemark.operators import detect_rows, stats

    sizes, keep = [], stats.keep
    debug = spark.sparkContext._jvm.org.apache.spark.sql.execution.debug.__getattr__("package")

    def measured(df):
        # plans of adaptive execution show their code only after they ran
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            code = debug.codegenString(df._jdf.queryExecution().executedPlan())
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        sizes.extend(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code))
        return df

    monkeypatch.setattr(stats, "keep", lambda df, label: keep(measured(df), label))
    rows = queries.contacts(spark, SF)
    measured(detect_rows.detect_row_level(rows, queries.HEADERS, stats.column_stats(rows, queries.HEADERS)))
    assert len(sizes) > 20 and max(sizes) <= 8000
