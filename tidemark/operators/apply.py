"""Decisions applied to rows: planned changes, row write-back, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MAX_DECISIONS, REVIEW_STATUSES
from .review import effective_value


def check_request(decisions: DataFrame, most: int = MAX_DECISIONS) -> DataFrame:
    """The decisions of one request from outside: at most `most`, each with a known status; anything else is an error."""
    found = decisions.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("status").isin(*REVIEW_STATUSES), F.lit(False))).alias("odd")).first()
    if found.n > most:
        raise ValueError(f"a request carries at most {most} decisions")
    if found.odd:
        raise ValueError(f"{found.odd} decisions have a status other than {', '.join(REVIEW_STATUSES)}")
    return decisions


def plan_changes(decisions: DataFrame, suggested: DataFrame, rows: DataFrame, headers: list[str]) -> DataFrame:
    """One row per decision that counts.

    decisions: suggestion_id, status, final_value, decision_seq; the first per
    suggestion holds, unknown suggestions are left out. Accepted and edited ones
    need their row; others are recorded without it. change_kind is "delete", "cell"
    or null where nothing is written; removed is the whole row of a deletion, by
    header. Decisions and the table move to their rows once.
    """
    first = decisions.groupBy("suggestion_id").agg(F.min_by(F.struct("status", "final_value", "decision_seq"), "decision_seq").alias("d")).select("suggestion_id", "d.*")
    joined = suggested.drop("status", "final_value").join(first, "suggestion_id")
    # of rows of one id any one counts; dealt by id first, they are sorted once, for that and for the join
    held = rows.select("row_id", F.struct(*[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in headers]).alias("_cells")).repartition("row_id").dropDuplicates(["row_id"])
    cells = {h: F.col("_cells").getField(h) for h in headers}
    cell = reduce(lambda out, h: out.when(F.col("column_key") == h, cells[h]), headers, F.when(F.lit(False), F.lit("")))
    joined = joined.join(held, "row_id", "left").withColumns({"has_row": F.col("_cells").isNotNull(), "cell": cell})
    writes = F.col("status").isin("accepted", "edited")
    joined = joined.filter(~writes | F.col("has_row"))
    joined = joined.withColumn("final_value", effective_value(F.col("status"), F.col("final_value"), F.col("proposed_value")))
    rewrites = writes & F.col("action").isin("set_value", "normalize_value") & F.col("column_key").isNotNull()
    before, after = F.coalesce("cell", F.lit("")), F.coalesce("final_value", F.lit(""))
    kind = F.when(writes & (F.col("action") == "delete_row"), "delete").when(rewrites & (before != after), "cell")
    joined = joined.withColumn("change_kind", kind)
    shown = lambda c: F.when(F.col("change_kind") == "cell", c)
    removed = F.when(F.col("change_kind") == "delete", F.create_map(*[x for h in headers for x in (F.lit(h), cells[h])]))
    return joined.select("suggestion_id", "row_id", "column_key", "action", "source", "status", "final_value", "decision_seq", "change_kind", shown(before).alias("before"), shown(after).alias("after"), removed.alias("removed"))


def summarise(planned: DataFrame) -> DataFrame:
    """cells_changed, rows_deleted, rows_touched and recorded."""
    changed = F.col("change_kind").isNotNull()
    return planned.agg(F.count_if(F.col("change_kind") == "cell").alias("cells_changed"), F.count_if(F.col("change_kind") == "delete").alias("rows_deleted"), F.countDistinct(F.when(changed, F.col("row_id"))).alias("rows_touched"), F.count(F.lit(1)).alias("recorded"))


def write_back(rows: DataFrame, headers: list[str], planned: DataFrame) -> DataFrame:
    """rows with edits, dirty and deleted.

    The last planned edit of a cell wins. A deleted row keeps its data. All changes of
    a row are put together in one pass over the plan, so rows move once.
    """
    cell = F.col("change_kind") == "cell"
    last = planned.filter("change_kind is not null").groupBy("row_id", "column_key").agg(
        F.max_by(F.when(cell, F.col("after")), F.when(cell, F.col("decision_seq"))).alias("after"), F.max(cell).alias("edited"), F.max(F.col("change_kind") == "delete").alias("gone")
    )
    entries = F.map_from_entries(F.collect_list(F.when(F.col("edited"), F.struct("column_key", "after"))))
    changes = last.groupBy("row_id").agg(F.when(F.max("edited"), entries).alias("_edits"), F.max("gone").alias("_gone"))
    for name in ("dirty", "deleted"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(False))
    both = rows.join(changes, "row_id", "left")
    lost = F.coalesce("_gone", F.lit(False))
    kept = lambda h: F.when(lost, F.col(f"`{h}`")).otherwise(F.coalesce(F.try_element_at("_edits", F.lit(h)), F.col(f"`{h}`"))).alias(h)
    return both.select("row_id", "row_index", *[kept(h) for h in headers], (F.col("dirty") | (~lost & F.col("_edits").isNotNull())).alias("dirty"), (F.col("deleted") | lost).alias("deleted"))


def audit(planned: DataFrame, rows: DataFrame | None = None, headers: list[str] | None = None) -> DataFrame:
    """One row per planned decision with the state before and after.

    A deletion's before is the whole row, a cell's a single entry; both are null
    where nothing changed. The whole row is the one the plan has met (`removed`); rows
    and headers, where given, give it anew, for a plan that was made of other headers.
    """
    both = planned.withColumnRenamed("removed", "_row")
    if rows is not None:
        whole = rows.select("row_id", F.create_map(*[x for h in headers for x in (F.lit(h), F.coalesce(F.col(f"`{h}`"), F.lit("")))]).alias("_row"))
        both = planned.drop("removed").join(whole, "row_id", "left")
    cell = F.col("change_kind") == "cell"
    before = F.when(F.col("change_kind") == "delete", F.col("_row")).when(cell, F.create_map("column_key", "before"))
    return both.select("suggestion_id", "row_id", "column_key", "action", "source", F.col("status").alias("review_status"), "final_value", before.alias("before_state"), F.when(cell, F.create_map("column_key", "after")).alias("after_state"), "decision_seq")


def update_statuses(suggested: DataFrame, planned: DataFrame) -> DataFrame:
    """suggestions with the status and final value that were applied."""
    done = planned.select("suggestion_id", F.col("status").alias("_s"), F.col("final_value").alias("_f"))
    for name in ("status", "final_value"):
        if name not in suggested.columns:
            suggested = suggested.withColumn(name, F.lit("pending" if name == "status" else None).cast("string"))
    both = suggested.join(done, "suggestion_id", "left")
    return both.withColumns({"status": F.coalesce("_s", "status"), "final_value": F.when(F.col("_s").isNotNull(), F.col("_f")).otherwise(F.col("final_value"))}).drop("_s", "_f")


def clean_rows(rows: DataFrame, headers: list[str]) -> DataFrame:
    """Rows that stay, in order, with their data columns."""
    return rows.filter("not deleted").orderBy("row_index").select("row_index", *[F.col(f"`{h}`") for h in headers])
