"""The published contact table, CSV edge cases, review, apply and export rules."""

import dataclasses
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from golden import ANSWERS, BY_RULE, FOR_REVIEW, TABLE
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import apply, detect_dups, detect_rows, enrich, evaluate, report, review, similar, stats
from tidemark.plans.export import publish, slug
from tidemark.plans.profile import profile_dataset, split_findings
from tidemark.sources import catalog
from tidemark.sources.csv import check_upload, normalise_headers, read_csv, sniff_delimiter, write_csv
from tidemark.streaming import statistics


@pytest.fixture(scope="module")
def contacts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "contacts.csv"
    path.write_text(TABLE)
    headers, rows = read_csv(spark, str(path))
    return headers, rows.cache()


@pytest.fixture(scope="module")
def profile(contacts):
    headers, rows = contacts
    return profile_dataset(rows, headers)


def test_headers():
    assert normalise_headers(["email", "email", "", " note "]) == ["email", "email_2", "column_3", "note"]
    assert sniff_delimiter("a;b;c\n1;2;3\n") == ";" and sniff_delimiter("a,b\n1,2\n") == ","
    assert check_upload("text/csv", 10) is None and check_upload("image/png", 10) and check_upload("text/csv", 1 << 30)


def test_csv_edge_cases(spark, tmp_path):
    (tmp_path / "e.csv").write_text('email,email,,note\n\n a@b.co ,x,1,"said ""hi"", twice"\n , ,,\nshort\nlong,1,2,3,4\n')
    headers, rows = read_csv(spark, str(tmp_path / "e.csv"))
    got = [tuple(r) for r in rows.orderBy("row_index").collect()]
    assert headers == ["email", "email_2", "column_3", "note"]
    assert got == [("r-01", 0, "a@b.co", "x", "1", 'said "hi", twice'), ("r-02", 1, "short", "", "", ""), ("r-03", 2, "long", "1", "2", "3")]
    assert read_csv(spark, str(tmp_path / "e.csv"), cap=1)[1].count() == 1
    write_csv(rows, str(tmp_path / "o"), headers, one_file=True)
    again = read_csv(spark, str(tmp_path / "o"))[1]
    assert [tuple(r) for r in again.orderBy("row_index").collect()] == got


def test_leading_blank_lines_and_long_headers(spark, tmp_path):
    long = "first\n" * 80 + "name"
    (tmp_path / "b.csv").write_text("\n" * 60 + ' , ,\n\n"' + long + '",b,c\n1,2,3\n')
    headers, rows = read_csv(spark, str(tmp_path / "b.csv"))
    assert headers == [long, "b", "c"] and [tuple(r)[2:] for r in rows.collect()] == [("1", "2", "3")]
    (tmp_path / "none.csv").write_text("\n , ,\n")
    assert read_csv(spark, str(tmp_path / "none.csv"))[0] == []
    (tmp_path / "head.csv").write_text("a;b\n")
    headers, rows = read_csv(spark, str(tmp_path / "head.csv"))
    assert headers == ["a", "b"] and rows.count() == 0


def test_files_of_a_folder_come_in_order(spark, tmp_path):
    for k, n in ((0, 3), (1, 400), (2, 30)):
        (tmp_path / f"part-{k}.csv").write_text("k,v\n" + "".join(f"{k},{i}\n" for i in range(n)))
    headers, rows = read_csv(spark, str(tmp_path))
    assert [(r.row_index, r.k, r.v) for r in rows.orderBy("row_index").collect()] == [(j, str(k), str(i)) for j, (k, i) in enumerate((k, i) for k, n in ((0, 3), (1, 400), (2, 30)) for i in range(n))]


def test_published_findings(profile):
    got = {True: {}, False: {}}
    for r in profile.findings.collect():
        got[r.ambiguous].setdefault((r.type, r.column_key), []).append(",".join(r.row_ids))
    said = {k: {x: " ".join(sorted(rows)) for x, rows in v.items()} for k, v in got.items()}
    assert said[False] == BY_RULE and said[True] == FOR_REVIEW
    resolved, ambiguous = split_findings(profile.findings)
    assert (profile.findings.count(), resolved.count(), ambiguous.count()) == (53, 35, 18)
    assert profile.findings.select("group_key").distinct().count() == 18
    assert profile.findings.select("issue_id").distinct().count() == 53


def test_published_columns_and_repairs(profile):
    columns = {r.column_key: r for r in profile.stats.columns.collect()}
    kinds = {k: c.inferred_type for k, c in columns.items()}
    assert kinds == {"customer_id": "number", "full_name": "string", "email": "email", "phone": "phone", "signup_date": "date", "country": "string", "revenue": "number", "status": "string"}
    assert columns["revenue"].null_count == 4 and columns["phone"].majority_shape == "(DDD) DDD-DDDD"
    made = {(r.column_key, r.row_ids[0]): r for r in profile.findings.filter("not ambiguous and column_key is not null").collect()}
    assert made["phone", "r-03"].proposed_value == "(555) 010-4411" and made["phone", "r-05"].proposed_value == "(555) 010-7788"
    assert made["signup_date", "r-14"].proposed_value == "2024-06-15" and made["signup_date", "r-03"].confidence < 0.7
    assert made["country", "r-02"].proposed_value == "Mexico" and made["country", "r-29"].proposed_value == "Brazil"
    assert [made["revenue", r].proposed_value for r in ("r-23", "r-16", "r-31")] == ["2050.00", "4120.00", "1680.50"]


def test_a_clean_table_gives_nothing(spark):
    names = [f"{a} {b}" for a in ("Ada", "Ben", "Cleo", "Dora", "Ezra", "Finn") for b in ("Archer", "Bishop", "Carver", "Dyer", "Falconer")]
    rows = [(f"r-{k}", k, hashlib.sha256(n.encode()).hexdigest()[:14], n, f"{n.lower().replace(' ', '.')}@{hashlib.md5(n.encode()).hexdigest()}.org", f"2024-{k % 12 + 1:02d}-{k % 28 + 1:02d}") for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "row_id string, row_index long, code string, name string, email string, joined string")
    assert profile_dataset(df, ["code", "name", "email", "joined"]).findings.count() == 0


def test_demo_table_has_every_kind_of_row_issue(spark):
    rows = catalog.demo_contacts(spark)
    headers = rows.columns[2:]
    found = detect_rows.detect_row_level(rows, headers, stats.column_stats(rows, headers))
    assert {r.type for r in found.select("type").distinct().collect()} == {"missing_value", "inconsistent_format", "type_mismatch", "outlier", "suspicious_value"}


def test_frozen_statistics_see_new_spellings(spark):
    rows = spark.createDataFrame([(f"r-{k}", k, v) for k, v in enumerate(["Lima", "Oslo", "LIMA", "Oslo", "oslo"])], "row_id string, row_index long, town string")
    first = stats.column_stats(rows, ["town"], Config(stats_rows=2))
    got = detect_rows.detect_row_level(rows, ["town"], first)
    assert {(r.row_ids[0], r.proposed_value) for r in got.collect()} == {("r-2", "Lima"), ("r-4", "Oslo")}
    later = detect_rows.detect_row_level(rows.filter("row_index >= 2"), ["town"], dataclasses.replace(stats.column_stats(rows.limit(2), ["town"]), complete=False))
    assert {r.row_ids[0] for r in later.collect()} == {"r-2", "r-4"}


def test_quantiles_of_any_size(spark):
    draw = [(f"c{k}", float((i * 7919) % 1009 - 300) / (k + 1), i % 5 + 1) for k, n in enumerate((1, 2, 3, 8, 500, 1000)) for i in range(n)]
    got = {(r.column_key, r.share): r.quantile for r in stats.quantiles(spark.createDataFrame(draw, "column_key string, number double, n long"), (0.0, 0.25, 0.75, 1.0)).collect()}
    for k in range(6):
        every = sorted(x for c, x, n in draw if c == f"c{k}" for _ in range(n))
        for share in (0.0, 0.25, 0.75, 1.0):
            at = (len(every) - 1) * share
            lo, hi = every[int(at)], every[min(int(at) + 1, len(every) - 1)]
            assert got[f"c{k}", share] == pytest.approx(lo + (hi - lo) * (at - int(at)))


def test_quantiles_of_ties(spark):
    shares, draw = (0.0, 0.25, 0.5, 0.75, 1.0), []
    # a run of equal numbers, in rows of their own, at every place of the ranks
    for size in (5, 8, 11):
        for begin in range(size):
            for run in range(2, size - begin + 1):
                draw += [(f"{size}-{begin}-{run}", float(begin if begin <= i < begin + run else i) * 1.5, 1) for i in range(size)]
    draw += [("zeros", x, n) for x, n in ((0.0, 2), (-0.0, 3), (7.0, 1), (7.0, 1), (-2.0, 1))]
    got = {(r.column_key, r.share): r.quantile for r in stats.quantiles(spark.createDataFrame(draw, "column_key string, number double, n long").repartition(5), shares).collect()}
    by = {}
    for c, x, n in draw:
        by.setdefault(c, []).extend([x] * n)
    for c, every in by.items():
        every.sort()
        for share in shares:
            at = (len(every) - 1) * share
            lo, hi = every[int(at)], every[min(int(at) + 1, len(every) - 1)]
            assert got[c, share] == pytest.approx(lo + (hi - lo) * (at - int(at))), (c, share)


def test_fences_of_numbers_in_several_spellings(spark):
    cases = {"a": ("1 1.0 1.00 1.000 2 2.0 3 3.0 3.00 9 9.0 9.00", -4.25, 9.75), "b": ("5 5 5 5.0 5.0 5.0 5.00 5.00 5.00 7 8 30", 4.25, 6.25)}
    for values, low, high in cases.values():
        rows = spark.createDataFrame([(f"r-{k}", k, v) for k, v in enumerate(values.split())], "row_id string, row_index long, x string")
        r = stats.column_stats(rows, ["x"]).columns.first()
        assert (r.low, r.high) == (low, high)


def test_fuzzy_block_over_max_block(spark):
    # all share the city's prefix only: names and codes differ in their first letters
    word = lambda k, n: hashlib.sha256(f"{k}-{n}".encode()).hexdigest()[:12]
    rows = [(f"r-{k}", k, f"{word(k, 0)}", "Springfield", word(k, 1)) for k in range(600)]
    rows += [(f"r-{600 + k}", 600 + k, "x" + rows[k][2][1:], "Springfield", "y" + rows[k][4][1:]) for k in range(0, 600, 7)]
    df = spark.createDataFrame(rows, "row_id string, row_index long, name string, city string, code string")
    got = {tuple(r.row_ids) for r in detect_dups.fuzzy_duplicates(df, ["name", "city", "code"], Config(max_block=60)).collect()}
    assert got == {(f"r-{600 + k}", f"r-{k}") for k in range(0, 600, 7)}


def by_pairs(rows, threshold):
    """Every later row's best earlier row, by comparing all pairs."""

    def key(v):
        return "".join(c for c in v.lower() if c.isascii() and c.isalnum())

    def distance(a, b):
        before = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
            before = now
        return before[-1]

    signed = [(r[0], [key(v) for v in r[2:]]) for r in rows]
    out = {}
    for j, (b, y) in enumerate(signed):
        best = (threshold, None)
        for a, x in signed[:j]:
            s, t = "|".join(x), "|".join(y)
            if any(p and p[:3] == q[:3] for p, q in zip(x, y)) and abs(len(s) - len(t)) <= 0.15 * max(len(s), len(t)) + 1e-9:
                score = 1 - distance(s, t) / max(len(s), len(t))
                if score > best[0] or score == best[0] and best[1] is None:
                    best = (score, a)
        if best[1]:
            out[b] = best[1]
    return out


@pytest.mark.parametrize("alphabet, threshold", [("abcdefghijklmnopqrstuvwxyz0123456789", 0.85), ("ab", 0.85), ("abcdef", 0.7), ("abc", 0.6), ("abc", 0.5)])
def test_fuzzy_by_comparing_all_pairs(spark, alphabet, threshold):
    draw = random.Random(len(alphabet))
    word = lambda: "".join(draw.choice(alphabet) for _ in range(draw.choice((0, 1, 2, 4, 9, 15))))
    rows = []
    for k in range(150):
        cells = [word(), word(), word()]
        if rows and draw.random() < 0.5:
            cells = list(draw.choice(rows)[2:])
            c = draw.randrange(3)
            at = draw.randrange(len(cells[c]) + 1)
            cells[c] = cells[c][:at] + draw.choice(("", "x", " ", "É")) + cells[c][at + draw.randrange(2) :]
        if tuple(cells) not in {tuple(r[2:]) for r in rows}:
            rows.append((f"r-{k}", k, *cells))
    df = spark.createDataFrame(rows, "row_id string, row_index long, a string, b string, c string")
    got = {r.row_ids[0]: r.row_ids[1] for r in detect_dups.fuzzy_duplicates(df, ["a", "b", "c"], Config(fuzzy_threshold=threshold, max_block=40)).collect()}
    plain = [(r[0], r[1], *[c.replace("É", "e") for c in r[2:]]) for r in rows]
    if threshold == 0.85:
        assert got == by_pairs(plain, threshold)
    else:
        # the length rule of the brute force is that of 0.85 only
        assert got.keys() >= by_pairs(plain, threshold).keys()


def test_rare_grams_need_more_edits_than_allowed():
    draw = random.Random(3)
    for threshold in (0.6, 0.75, 0.85, 0.95):
        budget = similar.Budget(threshold)
        for n in (*range(1, 30), 77, 150):
            grams = similar._grams("".join(draw.choice("ab1|") for _ in range(n)), budget.q)
            rank = np.arange(len(similar.ALPHABET) ** budget.q)
            places = similar.rare_places(grams, rank, budget.most(n), budget.q)
            if n > budget.short() and budget.most(n):
                assert similar._destroyed(places, budget.q) > budget.most(n)


def test_apply(spark):
    rows = spark.createDataFrame([("r-1", 0, "Ana", "N/A"), ("r-2", 1, "Bo", "5")], "row_id string, row_index long, name string, revenue string")
    made = spark.createDataFrame([("s1", "set_value", "r-1", "revenue", None), ("s2", "delete_row", "r-2", None, None), ("s3", "normalize_value", "r-1", "name", "Ana"), ("s4", "set_value", "r-9", "name", "x"), ("s5", "no_action", "r-1", "name", None)], "suggestion_id string, action string, row_id string, column_key string, proposed_value string").withColumn("source", F.lit("rule"))
    said = spark.createDataFrame([("s1", "accepted", None, 1), ("s1", "rejected", None, 2), ("s2", "accepted", None, 3), ("s3", "accepted", None, 4), ("s4", "accepted", None, 5), ("s5", "accepted", None, 6), ("zz", "accepted", None, 7)], "suggestion_id string, status string, final_value string, decision_seq int")
    planned = apply.plan_changes(said, made, rows, ["name", "revenue"])
    assert {r.suggestion_id: r.change_kind for r in planned.collect()} == {"s1": "cell", "s2": "delete", "s3": None, "s5": None}
    assert tuple(apply.summarise(planned).first()) == (1, 1, 2, 4)
    out = {r.row_id: r for r in apply.write_back(rows, ["name", "revenue"], planned).collect()}
    assert (out["r-1"].revenue, out["r-1"].dirty, out["r-1"].deleted) == ("", True, False)
    assert (out["r-2"].revenue, out["r-2"].deleted) == ("5", True)
    log = {r.suggestion_id: r for r in apply.audit(planned, rows, ["name", "revenue"]).collect()}
    assert log["s2"].before_state == {"name": "Bo", "revenue": "5"} and log["s1"].after_state == {"revenue": ""} and log["s3"].before_state is None


def test_apply_moves_once(spark):
    """Decisions meet suggestions, and the table meets both, once, however many results are made of them; a plan knows the rows that it deletes."""
    rows = spark.createDataFrame([("r-1", 0, "Ana", None), ("r-1", 1, "Eva", "7"), ("r-2", 2, None, "5")], "row_id string, row_index long, name string, revenue string")
    made = spark.createDataFrame([("s1", "set_value", "r-2", "revenue", "6"), ("s2", "delete_row", "r-2", None, None), ("s3", "set_value", "r-2", "name", None), ("s4", "set_value", "r-1", "absent", "x"), ("s5", "set_value", "r-2", "revenue", "8")], "suggestion_id string, action string, row_id string, column_key string, proposed_value string").withColumn("source", F.lit("rule"))
    said = spark.createDataFrame([(f"s{k}", "accepted", None, 10 - k) for k in range(1, 6)], "suggestion_id string, status string, final_value string, decision_seq int")
    planned = apply.plan_changes(said, made, rows, ["name", "revenue"])
    assert {r.suggestion_id: (r.change_kind, r.before, r.after) for r in planned.collect()} == {"s1": ("cell", "5", "6"), "s2": ("delete", None, None), "s3": (None, None, None), "s4": ("cell", "", "x"), "s5": ("cell", "5", "8")}
    done = apply.write_back(rows, ["name", "revenue"], planned)
    assert sorted(tuple(r) for r in done.fillna("").collect()) == [("r-1", 0, "Ana", "", True, False), ("r-1", 1, "Eva", "7", True, False), ("r-2", 2, "", "5", False, True)]
    edits = apply.write_back(rows, ["name", "revenue"], planned.filter("change_kind = 'cell'"))
    assert {(r.row_index, r.revenue) for r in edits.collect()} == {(0, None), (1, "7"), (2, "6")}
    states = {r.suggestion_id: (r.before_state, r.after_state) for r in apply.audit(planned).collect()}
    assert states["s2"] == ({"name": "", "revenue": "5"}, None) and states["s5"] == ({"revenue": "5"}, {"revenue": "8"}) and states["s3"] == (None, None)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert [plan(df).count("min_by(") for df in (planned, done)] == [1, 1]
    assert [plan(df).count("Join ") for df in (planned, done, apply.audit(planned))] == [2, 3, 2]


def test_trace_meets_rows_once(spark):
    """Findings of one row keep their columns where they meet it; those of several, or of none that exists, come out as before."""
    rows = spark.createDataFrame([("r-1", 0), ("r-2", 1), ("r-3", 7)], "row_id string, row_index long")
    found = spark.createDataFrame([("i1", ["r-2"], False), ("i2", ["r-3", "r-1"], True), ("i3", ["r-9"], True), ("i4", [], True), ("i5", ["r-9", "r-3"], True)], "issue_id string, row_ids array<string>, ambiguous boolean")
    found = found.select("*", *[F.lit(c).alias(c) for c in ("type", "severity", "column_key", "evidence", "detected_by")])
    made = spark.createDataFrame([("s1", "i1", "set_value", "rule", 0.9, "x")], "suggestion_id string, issue_id string, action string, source string, confidence double, proposed_value string")
    audited = spark.createDataFrame([("s1", "accepted", {"a": "1"}, {"a": "x"}, 1), ("s1", "rejected", {"a": "1"}, {"a": "x"}, 2)], "suggestion_id string, review_status string, before_state map<string,string>, after_state map<string,string>, decision_seq int")
    traced = report.trace(found, made, audited, rows)
    assert {r.issue_id: (r.row_numbers, r.review_status) for r in traced.collect()} == {"i1": ([2], "rejected"), "i2": ([8, 1], None), "i3": ([], None), "i4": ([], None), "i5": ([8], None)}
    joins = [line for line in traced._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in line]
    # single rows' findings are not joined with themselves
    assert sum("issue_id" in j and "Join LeftOuter" in j for j in joins) == 2 and sum("_rid" in j and "Join LeftOuter" in j for j in joins) == 1


def test_small_tables_are_made_by_spark(spark):
    """Neither the types of issues nor row numbers come from rows of the driver, which would start Python workers; a decision list keeps columns without a join with what it is made of."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    made = spark.range(50).select(F.concat(F.lit("s"), "id").alias("suggestion_id"), F.lit("edited").alias("status"), F.lit("v").alias("final_value"), F.lit("p").alias("proposed_value"), F.col("id").alias("row"), F.lit("outlier").alias("type"))
    told = review.decision_list(made.repartition(7), "row")
    assert [r.suggestion_id for r in told.orderBy("decision_seq").collect()] == sorted(f"s{k}" for k in range(50)) and [r.decision_seq for r in told.orderBy("decision_seq").collect()] == list(range(1, 51))
    assert all(r.suggestion_id == f"s{r.row}" for r in told.collect())
    counted = report.issue_counts(made)
    assert {r.type: r.issues for r in counted.collect() if r.issues} == {"outlier": 50} and counted.count() == 7
    assert "LogicalRDD" not in plan(told) + plan(counted)


def test_decisions(spark):
    events = spark.createDataFrame([("a", "accepted", None, 1, 1), ("a", "rejected", None, 2, 2), ("b", "edited", "x", 2, 3)], "suggestion_id string, status string, final_value string, batch int, seq int")
    assert {(r.suggestion_id, r.status) for r in review.current_decisions(events).collect()} == {("a", "rejected"), ("b", "edited")}
    assert {(r.suggestion_id, r.status) for r in review.current_decisions(review.undo(events)).collect()} == {("a", "accepted")}


def test_publish(spark, contacts, tmp_path):
    headers, rows = contacts
    planned = spark.createDataFrame([], "suggestion_id string, row_id string, column_key string, action string, source string, status string, final_value string, decision_seq int, change_kind string, before string, after string")
    ready = apply.write_back(rows.repartition(4), headers, planned)
    path = publish(spark, str(tmp_path), "My Data.csv", ready, headers, apply.audit(planned, rows, headers), "d")
    assert slug("My Data.csv") == "my-data" and (tmp_path / path.rsplit("/", 1)[1] / "_PUBLISHED").exists()
    again, back = read_csv(spark, f"{path}/cleaned.csv")
    assert again == headers and [tuple(r) for r in back.orderBy("row_index").collect()] == [tuple(r) for r in rows.orderBy("row_index").collect()]


def outside(fails_on=None):
    """A reviewer that answers all but missing values and fails on prompts that hold a word; local, so it is sent by value."""

    class Outside:
        def __init__(self, word):
            self.fails_on = word

        def review(self, prompt, batch):
            if self.fails_on and self.fails_on in prompt:
                raise TimeoutError("no answer")
            told = [{"candidateId": c["candidate_id"], "rowId": c["rows"][0]["row_id"], "action": "no_action", "confidence": 0.5, "rationale": "seen"} for c in batch if c["type"] != "missing_value"]
            return {"verdicts": [*told, {"candidateId": "stranger", "rowId": "r-1", "action": "no_action", "confidence": 1, "rationale": ""}]}

    return Outside(fails_on)


@pytest.fixture(scope="module")
def asked(contacts, profile):
    headers, rows = contacts
    return enrich.candidates(enrich.work_queue(profile.findings, None), rows, headers).cache()


def test_candidates_of_one_row_and_of_several(spark):
    """Rows come in the finding's order, missing ones are left out; only rows that are asked about get keys."""
    rows = spark.createDataFrame([(f"r{i}", i, f"Nam\u00e9 {i}", None if i % 2 else f"{i}-x") for i in range(6)], "row_id string, row_index long, name string, `a.b` string")
    found = spark.createDataFrame([("i1", "type_mismatch", "a.b", ["r3"]), ("i2", "missing_value", "a.b", ["r3"]), ("i3", "fuzzy_duplicate", None, ["r4", "r2"]), ("i4", "fuzzy_duplicate", None, ["r9", "r5"]), ("i5", "missing_value", "name", ["r9"]), ("i6", "suspicious_value", "name", ["r0"]), ("i7", "suspicious_value", "name", [])], "issue_id string, type string, column_key string, row_ids array<string>")
    queue = enrich.work_queue(found.withColumns({"ambiguous": F.lit(True), "evidence": F.lit("why"), "group_key": F.col("type")}), None)
    out = enrich.candidates(queue, rows, ["name", "a.b"])
    got = {r.candidate_id: ([x.row_id for x in r.rows], [x.row_index for x in r.rows], r.rows[0].data, r.rows[0].signature, r.current_value, r.column_key) for r in out.collect()}
    assert got == {
        "i1": (["r3"], [3], {"name": "Nam\u00e9 3", "a.b": ""}, "name3|", "", "a.b"),
        "i2": (["r3"], [3], {"name": "Nam\u00e9 3", "a.b": ""}, "name3|", "", "a.b"),
        "i3": (["r4", "r2"], [4, 2], {"name": "Nam\u00e9 4", "a.b": "4-x"}, "name4|4x", None, None),
        "i4": (["r5"], [5], {"name": "Nam\u00e9 5", "a.b": ""}, "name5|", None, None),
        "i6": (["r0"], [0], {"name": "Nam\u00e9 0", "a.b": "0-x"}, "name0|0x", "Nam\u00e9 0", "name"),
    }
    # a tree's lines go down: what is made of rows stands over the joins, and none but the two joins with rows
    below, depth = [], None
    for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        if depth is None and "Join" in line:
            depth = at
        elif depth is not None:
            below.append(line)
    assert below and not any("translate(" in x or "Join" in x for x in below)


def test_outside_reviewer(asked):
    clean = enrich.sanitise(enrich.reviewed_by(asked, outside(), "context"), asked)
    assert clean.count() == 15
    cards = enrich.cards(asked, clean)
    assert cards.count() == 18 and cards.filter("confidence = 0.3").count() == 3


def test_built_in_reviewer_stands_in_for_failed_batches(asked):
    told = enrich.reviewed_by(asked.coalesce(1), outside(fails_on="r-39"), "context", size=1).collect()
    degraded = [r for r in told if r.degraded_from]
    assert [r.degraded_from for r in degraded] == ["TimeoutError: no answer"] and degraded[0].action == "delete_row" and degraded[0].row_id == "r-39"
    assert len(told) == 15 and all(r.rationale == "seen" for r in told if not r.degraded_from)
    every = enrich.reviewed_by(asked, outside(fails_on="context"), "context")
    assert every.count() == 18 and every.filter("degraded_from is null").count() == 0


def test_a_reviewer_is_chosen_by_settings(asked):
    makers = {"outside": enrich.Maker(lambda s: outside(s["REVIEWER_KEY"]), ("REVIEWER_KEY",))}
    assert enrich.choose_reviewer({}, makers) is None and enrich.choose_reviewer({"REVIEWER": "outside"}, makers) is None and enrich.choose_reviewer({"REVIEWER": "x", "REVIEWER_KEY": "k"}, makers) is None
    assert enrich.choose_reviewer({"REVIEWER": "outside", "REVIEWER_KEY": "k"}, makers).fails_on == "k"
    assert enrich.verdicts_of(asked, None).count() == 18


def test_published_scores_of_the_built_in_reviewer(spark, asked):
    specs = spark.createDataFrame([(k, *a) for k, a in enumerate(ANSWERS)], "seq int, column_key string, row_id string, action string, proposed_value string")
    truth = evaluate.truth_for(asked.withColumn("row_id", F.col("rows")[0]["row_id"]), specs)
    told = enrich.sanitise(enrich.verdicts_of(asked, None), asked).withColumn("model", F.lit("builtin"))
    r = evaluate.score(truth, told).first()
    assert (r.total, r.answered, r.effective_correct, r.value_expected, r.value_correct, r.noop_merges) == (18, 18, 10, 6, 3, 0)
    assert (round(r.confidence_right, 2), round(r.confidence_wrong, 2)) == (0.72, 0.52)
    assert {x.type: (x.correct, x.total) for x in evaluate.score_by_type(truth, told).collect()} == {"missing_value": (2, 3), "type_mismatch": (1, 4), "suspicious_value": (3, 5), "fuzzy_duplicate": (4, 6)}


def test_prompts_carry_all_that_a_verdict_needs(profile, asked):
    context = enrich.column_context(profile.stats.columns.orderBy("position").collect(), 40)
    assert context.splitlines()[0].startswith("A table of 40 rows") and len(context.splitlines()) == 9 and "Ana María Torres" in context
    batch = [r.asDict(recursive=True) for r in asked.filter("type = 'fuzzy_duplicate'").collect()]
    text = enrich.prompt(context, batch)
    assert f"{len(batch)} open questions" in text and all(c["candidate_id"] in text and c["rows"][1]["row_id"] in text for c in batch) and '"column"' in context and '"column"' not in enrich.render(batch)


def test_usage_of_all_calls(asked):
    class Counting:
        provider, model = "p", "m"

        def __init__(self):
            self.seen = 0

        def review(self, prompt, batch):
            self.seen += 1
            if batch[0]["type"] == "missing_value":
                raise TimeoutError("gone")
            if self.seen == 1:
                error = OSError("busy")
                error.status = 429
                raise error
            return [], enrich.Usage("p", "m", 7 * len(batch), 0, 2)

    review = enrich.reviewed(asked.coalesce(1), Counting(), "", size=1)
    calls = review.calls.collect()
    failed = asked.filter("type = 'missing_value'").count()
    assert len(calls) == 18 and sum(c.tries for c in calls) == 19 and sum(c.asked for c in calls) == 18
    assert sum(c.failed == "TimeoutError: gone" for c in calls) == failed and review.verdicts.count() == failed
    assert report.record_usage(review.calls).count() == 18 - failed
    total = report.usage_summary(review.calls).first()
    assert (total.calls, total.failed_calls, total.input_tokens, total.cached_tokens) == (18, failed, 7 * (18 - failed), 2 * (18 - failed))
    cards = enrich.cards(asked, enrich.sanitise(review.verdicts, asked)).collect()
    assert len(cards) == 18 and sum(c.degraded_from == "TimeoutError: gone" for c in cards) == failed


def test_a_review_goes_on_where_it_stopped(asked, tmp_path):
    ledger = f"{tmp_path}/ledger"
    first = enrich.resumed(asked, outside(), ledger)
    assert first.calls.count() > 0 and first.verdicts.count() == 15
    again = enrich.resumed(asked.repartition(3), outside(fails_on="open questions"), ledger)
    assert again.calls.count() == 0 and again.verdicts.count() == 15
    one = asked.agg(F.min("candidate_id")).first()[0]
    edited = asked.withColumn("evidence", F.when(F.col("candidate_id") == one, "seen anew").otherwise(F.col("evidence")))
    broken = enrich.resumed(edited, outside(fails_on="seen anew"), ledger)
    assert [c.asked for c in broken.calls.collect()] == [1] and broken.verdicts.filter("degraded_from IS NOT NULL").count() == 1
    assert enrich.resumed(edited, outside(), ledger).calls.agg(F.sum("asked")).first()[0] == 1 and enrich.resumed(edited, outside(), ledger).calls.count() == 0


def test_requests_and_names_are_checked(spark):
    said = spark.createDataFrame([("a", "accepted"), ("b", "rejected")], "suggestion_id string, status string")
    assert apply.check_request(said).count() == 2
    with pytest.raises(ValueError, match="at most 1"):
        apply.check_request(said, most=1)
    with pytest.raises(ValueError, match="other than"):
        apply.check_request(said.unionByName(spark.createDataFrame([("c", None)], said.schema)))
    odd = spark.createDataFrame([("outlier", "high", "no_action"), ("outlier", "odd", "burn"), (None, "low", None)], "type string, severity string, action string")
    assert [r.misnamed for r in review.misnamed(odd).collect()] == [["severity", "action"]]


def test_statistics_after_every_batch(spark, contacts, tmp_path, monkeypatch):
    monkeypatch.setattr(statistics, "COMPACT", 2)
    headers, rows = contacts
    for k in range(5):
        rows.filter(F.col("row_index") % 5 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    statistics.count_stream(arriving, headers, f"{tmp_path}/counts", f"{tmp_path}/state").awaitTermination()
    files = sorted((p.stat().st_mtime_ns, str(p)) for p in (tmp_path / "in").glob("*.parquet"))
    plain = lambda s: (sorted(map(str, s.columns.collect())), sorted(map(str, s.spellings.collect())))
    for upto in (0, 2, 4):
        so_far = spark.read.schema(rows.schema).parquet(*[f for _, f in files[: upto + 1]])
        assert plain(statistics.stats_so_far(spark, f"{tmp_path}/counts", headers, upto=upto)) == plain(stats.column_stats(so_far, headers))
    assert {p.name for p in (tmp_path / "counts" / "merged").iterdir() if p.is_dir()} == {"batch=1", "batch=3"}


def test_retry_and_json():
    class Busy(Exception):
        status = 429

    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise Busy
        return "ok"

    assert enrich.with_retry(call, sleep=lambda s: None) == "ok" and len(tries) == 3
    with pytest.raises(ValueError):
        enrich.with_retry(lambda: int("x"), sleep=lambda s: None)
    assert enrich.recover_json('```json\n{"a": 1}\n```') == {"a": 1} and enrich.recover_json('so: {"a": 2} there') == {"a": 2} and enrich.recover_json("no") is None


def test_far_pairs_are_dropped_early():
    """First letters rule out no pair within its edits, and most of the others."""
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab0|") for _ in range(draw.choice([1, 5, 40, 63, 64, 65, 90, 130]))) for _ in range(60)]
    texts += ["".join(c if draw.random() > 0.1 else draw.choice(["", "a", "b0"]) for c in t) for t in texts]
    rows = similar.Rows(texts, similar.Budget(0.85), 3)
    i, j = np.triu_indices(len(texts), 1)
    most = np.maximum(rows.edits[i], rows.edits[j])
    near = np.flatnonzero(rows.distance(i, j) <= most)
    left = rows.close(i, j, most)
    assert len(near) > 20 and set(near) <= set(left)
    like = (np.minimum(rows.size[i], rows.size[j]) >= 40) & (np.abs(rows.size[i] - rows.size[j]) <= most)
    assert like.sum() > 500 and like[left].sum() < like.sum() / 4
    assert not len(rows.close(i[:0], j[:0], most[:0]))


def test_signatures_move_to_few_tiles():
    """Copies of a signature follow neither the rows of a table nor its small blocks."""
    assert similar.parts_of(900_000, 0, 1000) == (similar.PARTS, similar.PARTS)
    new, parts = similar.parts_of(15_000, 900_000, 1000)
    assert new == 1 and parts <= similar.PARTS + 2
    assert similar.parts_of(100, 0, 40) == (3, 3) and similar.parts_of(0, 0, 40) == (0, 0)
    new, parts = similar.parts_of(30_000_000, 0, 1000)
    assert 30_000_000 / parts <= similar.PART_ROWS


@pytest.mark.parametrize("threshold, alphabet", [(0.5, "ab"), (0.7, "ab01|"), (0.85, "abcdefgh0123|"), (0.85, "a0|"), (0.95, "ab")])
def test_pieces_rule_out_no_similar_pair(threshold, alphabet, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 48)
    monkeypatch.setattr(similar, "PAIRS", 64)
    draw, budget = random.Random(alphabet), similar.Budget(threshold)
    texts = ["a" + "".join(draw.choice(alphabet) for _ in range(draw.choice([0, 1, 2, 5, 40, 63, 64, 65, 90, 130, 300]))) for _ in range(40)]
    texts += ["".join(c if draw.random() > 0.08 else draw.choice(["", draw.choice(alphabet), "b0"]) for c in t) for t in texts * 3]
    texts = list(dict.fromkeys(t for t in texts if t.strip("|")))
    rows = similar.Rows(texts, budget, 1)
    i, j = rows.alike(*np.triu_indices(len(texts), 1))
    edits = rows.distance(i, j)
    near = edits <= np.maximum(rows.edits[i], rows.edits[j])
    want = {(a, b, 1 - e / max(len(texts[a]), len(texts[b]))) for a, b, e in zip(i[near].tolist(), j[near].tolist(), edits[near].tolist())}
    got = lambda side: list(zip(*similar.compare_parts(pa.table({"id": np.arange(len(texts)), "sig": texts, "side": side}), budget, 1).to_pydict().values()))
    assert len(want) > 15 and sorted(got(np.full(len(texts), 2))) == sorted(want)
    half = len(texts) // 3
    assert sorted(got((np.arange(len(texts)) >= half).astype(int))) == sorted(x for x in want if x[0] < half <= x[1])


@pytest.mark.parametrize("cheaper", [0, 10**9])
def test_rare_grams_and_one_list_agree(spark, monkeypatch, cheaper):
    monkeypatch.setattr(similar, "CHEAPER", cheaper)
    draw = random.Random(8)
    texts = [f"{draw.randrange(10**9)}|user{draw.randrange(10**5)}|town" for _ in range(150)]
    texts = list(dict.fromkeys(texts + [t.replace(draw.choice("0123456789"), draw.choice("0123456789")) for t in texts]))
    signed = spark.createDataFrame(list(enumerate(texts)), "id long, sig string")
    rows = similar.Rows(texts, similar.Budget(0.85), 3)
    i, j = rows.alike(*np.triu_indices(len(texts), 1))
    near = rows.distance(i, j) <= np.maximum(rows.edits[i], rows.edits[j])
    found = [(r.a, r.b) for r in similar.similar_pairs(signed, 0.85, 3, 50).collect()]
    assert near.sum() > 20 and sorted(found) == sorted(zip(i[near].tolist(), j[near].tolist()))
