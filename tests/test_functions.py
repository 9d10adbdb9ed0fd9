from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, text, types


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first().r


def many(spark, make, cases):
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, v string").select("i", make(F.col("v")).alias("r")).orderBy("i").collect()
    return {v: r.r for v, r in zip(cases, rows)}


def test_missing(spark):
    assert all(many(spark, text.is_missing, ["", "  ", "N/A", "-", "unknown", "NULL", "?", " "]).values())
    assert not any(many(spark, text.is_missing, ["0", "false", "none of the above", "na-me"]).values())


def test_keys_and_shapes(spark):
    got = many(spark, text.normalize_key, ["Zoë Brontë-Vâlcea", "zoe bronte valcea", "D'Arcy", "DArcy", "Ñandú Çelik"])
    assert got["Zoë Brontë-Vâlcea"] == got["zoe bronte valcea"] and got["D'Arcy"] == got["DArcy"] and got["Ñandú Çelik"] == "nanducelik"
    assert one(spark, "(312) 555-0188", text.shape_of) == "(DDD) DDD-DDDD"
    assert one(spark, "3125550188", lambda v: text.apply_shape(F.lit("(DDD) DDD-DDDD"), v)) == "(312) 555-0188"
    assert one(spark, "312555", lambda v: text.apply_shape(F.lit("(DDD) DDD-DDDD"), v)) is None


def test_numbers(spark):
    got = many(spark, numbers.parse_number, ["73.25", "9,815.75", "602,10", "CHF 88.40", "-31.5", "7,125", "xyz", "", "LOT-77", "NO 12", "8,765,432", "4.5.6", "."])
    assert list(got.values()) == [73.25, 9815.75, 602.1, 88.4, -31.5, 7.125, None, None, None, None, None, None, None]
    plain = many(spark, numbers.canonical_number, ["CHF 88.40", "602,10", "9,815.75", "LOT-77"])
    assert list(plain.values()) == ["88.40", "602.10", "9815.75", None]


def test_dates(spark):
    got = many(spark, dates.parse_date, ["2019-11-03", "03/11/2019", "04/25/2019", "08/08/2019", "2019-02-29", "30.11.2018", "x", "45/45/2019"])
    assert [r and (r.iso, r.ambiguous) for r in got.values()] == [("2019-11-03", False), ("2019-11-03", True), ("2019-04-25", False), ("2019-08-08", False), None, ("2018-11-30", False), None, None]


def test_types(spark):
    got = many(spark, types.classify_value, ["q@w.io", "2019-11-03", "Yes", "0", "3125550188", "(312) 555-0188", "plain"])
    assert list(got.values()) == ["email", "date", "boolean", "number", "number", "phone", "string"]
    assert one(spark, "3125550188", lambda v: types.matches_type(v, F.lit("phone")))


def test_similarity_and_repair(spark):
    assert one(spark, "", lambda v: text.similarity(v, v)) == 1.0
    assert one(spark, "kitten", lambda v: F.round(text.similarity(v, F.lit("sitting")), 4)) == 0.5714
    assert one(spark, "kitten", lambda v: text.similar(v, F.lit("sitting"), 0.85)) is None
    got = many(spark, text.repair_email, ["mia@post,org", "jon@post", "x", "u@v.w"])
    assert list(got.values()) == ["mia@post.org", "jon@post.com", None, None]


def test_dates_step_by_step(spark):
    """The staged reading of dates equals the expression, on texts near every border."""
    from tidemark.functions.dates import trimmed_date, with_date, with_dated

    years, small = ("0024", "0999", "1000", "1900", "2000", "2023", "2024", "9999"), ("0", "1", "2", "02", "04", "12", "13", "28", "29", "30", "31", "32", "99")
    texts = [f"{y}-{m}-{d}" for y in years for m in small for d in small]
    texts += [f"{a}{x}{b}{z}{y}" for y in years for a in small for b in small for x, z in (("/", "/"), (".", "-"))]
    texts += ["", "2024-02-29\x85", "29/02/2024\x85", "2024-2-29", "1/1/24", "x2024-01-01", "2024-01-01x", "12345", "٢٠٢٤-٠١-٠١"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    read = with_dated(with_date(df, "t", "date"), "t", "dated", F.lit(True)).select("t", "date", "dated", trimmed_date(F.col("t")).alias("by_hand")).collect()
    assert all(r.date == r.by_hand and r.dated == (True if r.by_hand else None) for r in read)
    assert sum(r.date is not None for r in read) > 500


def test_trim_and_shape(spark):
    """Both look at every sign on its own; a text's end is no line end, which a pattern would also find before its last sign."""
    signs = [chr(c) for c in [*range(1, 0x300), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), 0x3000, 0xFEFF, 0x1F600]]
    white = set("\t\n\x0b\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff") | {chr(c) for c in range(0x2000, 0x200B)}
    texts = [("a \x85", "a \x85", "A \x85"), ("", "", ""), (" \u2003 ", "", ""), *[(f" {s}D{s}7{s}\t", f"D{s}7" if s in white else f"{s}D{s}7{s}", None) for s in signs]]
    letter = lambda s: s.isascii() and s.isalpha() or "\u00c0" <= s <= "\u024f"
    shape = lambda t: "".join("A" if letter(s) else "D" if s in "0123456789" else s for s in t)
    got = spark.createDataFrame([(k, v) for k, (v, *_) in enumerate(texts)], "k int, v string").select("k", text.trim(F.col("v")).alias("t"), text.shape_of(F.col("v")).alias("s"))
    for k, t, s in got.collect():
        assert t == texts[k][1] and s == shape(t)
    # no pattern: signs are looked up
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
