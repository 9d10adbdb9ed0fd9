"""Source divergence audit: how far the word use of a language's sources lies apart.

Each language keeps the terms that at least MIN_DOCS of its documents hold. A
source (and the language as a whole) gives each kept term a smoothed share

    p = 1 + (SCALE * (count + 1)) div (N + V)

of its N kept occurrences, V kept terms. The divergence of share p from share q is
(p - q)^2 div q. Part `pair` sums it over all kept terms for each ordered pair of a
language's sources; part `term` lists the terms that a source uses more than its
language does, the highest TOP of them.

Terms are counted in tasks and merged by Spark; each kept term is then one row
with its counts by place of the source (`entries`, the places that have any).
Higher-order functions turn the row into contributions to the pairs of sources,
which are summed on the map side before they move. A term adds nothing beyond a
constant to pairs of sources that both lack it, so only pairs with a source that
has it are emitted and counted; the constant is added at the end as often as the
pair was not emitted.

All arithmetic is exact in 64-bit integers while a language has under 2.8e14 term
occurrences; beyond that Spark's ANSI mode raises.

Odd tables: null text, lang and source count as ""; rows of equal ids are documents
of their own; a source without any term has N = 0; a language without a kept term
gets value 0 for all its pairs and no terms; an empty table gives no rows. Texts of
any length are cut whole. Further columns are not read. Ties rank by item, in UTF-8
order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tidy
from .terms import byte_table, count, slices

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Parts in which the highest terms of a source are found first, so no source's terms meet in one task.
SPREAD = 32
LETTERS = byte_table(digits=False)
_COUNTS = "lang string, s int, term string, n long, docs long"
# SCALE * count div size in two steps of long division, so the product stays in 64 bits
_FIRST, _SECOND = 31_250, 32_000


def _share(times: str, size: str) -> str:
    a = f"(({times}) + 1) * {_FIRST}L"
    return f"(1L + ({a} div ({size})) * {_SECOND}L + (({a} % ({size})) * {_SECOND}L) div ({size}))"


def _far(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def source_places(docs: DataFrame) -> DataFrame:
    """lang, source and s: each language's sources numbered from 0. A language's numbers meet in one task; its pairs are as many squared."""
    order = Window.partitionBy("lang").orderBy("source")
    return docs.select("lang", "source").distinct().withColumn("s", F.row_number().over(order) - 1)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, s, term, n (occurrences) and docs (documents) from docs of lang, s and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                found = count(texts, LETTERS)
                lang = part.column("lang").dictionary_encode()
                group = lang.indices.to_numpy().astype(np.int64) << 32 | part.column("s").to_numpy()
                groups, of = np.unique(group, return_inverse=True)
                key, at, docs_with = np.unique(found.code * len(groups) + of[found.doc], return_inverse=True, return_counts=True)
                times = np.bincount(at, weights=found.n, minlength=len(key)).astype(np.int64)
                of_key = groups[key % len(groups)]
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(of_key >> 32)), pa.array((of_key & 0xFFFFFFFF).astype(np.int32)), found.terms.take(pa.array(key // len(groups))).cast(pa.string()), pa.array(times), pa.array(docs_with)],
                    names=["lang", "s", "term", "n", "docs"],
                )

    told = docs.mapInArrow(run, _COUNTS)
    return told.groupBy("lang", "s", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def wide_terms(counts: DataFrame) -> DataFrame:
    """lang, term, entries and total of each kept term; entries: its sources' places and counts, by place."""
    wide = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("s", "n"))).alias("entries"))
    return wide.filter(F.col("docs") >= MIN_DOCS).drop("docs")


def language_totals(wide: DataFrame, places: DataFrame) -> DataFrame:
    """One row a language: v, n (kept occurrences), sizes (n + v by place of source) and base (share of a term that a source lacks, by place)."""
    each = wide.select("lang", F.explode("entries").alias("e")).groupBy("lang", "e.s").agg(F.sum("e.n").alias("n"))
    terms = wide.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n"))
    sized = places.select("lang", "s").join(each, ["lang", "s"], "left").join(terms.select("lang", "v"), "lang")
    arrays = sized.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("s", (F.coalesce("n", F.lit(0)) + F.col("v")).alias("size")))).alias("x")).select("lang", F.col("x.size").alias("sizes"))
    return terms.join(arrays, "lang").withColumn("base", F.expr(f"transform(sizes, d -> {_share('0L', 'd')})"))


def pair_sums(wide: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, i, j and value: divergence of source i from source j over all kept terms of the language."""
    rows = wide.join(totals.select("lang", "sizes", "base"), "lang")
    # shares by place: null where the source lacks the term, then with the constant one there, then that one only
    rows = rows.withColumn("has", F.expr(f"map_from_entries(transform(entries, e -> struct(e.s, {_share('e.n', 'sizes[e.s]')})))"))
    rows = rows.select("lang", "has", "base", F.expr("transform(base, (b, s) -> has[s])").alias("own"))
    rows = rows.select("lang", F.map_entries("has").alias("has"), F.expr("zip_with(own, base, (p, b) -> coalesce(p, b))").alias("every"), F.expr("zip_with(own, base, (p, b) -> CASE WHEN p IS NULL THEN b END)").alias("lack"))
    from_it = f"transform(has, e -> struct(true AS from_it, e.key AS s, transform(every, q -> {_far('e.value', 'q')}) AS far))"
    to_it = f"transform(has, e -> struct(false AS from_it, e.key AS s, transform(lack, p -> {_far('p', 'e.value')}) AS far))"
    told = rows.select("lang", F.explode(F.expr(f"concat({from_it}, {to_it})")).alias("e")).select("lang", "e.from_it", "e.s", F.posexplode("e.far").alias("other", "far"))
    sums = told.filter("far IS NOT NULL AND s <> other").groupBy("lang", "from_it", "s", "other").agg(F.sum("far").alias("far"), F.count(F.lit(1)).alias("times"))
    ends = [F.when(F.col("from_it"), a).otherwise(b).alias(n) for a, b, n in ((F.col("s"), F.col("other"), "i"), (F.col("other"), F.col("s"), "j"))]
    sums = sums.select("lang", *ends, "far", "times").groupBy("lang", "i", "j").agg(F.sum("far").alias("far"), F.sum("times").alias("times"))
    pairs = totals.select("lang", "v", "base", F.posexplode("base").alias("i", "p")).select("lang", "v", "i", "p", F.posexplode("base").alias("j", "q")).filter("i <> j")
    rest = F.expr(f"(v - coalesce(times, 0L)) * {_far('p', 'q')}")
    return pairs.join(sums, ["lang", "i", "j"], "left").select("lang", "i", "j", (F.coalesce("far", F.lit(0)) + rest).alias("value"))


def typical_terms(wide: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """lang, s, item, value and rank: the terms that a source uses more than its language, the `top` highest."""
    rows = wide.join(totals.select("lang", "v", "n", "sizes"), "lang").select("lang", "term", F.explode("entries").alias("e"), "sizes", F.expr(_share("total", "n + v")).alias("q"))
    rows = rows.select("lang", F.col("e.s").alias("s"), F.col("term").alias("item"), F.expr(_share("e.n", "sizes[e.s]")).alias("p"), "q").filter("p > q").select("lang", "s", "item", F.expr(_far("p", "q")).alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    parted = Window.partitionBy("lang", "s", "part").orderBy(*order)
    near = rows.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(SPREAD))).withColumn("rank", F.row_number().over(parted)).filter(F.col("rank") <= top).drop("part", "rank")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "s").orderBy(*order))).filter(F.col("rank") <= top)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank of a table with text, lang and source."""
    spark = docs.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    named = docs.select("text", blank("lang"), blank("source"))
    places = materialise(spark, source_places(named), "places")
    wide = materialise(spark, wide_terms(term_counts(named.join(places, ["lang", "source"]).select("lang", "s", "text"))), "terms")
    totals = materialise(spark, language_totals(wide, places), "totals")
    others = places.select("lang", F.col("s").alias("j"), F.col("source").alias("item"))
    pairs = places.withColumnRenamed("s", "i").join(others, "lang").filter("i <> j").join(pair_sums(wide, totals), ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    terms = typical_terms(wide, totals).join(places, ["lang", "s"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


source_divergence = tidy(audit)

_P = "(1 + (CAST(1000000000 AS HUGEINT) * ({c} + 1)) // ({n} + v))"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 3),
lang_size AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM kept GROUP BY lang),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
counted AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sized AS (SELECT g.lang, g.source, CAST(coalesce(sum(c), 0) AS BIGINT) AS n FROM groups g LEFT JOIN counted USING (lang, source) GROUP BY ALL),
shares AS MATERIALIZED (SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, {_P.format(c="coalesce(c.c, 0)", n="s.n")} AS p, {_P.format(c="k.total", n="z.n")} AS q
  FROM sized s JOIN kept k USING (lang) JOIN lang_size z USING (lang) LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found QUALIFY part = 'pair' OR rank <= 200
"""
