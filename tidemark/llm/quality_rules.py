"""Quality rules: fixed counts, then robust multivariate outliers. DataFrame functions only.

Counts of words, symbols, repeated lines and repeated three-word windows give a
base rule. Beyond it, a vector of transformed statistics is judged against its
language and source: a minimum-covariance-determinant estimate (deterministic
starts, concentration steps, a variance floor as in the regularised estimator)
gives location and scatter, and a document is rejected when its squared
Mahalanobis distance passes a cut.

Statistics are whole numbers on fixed scales, so medians and quantiles are exact
with bounded memory and every sum is exact: results don't depend on partitioning.
Texts are read once; the concentration steps run over a narrow table of counts.

Languages or sources with fewer than `min_rows` documents are pooled per
language, then over all; a pool that is still smaller rejects nothing. Null
language or source is a group of its own. Null and empty texts have no words and
fail the base rule. Repeated rows are judged alike, each kept or not; doc_id may
be null. A distance equal to the cut is kept, and so are all rows at the bin that
bounds a concentration step. An empty table gives an empty result. Very long texts
cost time in proportion to words times the log of them. All input columns but
lang, source, doc_id and text are ignored here.

A three-word window is known by a 64-bit hash of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

#: Vector: scale of each statistic and the standard deviation its variance never falls below.
STATISTICS = {
    "mean_word": ("64 * word_chars / n_words", 24),
    "symbols": ("1024 * sqrt(n_symbols / word_chars)", 64),
    "capitals": ("1024 * sqrt(n_capitals / word_chars)", 64),
    "dup_lines": ("1024 * sqrt(n_dup_lines / n_words)", 96),
    "repeats": ("1024 * sqrt(n_repeat_words / n_words)", 96),
}
NAMES = list(STATISTICS)
P = len(NAMES)
#: Share of a group's rows that an estimate is concentrated on, and the matching consistency factor of its covariance (chi-square, five dimensions).
COVERAGE, CONSISTENCY = 0.75, 1.4121
STEPS = 3
MIN_ROWS = 50
#: Squared distance beyond which a document is an outlier (chi-square, five dimensions, 0.999).
CUT = 20.515
BINS = 65535

_WHITE = r"[\\x20\\x09-\\x0D]"
_POSITION = 20


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_capitals."""
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_w", F.expr(f"array_remove(split(_t, '{_WHITE}+'), '')"))
    df = df.withColumn("_l", F.expr(r"filter(split(_t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    # windows of three words, hashed; the last two zipped rows lack words and go
    df = df.withColumn(
        "_h",
        F.expr("if(n_words < 3, cast(array() as array<bigint>), transform(slice(arrays_zip(_w, slice(_w, 2, greatest(cast(n_words as int), 1)), slice(_w, 3, greatest(cast(n_words as int), 1))), 1, greatest(cast(n_words as int) - 2, 0)), x -> xxhash64(x['_w'], x['1'], x['2'])))"),
    )
    df = df.withColumn("_distinct", F.size(F.array_distinct("_h")))
    # sorted (hash prefix, position) in one long each
    df = df.withColumn("_p", F.expr(f"if(_distinct = size(_h), cast(array() as array<bigint>), sort_array(transform(_h, (h, i) -> (h & {-(1 << _POSITION)}L) | i)))"))
    df = df.withColumn("_exact", F.expr(f"_distinct = size(_h) or (size(_h) < {1 << _POSITION} and size(array_distinct(transform(_p, p -> shiftright(p, {_POSITION})))) = _distinct)"))
    df = df.withColumn("_s", F.expr("if(_exact, cast(array() as array<struct<h: bigint, i: int>>), sort_array(transform(_h, (h, i) -> struct(h as h, i as i))))"))
    mask = (1 << _POSITION) - 1
    df = df.withColumn(
        "_f",
        F.expr(
            f"if(_exact, transform(filter(arrays_zip(_p, concat(array(cast(null as bigint)), _p), concat(slice(_p, 2, greatest(size(_p), 1)), array(cast(null as bigint)))), x -> (x['_p'] is not null) and (coalesce(shiftright(x['_p'], {_POSITION}) = shiftright(x['1'], {_POSITION}), false) or coalesce(shiftright(x['_p'], {_POSITION}) = shiftright(x['2'], {_POSITION}), false))), x -> cast(x['_p'] & {mask}L as int)), "
            # where a hash prefix is shared or positions don't fit: the same with sorted structs
            "transform(filter(arrays_zip(_s, concat(array(cast(null as struct<h: bigint, i: int>)), _s), concat(slice(_s, 2, greatest(size(_s), 1)), array(cast(null as struct<h: bigint, i: int>)))), x -> x['_s'] is not null and (coalesce(x['_s'].h = x['1'].h, false) or coalesce(x['_s'].h = x['2'].h, false))), x -> x['_s'].i))"
        ),
    )
    return df.withColumns(
        {
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.expr("cast(regexp_count(_t, '[#*$%&|<>]') as bigint)"),
            "n_capitals": F.expr("cast(length(regexp_replace(_t, '[^A-Z]+', '')) as bigint)"),
            "n_dup_lines": F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)"),
            "n_repeat_words": F.expr("cast(size(array_distinct(concat(_f, transform(_f, x -> x + 1), transform(_f, x -> x + 2)))) as bigint)"),
        }
    ).drop("_t", "_w", "_l", "_h", "_distinct", "_p", "_exact", "_s", "_f")


def _failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def _squared_distance(df: DataFrame) -> DataFrame:
    """d2 from x - m through forward substitution with the Cholesky factor l."""
    for i, name in enumerate(NAMES):
        left = "".join(f" - l{i}{j} * y{j}" for j in range(i))
        df = df.withColumn(f"y{i}", F.expr(f"(x_{name} - m{i}{left}) / l{i}{i}"))
    return df.withColumn("d2", F.expr(" + ".join(f"y{i} * y{i}" for i in range(P)))).drop(*[f"y{i}" for i in range(P)])


def _cholesky(df: DataFrame) -> DataFrame:
    """l from the covariances c, and half_det, the product of its diagonal."""
    for j in range(P):
        for i in range(j, P):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            df = df.withColumn(f"l{i}{j}", F.expr(f"sqrt(c{i}{j}{inner})" if i == j else f"(c{i}{j}{inner}) / l{j}{j}"))
    kept = ["g1", "g2", "start", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)]]
    return df.select(*kept, F.expr(" * ".join(f"l{i}{i}" for i in range(P))).alias("half_det"))


def _moments() -> list[Column]:
    x = [F.col(f"x_{n}").cast("double") for n in NAMES]
    return [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)], *[F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]]


def _estimate(moments: DataFrame, factor: float) -> DataFrame:
    """Means and floored covariances from moments, then their Cholesky factor."""
    out = moments.withColumns({f"m{i}": F.expr(f"s{i} / n") for i in range(P)})
    floors = [STATISTICS[n][1] ** 2 for n in NAMES]
    return _cholesky(out.withColumns({f"c{i}{j}": F.expr(f"{factor}D * ((s{i}{j} - s{i} * s{j} / n) / n)" + (f" + {float(floors[i])}D" if i == j else "")) for i in range(P) for j in range(i + 1)}))


def statistics(df: DataFrame) -> DataFrame:
    """One narrow row per document: counts, base_failed, the vector x and group keys.

    Keys are the language and source behind "=", or "-" for null.
    """
    out = base_counts(df.select("doc_id", "text", "lang", "source")).drop("text").withColumn("base_failed", _failed())
    out = out.withColumns({f"x_{n}": F.expr(f"if(word_chars > 0, cast(floor({e}) as int), 0)") for n, (e, _) in STATISTICS.items()})
    return out.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for k, c in (("k1", "lang"), ("k2", "source"))}).drop("lang", "source")


def _groups(good: DataFrame, min_rows: int) -> DataFrame:
    """(k1, k2) to the group (g1, g2) that judges it; groups too small to judge are left out."""
    sizes = good.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).withColumn("g2", F.when(F.col("n") >= min_rows, F.col("k2")).otherwise("*"))
    by_language = sizes.filter("g2 = '*'").groupBy("k1").agg(F.sum("n").alias("n1"))
    sizes = sizes.join(by_language, "k1", "left").withColumn("g1", F.expr(f"if(g2 <> '*' or n1 >= {min_rows}, k1, '*')"))
    pool = sizes.groupBy("g1").agg(F.sum("n").alias("n0"))
    sizes = sizes.join(pool, "g1")
    return sizes.filter(f"g1 <> '*' or n0 >= {min_rows}").select("k1", "k2", "g1", "g2")


def estimate(stats: DataFrame, min_rows: int = MIN_ROWS, steps: int = STEPS) -> DataFrame:
    """Location and scatter for every (k1, k2): columns m and l of the better of two starts."""
    spark = stats.sparkSession
    good = stats.filter("not base_failed").select("k1", "k2", *[f"x_{n}" for n in NAMES])
    groups = materialise(spark, _groups(good, min_rows), "groups")
    mine = good.join(groups, ["k1", "k2"])
    # start 0: medians and absolute deviations; start 1: mean and covariance of all
    median = mine.groupBy("g1", "g2").agg(*[F.percentile(f"x_{n}", F.lit(0.5)).alias(f"m{i}") for i, n in enumerate(NAMES)])
    median = materialise(spark, median, "medians")
    spread = mine.join(median, ["g1", "g2"]).groupBy("g1", "g2").agg(*[F.percentile(F.abs(F.col(f"x_{n}") - F.col(f"m{i}")), F.lit(0.5)).alias(f"a{i}") for i, n in enumerate(NAMES)])
    first = median.join(spread, ["g1", "g2"]).withColumn("start", F.lit(0))
    first = first.withColumns({f"c{i}{j}": F.expr(f"2.1981D * a{i} * a{i} + {float(STATISTICS[NAMES[i]][1] ** 2)}D" if i == j else "0D") for i in range(P) for j in range(i + 1)})
    second = _estimate(mine.groupBy("g1", "g2").agg(*_moments()).withColumn("start", F.lit(1)), 1.0)
    found = materialise(spark, _cholesky(first).unionByName(second), "estimate")
    for _ in range(steps):
        binned = _squared_distance(good.join(groups.join(found, ["g1", "g2"]), ["k1", "k2"])).withColumn("bin", F.expr(f"least(cast(floor(16 * sqrt(d2)) as bigint), {BINS})"))
        binned = binned.select("g1", "g2", "start", "bin", *[f"x_{n}" for n in NAMES])
        limit = materialise(spark, binned.groupBy("g1", "g2", "start").agg(F.ceil(F.percentile("bin", F.lit(COVERAGE))).alias("limit")), "limits")
        core = binned.join(limit, ["g1", "g2", "start"]).filter("bin <= limit").groupBy("g1", "g2", "start").agg(*_moments())
        found = materialise(spark, _estimate(core, CONSISTENCY), "estimate")
    best = found.groupBy("g1", "g2").agg(F.min(F.struct("half_det", "start")).alias("b")).select("g1", "g2", F.col("b.start").alias("start"))
    return materialise(spark, groups.join(found.join(best, ["g1", "g2", "start"]), ["g1", "g2"]).drop("g1", "g2", "start", "half_det"), "estimates")


@tidy
def judge(df: DataFrame, min_rows: int = MIN_ROWS, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, d2 (null where not judged) and kept."""
    stats = materialise(df.sparkSession, statistics(df), "statistics")
    judged = _squared_distance(stats.join(estimate(stats, min_rows), ["k1", "k2"], "left"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "d2", F.expr(f"not base_failed and coalesce(d2 <= {cut}D, true)").alias("kept"))


def oracle(min_rows: int = MIN_ROWS, cut: float = CUT, steps: int = STEPS) -> str:
    """The same in DuckDB SQL, from table documents."""
    white = r"[\x20\x09-\x0D]"
    xs = ", ".join(f"x_{n}" for n in NAMES)
    # DuckDB's / is a double division, and ints must not overflow: doubles throughout
    vector = ", ".join(f"CASE WHEN word_chars > 0 THEN CAST(floor({e}) AS INT) ELSE 0 END AS x_{n}" for n, (e, _) in STATISTICS.items())
    low = [(i, j) for i in range(P) for j in range(i + 1)]
    moments = ", ".join(["CAST(count(*) AS DOUBLE) AS n", *[f"sum(CAST(x_{n} AS DOUBLE)) AS s{i}" for i, n in enumerate(NAMES)], *[f"sum(CAST(x_{NAMES[i]} AS DOUBLE) * CAST(x_{NAMES[j]} AS DOUBLE)) AS s{i}{j}" for i, j in low]])
    floors = [float(STATISTICS[n][1] ** 2) for n in NAMES]
    ctes = [
        f"""words AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '{white}+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents)""",
        "places AS (SELECT r, unnest(generate_series(1, len(w) - 2)) AS i, w FROM words WHERE len(w) >= 3)",
        "windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM places)",
        "covered AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY r)",
        """counts AS (SELECT words.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM words LEFT JOIN covered USING (r))""",
        f"stats AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {vector}, coalesce('=' || lang, '-') AS k1, coalesce('=' || source, '-') AS k2 FROM counts)",
        f"good AS (SELECT k1, k2, {xs} FROM stats WHERE NOT base_failed)",
        "sizes AS (SELECT k1, k2, count(*) AS n FROM good GROUP BY k1, k2)",
        f"sizes1 AS (SELECT *, CASE WHEN n >= {min_rows} THEN k2 ELSE '*' END AS g2 FROM sizes)",
        f"sizes2 AS (SELECT k1, k2, n, g2, CASE WHEN g2 <> '*' OR sum(CASE WHEN g2 = '*' THEN n ELSE 0 END) OVER (PARTITION BY k1) >= {min_rows} THEN k1 ELSE '*' END AS g1 FROM sizes1)",
        f"groups AS MATERIALIZED (SELECT k1, k2, g1, g2 FROM sizes2 WHERE g1 <> '*' OR (SELECT sum(n) FROM sizes2 WHERE g1 = '*') >= {min_rows})",
        f"mine AS MATERIALIZED (SELECT g1, g2, {xs}, k1, k2 FROM good JOIN groups USING (k1, k2))",
        "medians AS (SELECT g1, g2, " + ", ".join(f"quantile_cont(CAST(x_{n} AS DOUBLE), 0.5) AS m{i}" for i, n in enumerate(NAMES)) + " FROM mine GROUP BY g1, g2)",
        "spreads AS (SELECT g1, g2, " + ", ".join(f"quantile_cont(abs(x_{n} - m{i}), 0.5) AS a{i}" for i, n in enumerate(NAMES)) + " FROM mine JOIN medians USING (g1, g2) GROUP BY g1, g2)",
        "c_0 AS (SELECT g1, g2, 0 AS start, " + ", ".join(f"m{i}" for i in range(P)) + ", " + ", ".join(f"CAST(2.1981 AS DOUBLE) * a{i} * a{i} + CAST({floors[i]} AS DOUBLE) AS c{i}{j}" if i == j else f"CAST(0 AS DOUBLE) AS c{i}{j}" for i, j in low) + " FROM medians JOIN spreads USING (g1, g2))",
    ]

    def covariance(name: str, source: str, factor: float) -> None:
        ctes.append(f"{name} AS (SELECT g1, g2, start, " + ", ".join(f"s{i} / n AS m{i}" for i in range(P)) + ", " + ", ".join(f"CAST({factor} AS DOUBLE) * ((s{i}{j} - s{i} * s{j} / n) / n)" + (f" + CAST({floors[i]} AS DOUBLE)" if i == j else "") + f" AS c{i}{j}" for i, j in low) + f" FROM {source})")

    def factorised(name: str, source: str) -> None:
        for j in range(P):
            for i in range(j, P):
                inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
                step = f"{name}_{i}{j}"
                ctes.append(f"{step} AS (SELECT *, " + (f"sqrt(c{i}{j}{inner})" if i == j else f"(c{i}{j}{inner}) / l{j}{j}") + f" AS l{i}{j} FROM {source})")
                source = step
        ctes.append(f"{name} AS MATERIALIZED (SELECT *, " + " * ".join(f"l{i}{i}" for i in range(P)) + f" AS half_det FROM {source})")

    def distances(name: str, source: str) -> str:
        for i, n in enumerate(NAMES):
            left = "".join(f" - l{i}{j} * y{j}" for j in range(i))
            ctes.append(f"{name}_y{i} AS (SELECT *, (x_{n} - m{i}{left}) / l{i}{i} AS y{i} FROM {source})")
            source = f"{name}_y{i}"
        ctes.append(f"{name} AS MATERIALIZED (SELECT *, " + " + ".join(f"y{i} * y{i}" for i in range(P)) + f" AS d2 FROM {source})")
        return name

    ctes.append(f"all_moments AS (SELECT g1, g2, 1 AS start, {moments} FROM mine GROUP BY g1, g2)")
    covariance("c_1", "all_moments", 1.0)
    ctes.append("c_s0 AS (SELECT * FROM c_0 UNION ALL BY NAME SELECT * FROM c_1)")
    factorised("e0", "c_s0")
    for k in range(1, steps + 1):
        ctes.append(f"j{k} AS (SELECT mine.*, e.* EXCLUDE (g1, g2) FROM mine JOIN e{k - 1} e USING (g1, g2))")
        distances(f"d{k}", f"j{k}")
        ctes.append(f"b{k} AS MATERIALIZED (SELECT g1, g2, start, {xs}, least(CAST(floor(16 * sqrt(d2)) AS BIGINT), {BINS}) AS bin FROM d{k})")
        ctes.append(f"q{k} AS (SELECT g1, g2, start, ceil(quantile_cont(CAST(bin AS DOUBLE), {COVERAGE})) AS lim FROM b{k} GROUP BY g1, g2, start)")
        ctes.append(f"s{k} AS (SELECT g1, g2, start, {moments} FROM b{k} JOIN q{k} USING (g1, g2, start) WHERE bin <= lim GROUP BY g1, g2, start)")
        covariance(f"c_s{k}", f"s{k}", CONSISTENCY)
        factorised(f"e{k}", f"c_s{k}")
    ctes.append(f"best AS (SELECT * FROM e{steps} QUALIFY row_number() OVER (PARTITION BY g1, g2 ORDER BY half_det, start) = 1)")
    ctes.append("fitted AS (SELECT k1, k2, best.* EXCLUDE (g1, g2) FROM groups JOIN best USING (g1, g2))")
    ctes.append("jz AS (SELECT stats.*, fitted.* EXCLUDE (k1, k2) FROM stats LEFT JOIN fitted USING (k1, k2))")
    distances("dz", "jz")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= CAST({cut} AS DOUBLE), true) AS kept FROM dz"
