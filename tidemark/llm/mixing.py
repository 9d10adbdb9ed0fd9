"""Mixing to target weights with soft membership.

A softmax classifier over hashed words and word endings, learned from a table of
labelled documents, gives each document posteriors over domains. Document rates
r >= 0 are then fitted so that the expected tokens of each domain, the sum of
r * tokens * posterior, match the targets. They minimise

    1/2 sum_d (e_d / T)^2 / w_d  +  l/2 sum_i (n_i / T) (r_i - 1)^2

with e the gaps to the target totals, T all tokens, w the target weights. The ridge
l is at most LAMBDA and shrinks with the rarest domain, so that it costs no domain
more than a small part of TOLERANCE; where domains overlap so that it still does, it
shrinks by tens, at most SHRINKS times, as long as the largest gap falls.

Where the projected gradient is zero, r_i = max(0, 1 - p_i . g / l) with p_i the
posterior and g = e / (T w), one number per domain. So projected gradient steps are
taken on g: the residual is what the rates of g reach, less share * (1 + g), and a step is
scaled by the curvature of the rates above zero, which takes tens of steps where plain
ones take hundreds. A step is one aggregation over all rows, for several lengths at
once; the sums of the length with the lowest dual objective are the next step's. Only
these sums reach the driver.

Documents are first summed in cells of equal rounded posteriors, which give g a
start; steps then go on over the documents themselves, each with the rate of its own
posterior, until the residual is below SETTLED or the objective no longer falls.
Targets out of reach (a domain without documents) settle away from their target.
Results say which: `converged`, and `reached`, each domain's total over its target.

A document is then taken floor(rate) times, and once more with the fraction's
probability, by a hash of its id. Tokens are words between ASCII white space
unless a column of counts is named. Null and empty texts have no tokens and get
the posterior of an empty text. With no labelled rows posteriors are uniform.
With no tokens at all every rate is 1 and nothing is reached. Repeated rows get
equal rates and copies; rows without an id share one chance of their fraction.
Equally likely domains share a document. Very long texts are scored like others.
An empty table gives an empty result. Input columns clashing with an output name
are replaced by the output.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, discard, materialise, texts, tidy
from .quality_classifier import draw

BUCKETS = 1 << 13
#: Labelled rows that the classifier reads, in expectation; all of them where there are fewer.
TRAINING_ROWS = 6000
EPOCHS, BATCH = 10, 128
LAMBDA = 0.001
#: The gap (share of a target) that counts as reached, and the residual (likewise) that counts as none.
TOLERANCE, SETTLED = 0.01, 1e-5
#: Posteriors of a cell agree to one part in GRID.
GRID = 256
#: Lengths of a step that are tried at once, and the share by which the objective must fall, else it has settled.
LENGTHS, STALL = (1.0, 0.5, 0.25, 0.0625, 2.0**-6, 2.0**-10), 1e-12
#: How often the ridge shrinks, and the share of the largest gap that must not remain then; else targets are out of reach.
SHRINKS, FALLS = 8, 0.95
CACHE = 150_000


class _Buckets(dict):
    """Word to its two buckets in one number: the word itself, and its last two bytes."""

    def __missing__(self, word: bytes) -> int:
        value = (zlib.crc32(word) % BUCKETS) * BUCKETS + zlib.crc32(b"~" + word[-2:]) % BUCKETS
        if len(self) < CACHE:
            self[word] = value
        return value


_buckets = _Buckets()


def encode(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, both buckets of every word in one number, texts end to end)."""
    split = [t.encode().split() for t in found]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    return counts, np.concatenate([np.fromiter(map(_buckets.__getitem__, w), np.int64, len(w)) for w in split] or [np.zeros(0, np.int64)])


def sparse(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of one text: a bucket's count over the root of the number of words."""
    count = np.bincount(codes // BUCKETS, minlength=BUCKETS) + np.bincount(codes % BUCKETS, minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at, count[at] / np.sqrt(max(1, len(codes)))


@dataclass
class Model:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, posteriors) of texts: word vectors are gathered and summed per text."""
        counts, codes = encode(found)
        z = np.zeros((len(found), len(self.domains)))
        has = counts > 0
        if len(codes):
            starts = (np.cumsum(counts) - counts)[has]
            z[has] = np.add.reduceat(self.weights[codes // BUCKETS] + self.weights[codes % BUCKETS], starts, axis=0, dtype=np.float64)
        z = z / np.sqrt(np.maximum(1, counts))[:, None] + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return counts, z / z.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, domains: list[str]) -> Model:
    """Softmax regression by AdaGrad over sparse rows, in a fixed order."""
    d = len(domains)
    w, b = np.zeros((BUCKETS, d)), np.log((np.bincount(y, minlength=d) + 1.0) / (len(y) + d))
    seen = np.full((BUCKETS, d), 1e-6)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            pick = shuffled[lo : lo + BATCH]
            at = np.concatenate([rows[i][0] for i in pick])
            x = np.concatenate([rows[i][1] for i in pick])
            who = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            z = b + np.stack([np.bincount(who, w[at, k] * x, len(pick)) for k in range(d)], axis=1)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            gap = z / z.sum(axis=1, keepdims=True)
            gap[np.arange(len(pick)), y[pick]] -= 1
            g = np.stack([np.bincount(at, gap[who, k] * x, BUCKETS) for k in range(d)], axis=1) / len(pick) + 1e-5 * w
            seen += g * g
            w -= 0.3 * g / np.sqrt(seen)
    return Model(domains, w.astype(np.float32), b.astype(np.float32))


def fit(docs: DataFrame, labelled: DataFrame, domain: str = "domain", rows: int = TRAINING_ROWS) -> Model:
    """Learn domains from labelled (doc_id, domain); null domains are left out."""
    drawn = draw(labelled.filter(F.col(domain).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(domain).alias("domain")), rows)

    def compute(batch: pa.RecordBatch):
        counts, codes = encode(texts(batch))
        made = [sparse(c) for c in np.split(codes, np.cumsum(counts)[:-1])]
        return pa.array([at.astype(np.uint16).tobytes() for at, _ in made], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in made], pa.binary())

    fields = [T.StructField("at", T.BinaryType()), T.StructField("x", T.BinaryType())]
    known = append(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), fields, compute, rows=512).groupBy("doc_id").agg(F.max("domain").alias("domain"), F.max(F.struct("at", "x")).alias("f"))
    found = known.select("doc_id", "domain", "f.at", "f.x").toArrow().sort_by("doc_id")
    domains = sorted(set(found["domain"].to_pylist()))
    if not domains:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    rows_of = [(np.frombuffer(a.as_py(), np.uint16).astype(np.int64), np.frombuffer(x.as_py(), np.float32)) for a, x in zip(found["at"], found["x"])]
    return train(rows_of, np.array([domains.index(n) for n in found["domain"].to_pylist()]), domains)


def posteriors(df: DataFrame, model: Model, domains: list[str], tokens: str | None = None) -> DataFrame:
    """df with n_tokens and posterior, an array<double> in the order of `domains`.

    A target domain that the classifier never met has posterior 0; domains
    without a target share in none.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    def compute(batch: pa.RecordBatch):
        m, found = shared.value, texts(batch)
        if m.domains:
            counts, p = m.posteriors(found)
            place = [m.domains.index(n) if n in m.domains else -1 for n in domains]
            p = np.concatenate([p, np.zeros((len(p), 1))], axis=1)[:, place]
        else:
            counts, p = encode(found)[0], np.full((len(found), len(domains)), 1 / len(domains))
        n = batch.column(batch.schema.get_field_index(tokens)).cast(pa.int64()).fill_null(0) if tokens else pa.array(counts, pa.int64())
        return n, pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(domains), pa.int32()), pa.array(p.ravel().astype(float)))

    return append(df, [T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))], compute, rows=512)


@dataclass
class Plan:
    """The gaps from which rates follow, and what was reached."""

    domains: list[str]
    targets: list[float]
    #: Gap of every domain as a share of its target, where the projected gradient is zero.
    gap: np.ndarray
    reached: list[float]
    converged: bool = False
    ridge: float = LAMBDA

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        """Rates of rows by their posteriors."""
        return _rates(posterior, self.gap, self.ridge)

    def rate(self, df: DataFrame) -> DataFrame:
        """df, which has a column posterior, with rate."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        d = len(self.domains)

        def compute(batch: pa.RecordBatch):
            p = batch.column(batch.schema.get_field_index("posterior")).flatten().to_numpy(zero_copy_only=False)
            yield pa.array(shared.value.rates(p.reshape(-1, d)))

        return append(df, [T.StructField("rate", T.DoubleType())], compute, rows=4096)

    def apply(self, df: DataFrame, key: str = "doc_id") -> DataFrame:
        """df with rate, copies, reached and converged."""
        share = F.array(*[F.lit(x / t if t else None).cast("double") for x, t in zip(self.reached, self.targets)])
        return self.rate(df).withColumns({"copies": copies(F.col("rate"), key), "reached": share, "converged": F.lit(self.converged)})

    def near(self, within: float) -> bool:
        return all(abs(x - t) <= within * t for x, t in zip(self.reached, self.targets))


def _rates(posterior: np.ndarray, gap: np.ndarray, ridge: float) -> np.ndarray:
    return np.maximum(0.0, 1 - posterior @ gap / ridge)


def _sums(rows: DataFrame, gaps: list[np.ndarray], ridge: float) -> np.ndarray:
    """For each gap, over rows (n, p0, p1, ...) with its rates: their tokens by domain, their curvature (domain by domain) and the tokens times the rates' squares."""
    d = len(gaps[0])
    size = d + d * d + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(gaps), size))
        for batch in batches:
            n = batch.column(0).to_numpy()
            p = np.stack([batch.column(1 + i).to_numpy() for i in range(d)], axis=1)
            for k, gap in enumerate(gaps):
                r = _rates(p, gap, ridge)
                up = p[r > 0]
                out[k] += np.concatenate([(r * n) @ p, ((up * n[r > 0, None]).T @ up).ravel(), [n @ (r * r)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int64)), pa.array(out.ravel())], names=["place", "x"])

    # a row for each number and task
    told = rows.select("n", *[f"p{i}" for i in range(d)]).mapInArrow(run, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(gaps) * size)
    for r in told:
        out[r.place] = r.x
    return out.reshape(len(gaps), size)


def _descend(rows: DataFrame, plan: Plan, total: float, share: np.ndarray) -> None:
    """Steps over rows (n, p0, p1, ...) from where the plan stands; noted in the plan."""
    d = len(share)
    objective = lambda gap, sums: plan.ridge / 2 * sums[-1] / total + share @ gap + share @ (gap * gap) / 2
    sums = _sums(rows, [plan.gap], plan.ridge)[0]
    while True:
        plan.reached = sums[:d].tolist()
        slope = share * (1 + plan.gap) - sums[:d] / total
        if np.abs(slope / share).max() <= SETTLED:
            break
        step = -np.linalg.solve(sums[d:-1].reshape(d, d) / total / plan.ridge + np.diag(share), slope)
        gaps = [plan.gap + t * step for t in LENGTHS]
        tried = _sums(rows, gaps, plan.ridge)
        now, then = objective(plan.gap, sums), [objective(g, x) for g, x in zip(gaps, tried)]
        best = int(np.argmin(then))
        if not then[best] < now - STALL * abs(now):
            break
        plan.gap, sums = gaps[best], tried[best]


def solve(df: DataFrame, weights: dict[str, float]) -> Plan:
    """Fit rates for rows with n_tokens and posterior to the target weights (any positive scale)."""
    spark = df.sparkSession
    domains = sorted(weights)
    d = len(domains)
    share = np.array([weights[x] for x in domains], float)
    share /= share.sum()
    rows = df.select(F.col("n_tokens").cast("double").alias("n"), *[F.get("posterior", F.lit(i)).alias(f"p{i}") for i in range(d)]).filter("n > 0")
    sums = rows.groupBy(*[F.round(F.col(f"p{i}") * GRID).cast("int").alias(f"c{i}") for i in range(d)]).agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(f"p{i}")).alias(f"s{i}") for i in range(d)])
    cells = materialise(spark, sums.select("n", *[(F.col(f"s{i}") / F.col("n")).alias(f"p{i}") for i in range(d)]), "cells")
    p = [F.col(f"p{i}") for i in range(d)]
    zero = F.lit(0.0)
    total, *more = cells.agg(F.coalesce(F.sum("n"), zero), *[F.coalesce(F.sum(F.col("n") * x), zero) for x in p]).first()
    plan = Plan(domains, (share * total).tolist(), np.zeros(d), [0.0] * d)
    if total:
        held = np.array(more) / total
        plan.ridge = float(min(LAMBDA, 0.2 * TOLERANCE * (held[held > 0] / share[held > 0]).min()))
        _descend(cells, plan, total, share)
        _descend(rows, plan, total, share)
        for _ in range(SHRINKS):
            if plan.near(TOLERANCE):
                break
            before = replace(plan)
            # of equal rates, so that steps go on from them
            plan.ridge, plan.gap = plan.ridge / 10, plan.gap / 10
            _descend(rows, plan, total, share)
            if np.abs(plan.gap).max() > FALLS * np.abs(before.gap).max():
                plan = before
                break
        plan.converged = plan.near(TOLERANCE)
    discard(spark, cells)
    return plan


def copies(rate: Column, key: str = "doc_id") -> Column:
    """How often a row is taken: the rate, rounded up or down by a hash of its key."""
    chance = F.pmod(F.xxhash64(F.lit("mixing"), F.col(key).cast("string")), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


@tidy
def rates(df: DataFrame, model: Model, weights: dict[str, float], tokens: str | None = None) -> DataFrame:
    """One narrow row per document: doc_id, n_tokens, posterior, rate, copies, reached and converged; texts are read once."""
    known = materialise(df.sparkSession, posteriors(df, model, sorted(weights), tokens).select("doc_id", "n_tokens", "posterior"), "posteriors")
    return solve(known, weights).apply(known)


def mix(df: DataFrame, model: Model, weights: dict[str, float], tokens: str | None = None) -> DataFrame:
    """df with n_tokens, posterior, rate, copies, reached and converged.

    Texts are scored once: they are written with their posteriors, and the fit
    reads the narrow columns of that table.
    """
    known = materialise(df.sparkSession, posteriors(df, model, sorted(weights), tokens), "scored")
    return solve(known, weights).apply(known)


#: Domains of the labels table and the weights that the query and the pipeline aim at.
TARGETS = {"clean": 0.88, "low": 0.09, "toxic": 0.03}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from labels of quality and toxicity."""
    return labels.select("doc_id", F.expr("case when toxic = 1 then 'toxic' when quality = 0 then 'low' when quality = 1 then 'clean' end").alias("domain"))
