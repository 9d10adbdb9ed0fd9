"""Quality classifier: a generalised additive model with pairwise interactions.

Each statistic of a text is cut into quantile bins and owns a lookup table of
log-odds. Tables are learned by cyclic boosting: round after round every feature
in turn gets a shallow tree fitted to the current gradient, shrunk and added to
its table. The pairs with the largest leftover gain then get two-way tables, fed
by four-leaf trees of one cut in either feature. Scoring bins a batch's
statistics and adds table entries.

The fit reads a bounded sample of labelled rows (TRAINING_ROWS) and runs on their
statistics, not their texts; statistics are computed by tasks over whole texts.
With no labelled rows every score is 0.5. Null texts count as empty, and empty
texts are scored like others. Repeated labelled rows count once; of equally good
cuts the first is taken, and a score of just 0.5 predicts 1. Repeated rows get equal
scores, an empty table an empty result. Very long texts cost time and memory in
proportion to their words. Input columns clashing with an output name are replaced
by the output.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, texts

#: Labelled rows that the fit reads, in expectation; all of them where there are fewer.
TRAINING_ROWS = 10_000
BINS, PAIR_BINS = 32, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE, PENALTY = 0.15, 4.0

FEATURES = ("log_bytes", "mean_word", "symbols", "capitals", "digits", "stops", "exclamations", "bars", "non_ascii", "distinct_words", "top_word", "mean_line", "dup_lines", "first_capital")
_SYMBOLS, _DIGITS = np.frombuffer(b"#*$%&|<>", np.uint8), np.arange(48, 58)
_CAPITALS = np.arange(65, 91)


def measure(text: str) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES."""
    raw = text.encode()
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    most = Counter(words).most_common(1)
    distinct = len(set(words))
    return [
        float(np.log1p(len(raw))),
        sum(map(len, words)) / w,
        float(count[_SYMBOLS].sum()) / n,
        float(count[_CAPITALS].sum()) / n,
        float(count[_DIGITS].sum()) / n,
        float(count[44] + count[46]) / n,
        float(count[33]) / n,
        float(count[124]) / n,
        float(count[128:].sum()) / n,
        distinct / w,
        (most[0][1] if most else 0) / w,
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(x[:1].isupper() for x in lines) / max(1, len(lines)),
    ]


def _leaves(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a tree over ordered bins with sums of gradients g and curvatures h."""
    out = np.empty(len(g))

    def grow(lo: int, hi: int, left: int) -> None:
        gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
        if left and hi - lo > 1:
            a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gain = a**2 / (b + PENALTY) + (gs - a) ** 2 / (hs - b + PENALTY)
            k = int(gain.argmax())
            if gain[k] > gs**2 / (hs + PENALTY) + 1e-9:
                grow(lo, lo + k + 1, left - 1)
                grow(lo + k + 1, hi, left - 1)
                return
        out[lo:hi] = gs / (hs + PENALTY)

    grow(0, len(g), depth)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best four-leaf tree, one cut in either direction, over a table of sums; its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        parts.append((a, b, d, c[-1, -1] - a - b - d))
    gain = sum(x**2 / (y + PENALTY) for x, y in zip(*parts))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    a, b, d, e = (float(x[i, j] / (y[i, j] + PENALTY)) for x, y in zip(*parts))
    table = np.empty(g.shape)
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = a, b, d, e
    return table, float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + PENALTY))


class Model:
    """Bin edges, lookup tables and pair tables."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.coarse = [e[np.unique(np.linspace(0, len(e) - 1, PAIR_BINS - 1).astype(int))] for e in self.edges]
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        bins = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)]
        rough = [np.searchsorted(e, c, side="right") for e, c in zip(self.coarse, x.T)]
        total = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for table, b in zip(self.tables, bins):
                p = 1 / (1 + np.exp(-total))
                step = RATE * _leaves(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
                table += step
                total += step[b]

        def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
            at = rough[i] * shape[1] + rough[j]
            p = 1 / (1 + np.exp(-total))
            return np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

        usable = [i for i in range(x.shape[1]) if len(self.coarse[i])]
        gains = {ij: _quadrants(*sums(*ij))[1] for ij in combinations(usable, 2)}
        for ij in sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]:
            self.pairs[ij] = np.zeros((len(self.coarse[ij[0]]) + 1, len(self.coarse[ij[1]]) + 1))
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in self.pairs.items():
                step = RATE * _quadrants(*sums(i, j))[0]
                table += step
                total += step[rough[i], rough[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for c, e, table in zip(x.T, self.edges, self.tables):
            total += table[np.searchsorted(e, c, side="right")]
        for (i, j), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def statistics(df: DataFrame, column: str = "text") -> DataFrame:
    """df with an array<double> `statistics` of each text."""

    def compute(batch: pa.RecordBatch):
        yield pa.array([measure(t) for t in texts(batch, column)], pa.list_(pa.float64()))

    return append(df, [T.StructField("statistics", T.ArrayType(T.DoubleType()))], compute, rows=1024)


def draw(labels: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """One row per key of `labels`, for the `rows` keys of the lowest hashes: small enough to broadcast at any size.

    Rows of hashes too high to be among them, by the count of keys, are left out before the shuffle.
    """
    keys = labels.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    share = (1.1 * rows + 10 * rows**0.5) / max(1, keys)
    top = min(2**63 - 1, int(share * 2**64) - 2**63)
    hashed = F.xxhash64(F.col(key).cast("string"))
    drawn = labels.filter(hashed <= top).groupBy(key).agg(*[F.max(c).alias(c) for c in labels.columns if c != key])
    return drawn.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> Model | None:
    """Learn from the documents that have a label; None where there are none."""
    drawn = draw(labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label), rows)
    known = statistics(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")).drop("text").groupBy("doc_id").agg(F.max(label).alias("y"), F.max("statistics").alias("x"))
    found = known.toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    return Model(np.array(found["x"].to_pylist()), found["y"].to_numpy().astype(float))


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def classify(df: DataFrame, model: Model | None, column: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 from a score of 0.5)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch):
        found = texts(batch, column)
        score = shared.value.score(np.array([measure(t) for t in found])) if shared.value and found else np.full(len(found), 0.5)
        return pa.array(score), pa.array((score >= 0.5).astype(np.int32))

    return append(df, FIELDS, compute, rows=1024)
