"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (n = 1 to 3) of lower-cased texts in hash buckets, per
language, in tasks; only the summed counts reach the driver, and their size is
languages x BUCKETS. The log-probability matrix is broadcast, and a batch of
texts is scored by gathering its rows and summing them per text.

A language's prior is its share of the labelled rows. Texts without a letter
(str.isalpha) and null texts are `und` with score 0. Where nothing can be learned
(no labelled rows) every text is `und`. Ties go to the language that sorts first.
Texts longer than GROUP characters are counted stretch by stretch, so a very long
one needs no more memory than many short ones. Repeated rows get equal results,
an empty table an empty result. Input columns clashing with an output name are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, texts

BUCKETS = 1 << 15
ORDERS = 3
#: Labelled rows per language that the fit reads, in expectation; all of them where there are fewer.
TRAINING_ROWS = 2000
#: Characters scored together.
GROUP = 1 << 18
#: Letters, and numbers that are no decimal digits.
_WORDY = re.compile(r"[^\W\d_]")
_PRIMES = np.array([1, 2654435761, 2246822519], np.uint64)


def _grams(lowered: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram that begins in the texts, laid end to end, and each text's start.

    Two separators stand behind each text, so an n-gram reads no other text.
    """
    points = np.frombuffer("".join(t + "\x00\x00" for t in lowered).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    keys = np.zeros((len(points), ORDERS), np.int64)
    key = np.zeros(len(points), np.uint64)
    for n in range(ORDERS):
        key[: len(points) - n] += (points[n:] + np.uint64(n)) * _PRIMES[n]
        keys[:, n] = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)
    ends = np.cumsum(sizes + 2)
    inside = np.ones(len(points), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return keys[inside], np.cumsum(sizes) - sizes


def _groups(found: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(found):
        stop, size = at + 1, len(found[at])
        while stop < len(found) and size + len(found[stop]) <= GROUP:
            size += len(found[stop])
            stop += 1
        yield at, stop
        at = stop


def has_letter(text: str) -> bool:
    found = _WORDY.search(text)
    return found is not None and (found.group().isalpha() or any(map(str.isalpha, text[found.end() :])))


def _counted(lowered: str) -> np.ndarray:
    """Counts per bucket of one text's n-grams, stretch by stretch: those that begin in it are counted."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(lowered) or 1, GROUP):
        keys, _ = _grams([lowered[at : at + GROUP + ORDERS - 1]])
        last = at + GROUP >= len(lowered)
        total += np.bincount((keys if last else keys[:GROUP]).ravel(), minlength=BUCKETS)
    return total


class Model:
    def __init__(self, languages: list[str], log_probability: np.ndarray, log_prior: np.ndarray):
        self.languages, self.log_probability, self.log_prior = languages, log_probability, log_prior

    def score(self, found: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        if not self.languages:
            return ["und"] * len(found), [0.0] * len(found)
        for lo, hi in _groups(found):
            part = [t.lower() for t in found[lo:hi]]
            if len(part) == 1 and len(part[0]) > GROUP:
                total = (_counted(part[0]) @ self.log_probability.astype(np.float64))[None, :]
            else:
                keys, starts = _grams(part)
                per = sum(self.log_probability[keys[:, n]] for n in range(ORDERS))
                total, full = np.zeros((len(part), len(self.languages))), np.array([bool(t) for t in part])
                if full.any():
                    total[full] = np.add.reduceat(per, starts[full], axis=0, dtype=np.float64)
            total = total + self.log_prior
            best = total.argmax(axis=1)
            weight = np.exp(total - total.max(axis=1, keepdims=True))
            sure = 1 / weight.sum(axis=1)
            for t, b, s in zip(part, best.tolist(), sure.tolist()):
                known = has_letter(t)
                names.append(self.languages[b] if known else "und")
                scores.append(s if known else 0.0)
        return names, scores


def fit(df: DataFrame, column: str = "text", label: str = "lang", key: str = "doc_id", rows: int = TRAINING_ROWS) -> Model:
    """Learn from the labelled rows of df: about `rows` of each language, drawn by a hash of key and text."""
    named = df.filter(F.col(label).isNotNull() & F.col(column).isNotNull())
    sizes = {r[0]: r[1] for r in named.groupBy(label).count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(label) == name, min(1.0, rows / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(column)), F.lit(1_000_000)) / 1e6
    drawn = named.filter(draw < share).select(label, column).repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            found = [t.lower() for t in texts(batch, column)]
            for name in set(labels):
                mine = [t for t, x in zip(found, labels) if x == name]
                for lo, hi in _groups(mine):
                    whole = hi - lo == 1 and len(mine[lo]) > GROUP
                    sums[name] = sums.get(name, 0) + (_counted(mine[lo]) if whole else np.bincount(_grams(mine[lo:hi])[0].ravel(), minlength=BUCKETS))
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    total = drawn.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    counts = np.full((BUCKETS, len(languages)), 0.5)
    if total.num_rows:
        place = {x: i for i, x in enumerate(languages)}
        counts[total["bucket"].to_numpy(), [place[x] for x in total["lang"].to_pylist()]] += total["n"].to_numpy()
    prior = np.log([sizes[x] / sum(sizes.values()) for x in languages])
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), prior)


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def predict(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """df with lang_pred and score, the posterior of the predicted language."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch):
        names, scores = shared.value.score(texts(batch, column))
        return pa.array(names, pa.string()), pa.array(scores, pa.float64())

    return append(df, FIELDS, compute, rows=1024)
