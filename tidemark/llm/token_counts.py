"""Token counts by a two-tier, map-side lookup of pre-token lengths.

Tier one is a compact table of frequent pre-tokens and their token counts,
broadcast to every task. Tier two is each worker's cache of the pre-tokens it
has met beyond that table; what neither knows is encoded in vectorised batches.
No pre-token is ever shuffled: the counting job is one map over the documents.

The table is found by Misra-Gries summaries over all documents: each task keeps
a fixed number of counters and sends one blob, and blobs merge in a tree of
tasks. The table only decides which tier answers; counts are exact regardless.

Null and empty texts have 0 tokens. Repeated rows are counted each. Very long texts
are counted whole; their pre-tokens are looked up like others. Which of equally
frequent pre-tokens stand in the table does not matter to a count. Input columns
clashing with an output name are replaced by the output.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe
from .common import append, texts

#: Counters of one Misra-Gries summary, and entries of the broadcast table.
COUNTERS = 4096
#: Summaries that one task of the merging tree reads.
FAN_IN = 64
#: Entries a worker's tables may hold before it drops the younger half.
CACHE = 300_000

FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]


def _reduced(counts: Counter, k: int) -> Counter:
    """At most k counters: the (k+1)-largest count is taken off all (mergeable summary)."""
    if len(counts) <= k:
        return counts
    off = counts.most_common(k + 1)[-1][1]
    return Counter({w: n - off for w, n in counts.items() if n > off})


def _blob(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"blob": pa.array([json.dumps(counts).encode()], pa.binary())})


def frequent_chunks(df: DataFrame, column: str = "text", k: int = COUNTERS) -> list[str]:
    """Heavy-hitting pre-tokens over all documents, at most k of them."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for t in texts(batch.slice(at, 256), column):
                    counts.update(w for w in bpe.chunks(t) if len(w) <= 32)
                if len(counts) > 16 * k:
                    counts = _reduced(counts, 4 * k)
        yield _blob(_reduced(counts, k))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for blob in batch.column(0):
                counts.update(json.loads(blob.as_py()))
                counts = _reduced(counts, k)
        yield _blob(counts)

    left = df.rdd.getNumPartitions()
    found = df.select(column).mapInArrow(summarise, "blob binary")
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        found = found.repartition(left).mapInArrow(merge, "blob binary")
    total: Counter = Counter()
    # at most FAN_IN summaries of at most k counters each
    for row in found.collect():
        total.update(json.loads(row.blob))
        total = _reduced(total, k)
    return sorted(total)


class LengthTable:
    """Pre-token lengths as one text blob and 16-bit counts: what is broadcast."""

    def __init__(self, chunks: list[str], path: str):
        m = bpe.model(path)
        self.names = "\x00".join(chunks).encode()
        self.lengths = np.array([min(len(ids) // 4, 65535) for ids in m.encode_units([bpe.unit(c) for c in chunks])], np.uint16)

    def items(self) -> Iterator[tuple[str, int]]:
        return zip(self.names.decode().split("\x00"), self.lengths.tolist()) if len(self.lengths) else iter(())


class ChunkCache(dict):
    """Values of chunks, made in batches; the oldest half survives a full table."""

    def __init__(self, model: bpe.PieceModel, value, limit: int = CACHE, seed=()):
        super().__init__(seed)
        self.model, self.value, self.limit = model, value, limit

    def split(self, batch: list[str]) -> list[list[str]]:
        """The batch's chunk lists, all of whose chunks are then in the table."""
        lists = [bpe.chunks(t) for t in batch]
        if len(self) > self.limit:
            for k in list(self)[self.limit // 2 :]:
                del self[k]
        new = list(set().union(*lists).difference(self))
        self.update(zip(new, map(self.value, self.model.encode_units([bpe.unit(k) for k in new]))))
        return lists


def count_tokens(df: DataFrame, path: str, column: str = "text", limit: int = 4096, table: LengthTable | None = None) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit).

    path: a .model file; counts equal its library's, without begin or end ids.
    table: an earlier run's table, which saves the pass that finds one.
    """
    if table is None:
        table = LengthTable([c for c in frequent_chunks(df, column) if "\x00" not in c], path)
    shared = df.sparkSession.sparkContext.broadcast(table)
    held: dict[str, ChunkCache] = {}

    def compute(batch: pa.RecordBatch):
        if not held:
            held[path] = ChunkCache(bpe.model(path), lambda ids: len(ids) // 4, seed=shared.value.items())
        cache = held[path]
        found = texts(batch, column)
        n = np.array([sum(map(cache.__getitem__, keys)) for keys in cache.split(found)], np.int64)
        return pa.array([len(t.encode()) for t in found], pa.int64()), pa.array(n), pa.array(n > limit)

    return append(df, FIELDS, compute, rows=512)
