"""SentencePiece encoding and decoding in vectorised merge rounds.

Encoding runs the rounds of `bpe` over a batch's distinct unknown chunks; a
bounded cache per worker keeps what it has encoded. Decoding gathers piece
bytes for all ids of a batch at once.

Null and empty texts have no ids and decode to the empty text. Repeated rows
get equal results, an empty table an empty one. Of equal pair ranks in a chunk the
leftmost merges first. Very long texts cost memory in proportion to their length;
a single word of more than bpe.LONG characters is merged by a heap. Input columns
clashing with an output name are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe
from .common import append, texts
from .token_counts import ChunkCache

#: Entries of a worker's table; each holds ids and their decimal text.
CACHE = 150_000


def _lists(parts: list[bytes], kind: pa.DataType = pa.int32()) -> pa.Array:
    sizes = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(parts), "<i4"), kind))


def encode(df: DataFrame, path: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """df with an array<int> of the ids of each text."""
    held: dict[str, ChunkCache] = {}

    def compute(batch: pa.RecordBatch):
        if not held:
            held[path] = ChunkCache(bpe.model(path), lambda x: x, CACHE)
        cache = held[path]
        yield _lists([b"".join(map(cache.__getitem__, keys)) for keys in cache.split(texts(batch, column))])

    return append(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], compute, rows=512)


def _decoded(m: bpe.PieceModel, flat: np.ndarray, starts: np.ndarray) -> list[bytes]:
    raw, at = m.decode_bytes(flat, starts)
    at = at.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def decode(df: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """df with the text of each id list (null: empty); broken byte pieces become U+FFFD."""

    def compute(batch: pa.RecordBatch):
        lists = batch.column(batch.schema.get_field_index(ids)).fill_null([])
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        yield pa.array([b.decode("utf-8", "replace") for b in _decoded(bpe.model(path), flat, np.cumsum(sizes) - sizes)], pa.string())

    return append(df, [T.StructField(column, T.StringType())], compute, rows=512)


ROUND_TRIP = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]


def round_trip(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """df with ids, n_tokens and whether decoding the ids gives the text back, in one map.

    U+2581 decodes to a space, so texts that hold it compare with spaces instead.
    """
    held: dict[str, ChunkCache] = {}

    def compute(batch: pa.RecordBatch):
        if not held:
            held[path] = ChunkCache(bpe.model(path), lambda x: x, CACHE)
        cache = held[path]
        found = texts(batch, column)
        parts = [b"".join(map(cache.__getitem__, keys)) for keys in cache.split(found)]
        n = np.array([len(p) // 4 for p in parts], np.int64)
        back = _decoded(cache.model, np.frombuffer(b"".join(parts), "<i4"), np.cumsum(n) - n)
        return _lists(parts), pa.array(n), pa.array([b == t.replace(bpe.SPACE, " ").encode() for b, t in zip(back, found)], pa.bool_())

    return append(df, ROUND_TRIP, compute, rows=256)


DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def codec_digest(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Encode, decode and digest in one map, so neither ids nor texts travel.

    ids_sha256 covers the decimal ids joined by commas, decoded_sha256 the
    decoded text in UTF-8.
    """
    held: dict[str, ChunkCache] = {}

    def compute(batch: pa.RecordBatch):
        if not held:
            held[path] = ChunkCache(bpe.model(path), lambda x: (x, ",".join(map(str, np.frombuffer(x, "<i4").tolist()))), CACHE)
        cache = held[path]
        both = [[*map(cache.__getitem__, keys)] for keys in cache.split(texts(batch, column))]
        parts = [b"".join([v[0] for v in x]) for x in both]
        said = [hashlib.sha256(",".join([v[1] for v in x]).encode()).hexdigest() for x in both]
        n = np.array([len(p) // 4 for p in parts], np.int64)
        back = _decoded(cache.model, np.frombuffer(b"".join(parts), "<i4"), np.cumsum(n) - n)
        return pa.array(n), pa.array(said, pa.string()), pa.array([hashlib.sha256(b.decode("utf-8", "replace").encode()).hexdigest() for b in back], pa.string())

    return append(df, DIGEST, compute, rows=512)
