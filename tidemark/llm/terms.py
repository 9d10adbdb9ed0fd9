"""Terms of texts, cut and counted a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut into terms at once; a single longer text is cut whole.
SLICE_BYTES = 16 << 20


def byte_table(digits: bool) -> bytes:
    """What each byte of a text becomes: letters lower case A-Z only, bytes of non-ASCII characters as they are, all else (digits too, unless kept) a space."""
    table = bytearray(b" " * 256)
    for c in range(256):
        if 97 <= c <= 122 or c >= 128 or digits and 48 <= c <= 57:
            table[c] = c
        elif 65 <= c <= 90:
            table[c] = c + 32
    return bytes(table)


@dataclass
class Postings:
    """One entry for each different term of each text, by code and text: terms[code[i]] occurs n[i] times in text doc[i]."""

    terms: pa.Array
    code: np.ndarray
    doc: np.ndarray
    n: np.ndarray
    lengths: np.ndarray


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of a batch's rows with their texts (null: empty), each of at most `most` bytes or one row."""
    found = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    size = pc.fill_null(pc.binary_length(found), 0).to_numpy()
    at = 0
    while at < len(size):
        n = max(1, int(np.searchsorted(np.cumsum(size[at:]), most, side="right")))
        yield batch.slice(at, n), pc.fill_null(found.slice(at, n), b"")
        at += n


def count(texts: pa.Array, table: bytes) -> Postings:
    """Postings of texts (large binary, no nulls)."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    plain = pa.py_buffer(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes().translate(table))
    words = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(n, pa.py_buffer((offsets - offsets[0]).tobytes()), plain))
    flat = words.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(n), np.diff(words.offsets.to_numpy()))[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    key, times = np.unique(coded.indices.to_numpy().astype(np.int64) * n + doc, return_counts=True)
    return Postings(coded.dictionary, key // n, key % n, times, np.bincount(doc, minlength=n))


def lengths(texts: pa.Array, table: bytes) -> np.ndarray:
    """How many terms each text (large binary, no nulls) has."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    inside = np.frombuffer(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes().translate(table), np.uint8) != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = (offsets - offsets[0])[:-1]
    at = at[at < len(inside)]
    begins[at] = inside[at]  # a term ends with its text
    upto = np.concatenate([[0], np.cumsum(begins)])
    return np.diff(upto[offsets - offsets[0]])
