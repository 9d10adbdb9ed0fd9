"""Telephony audio columns: G.711 and IMA ADPCM, expanded and resampled.

A media blob is a RIFF/WAVE file at 8 kHz: mu-law or A-law samples of 8 bits, or IMA
ADPCM blocks. mu-law and A-law expand by 256-entry tables built from the G.711
rule. ADPCM blocks decode step by step in time, with numpy across all blocks of a
batch. Decoded samples are resampled to 16 kHz by a half-band interpolator in
integers and stored as a column of 16-bit PCM, so equal blobs give equal PCM
everywhere.

`store` keeps any bytes losslessly: padded to whole units they are the samples of
a blob, whose codec follows from the bytes unless one is named. Null and empty
texts become one unit of padding. A null blob has null PCM and null digests.
`expand` decodes every sample of a blob, a last ADPCM block that is cut short
included; blobs that are no such files, lack samples that they announce, or end in
less than a block's header are errors. Repeated rows give equal results, an empty
table an empty one. Batches are cut by bytes, so very long texts cost memory in
proportion to one text. Input columns clashing with an output name are replaced.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append, texts

#: Payloads are padded to a multiple of this, which is also an ADPCM block.
UNIT = 192
RATE = 8000
MU_LAW, A_LAW, ADPCM = 7, 6, 17
NAMES = {MU_LAW: "mu-law", A_LAW: "a-law", ADPCM: "ima-adpcm"}
#: Bytes of media handled together.
GROUP = 1 << 20

# Fixed values of IMA ADPCM: step sizes, and index changes by the low three bits.
STEPS = (
    "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 "
    "1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767"
)
INDEX_CHANGES = "-1 -1 -1 -1 2 4 6 8"
_STEP = np.array(STEPS.split(), np.int32)
_CHANGE = np.array(INDEX_CHANGES.split() * 2, np.int32)


def mu_law_table() -> np.ndarray:
    """int16 of every mu-law byte: inverted bits, sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) * 8 + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """int16 of every A-law byte: even bits inverted, sign set for positive values."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = np.where(exponent == 0, mantissa * 16 + 8, (mantissa * 16 + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks by time, int16) of uint8 IMA ADPCM mono blocks.

    A block is a 16-bit first sample, a step index (held to 0..88), a spare
    byte, then two samples a byte, low nibble first.
    """
    n, width = blocks.shape
    value = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    # time by block, so that every step works on adjacent memory
    codes = np.empty((2 * (width - 4), n), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, n), np.int16)
    out[0] = value
    for t, code in enumerate(codes):
        step = _STEP[index]
        change = step >> 3
        change += np.where(code & 4, step, 0)
        change += np.where(code & 2, step >> 1, 0)
        change += np.where(code & 1, step >> 2, 0)
        value += np.where(code & 8, -change, change)
        np.clip(value, -32768, 32767, out=value)
        index += _CHANGE[code]
        np.clip(index, 0, 88, out=index)
        out[t + 1] = value
    return out.T


def resample(samples: np.ndarray) -> np.ndarray:
    """int16 at twice the rate: a six-tap half-band interpolator, edges held."""
    x = np.concatenate([np.repeat(samples[:1], 2), samples, np.repeat(samples[-1:], 3)]).astype(np.int32)
    n = len(samples)
    between = (150 * (x[2 : 2 + n] + x[3 : 3 + n]) - 25 * (x[1 : 1 + n] + x[4 : 4 + n]) + 3 * (x[0:n] + x[5 : 5 + n]) + 128) >> 8
    out = np.empty(2 * n, np.int16)
    out[0::2] = samples
    out[1::2] = np.clip(between, -32768, 32767)
    return out


def to_payload(raw: bytes) -> bytes:
    """raw with bytes 32 appended up to a positive multiple of UNIT."""
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def block_samples(width: int) -> int:
    """Samples of an ADPCM block of so many bytes: the header's, and two in each byte after it."""
    return 2 * (width - 4) + 1


def codec_of(payload: bytes) -> int:
    """The codec that stores a payload where none is named: equal bytes, equal codec."""
    return (MU_LAW, A_LAW, ADPCM)[zlib.crc32(payload) % 3]


def to_media(payload: bytes, codec: int | None = None) -> bytes:
    """A WAVE file whose data are the payload's bytes as they are; the payload is a multiple of UNIT."""
    codec = codec_of(payload) if codec is None else codec
    if codec == ADPCM:
        per = block_samples(UNIT)
        form = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * UNIT // per, UNIT, 4, 2, per)
        samples = len(payload) // UNIT * per
    else:
        form, samples = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0), len(payload)
    chunks = [(b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", payload)]
    body = b"WAVE" + b"".join(struct.pack("<4sI", name, len(x)) + x + b"\x00" * (len(x) % 2) for name, x in chunks)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


@dataclass(frozen=True)
class Media:
    codec: int
    #: Bytes of an ADPCM block.
    block: int
    data: bytes


def parse_media(blob: bytes) -> Media:
    """Codec, block size and data of a mono WAVE file."""
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(blob):
        name, size = struct.unpack_from("<4sI", blob, at)
        if at + 8 + size > len(blob):
            raise ValueError("this WAVE file is cut short")
        if name == b"fmt ":
            codec, channels, _, _, block = struct.unpack_from("<HHIIH", blob, at + 8)
            if codec not in NAMES or channels != 1:
                raise ValueError(f"format {codec} with {channels} channels is not supported")
            form = codec, block
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            return Media(*form, blob[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no samples in this WAVE file")


def decoded(found: list[Media]) -> list[np.ndarray]:
    """Samples (int16 at 8 kHz) of each file; ADPCM blocks of one size are decoded together."""
    out = [TABLES[m.codec][np.frombuffer(m.data, np.uint8)] if m.codec in TABLES else np.zeros(0, np.int16) for m in found]
    widths: dict[int, list[tuple[int, bytes]]] = {}
    for i, m in enumerate(found):
        if m.codec == ADPCM and m.data:
            if m.block <= 4 or 0 < len(m.data) % m.block < 4:
                raise ValueError("an ADPCM block without a header")
            whole = len(m.data) // m.block * m.block
            widths.setdefault(m.block, []).append((i, m.data[:whole]))
            if whole < len(m.data):
                widths.setdefault(len(m.data) - whole, []).append((i, m.data[whole:]))
    parts: dict[int, list[np.ndarray]] = {}
    # a file's whole blocks come before its cut one, which is shorter
    for width in sorted(widths, reverse=True):
        raw = np.frombuffer(b"".join(d for _, d in widths[width]), np.uint8).reshape(-1, width)
        samples, at = decode_adpcm(raw), 0
        for i, d in widths[width]:
            parts.setdefault(i, []).append(samples[at : at + len(d) // width].ravel())
            at += len(d) // width
    for i, x in parts.items():
        out[i] = np.concatenate(x)
    return out


def store(df: DataFrame, column: str = "text", media: str = "media", codec: int | None = None) -> DataFrame:
    """df with a WAVE blob of each text's bytes, losslessly."""

    def compute(batch: pa.RecordBatch):
        yield pa.array([to_media(to_payload(t.encode()), codec) for t in texts(batch, column)], pa.binary())

    return append(df, [T.StructField(media, T.BinaryType())], compute, rows=256)


def _groups(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(blobs):
        stop, size = at + 1, len(blobs[at])
        while stop < len(blobs) and size + len(blobs[stop]) <= GROUP:
            size += len(blobs[stop])
            stop += 1
        yield at, stop
        at = stop


def _each(blobs: list[bytes | None], make: Callable[[list[bytes]], list]) -> list:
    """make() of the blobs that are not null, group by group; null for the others."""
    there = [b for b in blobs if b is not None]
    made = iter([x for lo, hi in _groups(there) for x in make(there[lo:hi])])
    return [None if b is None else next(made) for b in blobs]


def expand(df: DataFrame, media: str = "media", pcm: str = "pcm") -> DataFrame:
    """df with the media column decoded, resampled to 16 kHz and stored as 16-bit PCM bytes (null stays null)."""

    def make(blobs: list[bytes]) -> list[bytes]:
        return [resample(x).astype("<i2").tobytes() if len(x) else b"" for x in decoded([parse_media(b) for b in blobs])]

    def compute(batch: pa.RecordBatch):
        yield pa.array(_each(batch.column(batch.schema.get_field_index(media)).to_pylist(), make), pa.binary())

    return append(df, [T.StructField(pcm, T.BinaryType())], compute, rows=64)


def levels(pcm: bytes) -> str:
    """Root mean square and sign changes of 16-bit PCM, in integers."""
    x = np.frombuffer(pcm, "<i2").astype(np.int64)
    return f"{math.isqrt(int((x * x).sum()) // max(1, len(x)))}/{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


DIGEST = [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("pcm_bytes", T.LongType()), T.StructField("feature", T.StringType())]


def digest(df: DataFrame, media: str = "media", pcm: str = "pcm") -> DataFrame:
    """df with digests of what its media blobs hold and features of the PCM that `expand` made of them; null where a blob is null."""

    def compute(batch: pa.RecordBatch):
        blobs, sounds = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (media, pcm))
        rows = []
        for b, x in zip(blobs, sounds):
            if b is None:
                rows.append((None,) * len(DIGEST))
                continue
            m, x = parse_media(b), x or b""
            rows.append((len(m.data), hashlib.sha256(m.data).hexdigest(), zlib.crc32(m.data[-16:]), len(b), hashlib.sha256(b).hexdigest(), len(x), f"{NAMES[m.codec]};rms/turns={levels(x)};pcm16k={zlib.crc32(x):08x}"))
        columns = list(zip(*rows)) or [()] * len(DIGEST)
        return [pa.array(c, pa.int64() if f.dataType == T.LongType() else pa.string()) for c, f in zip(columns, DIGEST)]

    return append(df, DIGEST, compute, rows=64)
