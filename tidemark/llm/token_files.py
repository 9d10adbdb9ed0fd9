"""Token ids in bit-packed binary files with block offsets.

Layout of a .tide file, little-endian throughout:

    b"TIDEBITS"                            magic
    blocks                                 BLOCK ids each, `bits` bits per id
    int64[blocks + 1]                      byte offset of every block, then the end
    int64[documents]                       document ids
    uint8[documents]                       1 where the document id is null
    int64[documents + 1]                   first id of every document, then the count
    int64[6]                               bits, BLOCK, ids, blocks, documents, index offset
    b"TIDEBITS"

Every block starts on a byte boundary, so id i is found by one seek: block
i // BLOCK, and all ids of a block unpack in one vectorised step. `bits` is the
smallest width that holds the vocabulary.

Writing deals documents into ranges of ascending doc_id (null ids first, equal
ids by a hash of the text), one file per task. File names carry a unique attempt,
and the manifest that Spark commits names only files of finished tasks, so
retried or lost tasks leave nothing that a reader could take up.

Null and empty texts hold their end id only. Rows are kept as they are: repeated
ids and rows each get their place. Of the input only doc_id and text are read,
whatever other columns it has. Readers decode about CHUNK ids at a time, so a very
long document costs no more memory than many short ones.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, shared_dir

MAGIC = b"TIDEBITS"
BLOCK = 8192
#: Bytes of input, as Spark's plan estimates them, for a file, files at most where no number is named, and ids decoded together.
SHARD_BYTES, MOST_SHARDS, CHUNK = 64 << 20, 1 << 20, 1 << 20
#: Entries of a worker's table of encoded chunks.
CACHE = 600_000
#: Marks set off before white space, and where one ends a run of symbols: there it belongs to the run.
_STOPS = (". ", ", ", ".\n", ",\n")
_PAIR = re.compile(r"([a-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=>?@[-`{}~]+)")
_RUN = r"(?:^|[^a-z0-9\t-\r \x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])[.,][ \n]"
#: Chunks whose ids are gathered together.
GATHERED = 1 << 18


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as `bits`-bit little-endian fields, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(fields.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    fields = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return fields @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    def __init__(self, sink, vocabulary: int):
        self.sink, self.bits = sink, max(1, (vocabulary - 1).bit_length())
        self.rest, self.at, self.offsets = np.zeros(0, np.uint32), len(MAGIC), []
        self.ids, self.null, self.starts = [], [], []
        self.documents = self.count = 0
        sink.write(MAGIC)

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.ids.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.null.append(doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.documents += len(doc_ids)
        self.starts.append(self.count + np.cumsum(sizes) - sizes)
        self.count += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._block(ids[i : i + BLOCK])
        self.rest = ids[whole:].copy()

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.at += self.sink.write(pack(ids, self.bits))

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        wide = lambda x: np.asarray(x, "<i8").tobytes()
        joined = lambda x: np.concatenate(x) if x else np.zeros(0)
        index = wide([*self.offsets, self.at]) + wide(joined(self.ids)) + joined(self.null).astype(np.uint8).tobytes() + wide(np.append(joined(self.starts), self.count))
        self.sink.write(index + wide([self.bits, BLOCK, self.count, len(self.offsets), self.documents, self.at]) + MAGIC)


class Reader:
    """Random access to one file's ids."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 56)
        tail = file.read(56)
        if tail[48:] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, self.count, blocks, docs, at = np.frombuffer(tail[:48], "<i8").tolist()
        file.seek(at)
        raw = file.read(size - 56 - at)
        self.offsets = np.frombuffer(raw, "<i8", blocks + 1)
        raw = raw[8 * (blocks + 1) :]
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.null = np.frombuffer(raw, np.uint8, docs, 8 * docs).astype(bool)
        self.starts = np.frombuffer(raw, "<i8", docs + 1, 9 * docs)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file, reading only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        at = int(self.offsets[first])
        self.file.seek(at)
        raw = self.file.read(int(self.offsets[last + 1]) - at)
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.count - b * self.block)
            parts.append(unpack(raw[int(self.offsets[b]) - at : int(self.offsets[b + 1]) - at], self.bits, n))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def checksums(self, chunk: int = CHUNK) -> Iterator[tuple[int, list[int]]]:
        """(first document, crc32 of the ids of each following one), reading about `chunk` ids at a time."""
        at, documents = 0, len(self.doc_ids)
        while at < documents:
            stop = max(at + 1, int(np.searchsorted(self.starts[: documents + 1], self.starts[at] + chunk, side="right")) - 1)
            first, last = int(self.starts[at]), int(self.starts[stop])
            if stop == at + 1:
                crc = 0
                for lo in range(first, last, chunk):
                    crc = zlib.crc32(self.ids(lo, min(lo + chunk, last)).astype("<u4").tobytes(), crc)
                yield at, [crc]
            else:
                ids = memoryview(self.ids(first, last).astype("<u4").tobytes())
                cuts = (4 * (self.starts[at : stop + 1] - first)).tolist()
                yield at, [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
            at = stop


class ChunkEncoder:
    """A tokenizers file, applied chunk by chunk between ASCII white space.

    Exact for tokenizers that drop white space and lower-case (checked by
    `supports`); texts with special-token openers go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for p, i in vocabulary.items() if p.endswith("</w>")]] = True
        self.local = self.supports(path)
        self.table: dict[str, bytes] = {"": b""}

    @staticmethod
    def supports(path: str) -> bool:
        import json

        spec = json.load(open(path))
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        return steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("type") == "Split" and "[^\\s\\p{L}\\p{N}]+" in cuts[0]["pattern"].get("Regex", "") and spec["model"].get("end_of_word_suffix") == "</w>" and all(not t["lstrip"] and not t["rstrip"] and t["content"].startswith("<|") for t in spec["added_tokens"])

    def _apart(self, found: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(found, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        table = self.table
        words = [k for k in new if k.isalpha()]
        # letters and a run of symbols behind them are tokens apart
        pairs = {k: m.groups() for k in new.difference(words) if (m := _PAIR.fullmatch(k))}
        words += {a for a, _ in pairs.values()}.difference(table).difference(new)
        if words:
            ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            # each word ends once or more: as many ends as words are one end each
            if len(cuts) == len(words):
                raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                table.update(zip(words, map(raw.__getitem__, map(slice, at, at[1:]))))
        rest = list(new.union(*pairs.values()).difference(table, pairs))
        table.update(zip(rest, self._apart(rest)))
        table.update((k, table[a] + table[b]) for k, (a, b) in pairs.items())

    @staticmethod
    def _chunks(found: pa.Array) -> pa.ListArray:
        """Texts in lower case, cut at white space and before marks that follow a letter or digit."""
        low = cut = pc.ascii_lower(found)
        for mark in _STOPS:
            cut = pc.replace_substring(cut, mark, " " + mark)
        return pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(low, _RUN), low, cut))

    def encode(self, found: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all, with `end` after each text if given; null is empty.

        Equal chunks of a call meet the table once; ids are then gathered by number.
        """
        found = found.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring(found, "<|") if self.local else pa.array(np.ones(len(found), bool))
        lists = self._chunks(pc.if_else(whole, "", found))
        coded = lists.flatten().dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        table = self.table
        if len(table) > CACHE:
            for k in list(table)[CACHE // 2 :]:
                del table[k]
        if new := set(keys).difference(table):
            self._learn(new)
        # each text closes with its end id, those that the library takes whole with all their ids
        close = b"" if end is None else np.array([end], "<u4").tobytes()
        apart = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        made = [*map(table.__getitem__, keys), close, *(x + close for x in self._apart(found.take(pa.array(apart)).to_pylist()))]
        closing = np.full(len(found), len(keys))
        closing[apart] = len(keys) + 1 + np.arange(len(apart))
        stops = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
        chunks = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), stops, closing)
        flat, lengths = np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made)) // 4
        first, long = np.cumsum(lengths) - lengths, lengths[chunks]
        sizes = np.diff(np.append(0, np.cumsum(long))[stops + 1 + np.arange(len(found))], prepend=0)
        parts = [np.zeros(0, "<u4")]
        for at in range(0, len(chunks), GATHERED):
            n, source = long[at : at + GATHERED], first[chunks[at : at + GATHERED]]
            parts.append(flat[np.repeat(source - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return sizes, np.concatenate(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file://" + uri.removeprefix("file:"))


MANIFEST = "shard int, file string, documents long, ids long, bytes long"


def write(df: DataFrame, path: str, end_id: int, shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode text by doc_id order into files; the manifest, one row per file.

    end_id closes each document. shards: files to write, by default one for
    SHARD_BYTES of text and no fewer than the session's shuffle partitions. Empty
    tables give an empty manifest.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/tidemark/tokens-{uuid.uuid4().hex}"
    if shards is None:
        # the texts' own bytes, by a pass over them: a plan's estimate grows with every join in it
        size = df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = min(partitions(spark, size, SHARD_BYTES), MOST_SHARDS)
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.monotonically_increasing_id().asc()]
    laid = df.select("doc_id", "text").repartitionByRange(shards, *keys).sortWithinPartitions(*keys[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, shard = None, TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tide"
        tool = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                if writer is None:
                    system, place = _open(name)
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    writer = Writer(system.open_output_stream(place), tool.size)
                writer.add(part.column(0), *tool.encode(part.column(1), end_id))
        if writer is not None:
            writer.close()
            size = writer.sink.tell()
            writer.sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "documents": [writer.documents], "ids": [writer.count], "bytes": [size]})

    return materialise(spark, laid.mapInArrow(run, MANIFEST), "manifest")


ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_digest(manifest: DataFrame) -> DataFrame:
    """One row per document, read back from the files that a manifest names.

    start counts the ids of all documents before it in the whole set of files;
    ids_crc32 is the crc32 of its ids as little-endian unsigned 32-bit integers.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = _open(row["file"])
                with system.open_input_file(place) as file:
                    r = Reader(file, row["bytes"])
                    for at, crcs in r.checksums():
                        stop = at + len(crcs)
                        cuts = r.starts[at : stop + 1]
                        yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[at:stop], mask=r.null[at:stop]), pa.array(cuts[:-1] + row["first"]), pa.array(np.diff(cuts)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # as many tasks as files: a task reads few files, whatever their number
    n = max(1, min(manifest.count(), 4096))
    return files.select("shard", "file", "bytes", "first").repartition(n, "shard").mapInArrow(run, ROWS)


def read_bytes(raw: bytes) -> Reader:
    return Reader(io.BytesIO(raw), len(raw))
