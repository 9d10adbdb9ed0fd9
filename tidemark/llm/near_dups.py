"""Near-duplicates by an LSH forest of MinHash signatures.

1. A map turns each text into its set of five-word shingles (64-bit hashes) and
   a MinHash signature. Documents with equal sets form one class, named by a
   128-bit digest of the set; classes are the nodes of all later steps.
2. The forest holds every class once per tree, sorted by that tree's slice of
   the signature. A class's candidates are its neighbours of longest common
   prefix: the rows around it, no further than NEIGHBOURS rows, for as long as
   MIN_DEPTH hashes agree. In dense regions the neighbours share long prefixes,
   in sparse ones short ones: the depth adapts by itself. Trees are cut into
   ranges of equal size, whatever the keys, and seams between ranges are walked
   once more, so a hot prefix costs as much as any other rows.
3. Candidates that the whole signature does not rule out are confirmed on the
   full shingle sets: first every class's best partner, then whatever still
   joins two components. Sets are made again from the texts of the classes
   concerned; a filter of fixed size, broadcast, lets all other documents go
   before anything is shuffled.
4. What the walk may have missed is compared exactly: in every bucket (a tree's rows
   that agree in MIN_DEPTH hashes) of more rows than a class puts forward, all
   classes meet all classes of other components. Buckets are cut into blocks, rows of one
   large component into blocks of their own that don't meet each other, and each
   pair of blocks is a unit of work of bounded size. Sketches choose the rows of a
   unit whose full sets are compared; a unit gives only links that join components.

Links become components by union-find in one task while they are few, else by
alternating star contraction; only counts and the fixed-size filter reach the
driver.

Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased. With fewer than
five words the whole sequence is one shingle. Null texts and texts without words
have no shingles and are linked with nothing. Rows with equal doc_id are judged
each by its text. A row whose doc_id is null never names a component but is
judged like others; where it has no other member its component is null.
Of equally good partners in the walk the nearest counts, of best partners the one
with the greater key; which of them is taken changes the work but not the result.
A partition of the forest with fewer than NEIGHBOURS rows would end a window at two
seams, so there are never more partitions than the rows fill four times that far.
Very long texts cost time and memory in proportion to their words. Repeated rows
are members of one class; an empty table gives an empty result. Input columns other
than doc_id and text are ignored. The result is written; all other tables go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, partitions, texts, tidy

SHINGLE = 5
#: Similarity in percent from which documents are linked.
PERCENT = 75
TREES, DEPTH = 10, 8
#: Hashes of a signature; the trees use the first TREES * DEPTH, agreement is estimated on all.
HASHES = 128
MIN_DEPTH = 2
#: Rows to look back in a tree's order.
NEIGHBOURS = 32
#: Partners that a class may put forward per tree in the walk.
BEST = 3
#: Signature agreement below which a pair is ruled out: five standard deviations under PERCENT.
AGREEMENT = 0.55
#: Links that one task joins; with more of them all tasks do, with the same result.
LOCAL_LINKS = 500_000
#: Bytes of the filter on documents: a byte a class that is looked for, between these bounds. It only saves shuffling.
FILTER_BYTES = (1 << 20, 1 << 24)
#: Rows of the forest, or of units, in a task.
TASK_ROWS = 2_000_000
#: Words whose hashes a worker remembers.
CACHE = 150_000
#: Rows of a bucket up to which every partner is put forward; rows of a block of larger buckets.
WINDOW, BLOCK = BEST + 1, 1024


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers of the SplitMix64 sequence."""
    z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) | np.uint64(1)


_PLACES = _splitmix(SHINGLE, 5)
_LENGTHS = _splitmix(SHINGLE, 55)
_HASHES = _splitmix(HASHES, 75)[:, None]


class _Words(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


_words = _Words()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    s = np.full(n, _LENGTHS[width - 1])
    for i in range(width):
        s += h[i : i + n] * _PLACES[i]
    s ^= s >> np.uint64(33)
    s *= np.uint64(0xFF51AFD7ED558CCD)
    s ^= s >> np.uint64(33)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima (uint32) over a non-empty set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, (s[None, at : at + 2048] * _HASHES).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def sketch(g: np.ndarray) -> bytes:
    """The low four bits of every hash, two in a byte."""
    low = (g & np.uint32(15)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


#: Four-bit fields that are zero in a byte.
_ZEROS = np.array([(x < 16) + (x % 16 == 0) for x in range(256)], np.uint8)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketches(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (null for no shingles), orders (the trees' sort keys) and low (the sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sets = [shingles(t) for t in texts(batch)]
                signed = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([None if g is None else g[: TREES * DEPTH].astype(">u4").tobytes() for g in signed], pa.binary()),
                        pa.array([None if g is None else sketch(g) for g in signed], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "key", "orders", "low"],
                )

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_shingles long, key binary, orders binary, low binary")


WALKED = "kind int, a binary, b binary, agreement float, seam int, tree int, ord binary, low binary, n long"


def _walk(batches: Iterator[pa.RecordBatch], seams: bool) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (kind 0) of rows in forest order, and the rows at both ends of
    the partition (kind 1). Rows: seam, tree, ord, low, n, key.
    """
    part = TaskContext.get().partitionId()
    front: pa.Table | None = None
    tail: pa.Table | None = None

    def ends(table: pa.Table, seam: int, like: int) -> pa.RecordBatch:
        # only rows of the bucket that reaches the seam can have neighbours beyond it
        buckets = [(t, o[: 4 * MIN_DEPTH]) for t, o in zip(table["tree"].to_pylist(), table["ord"].to_pylist())]
        table = table.filter(pa.array([b == buckets[like] for b in buckets]))
        n = table.num_rows
        none = lambda t: pa.nulls(n, t)
        columns = [pa.array([1] * n, pa.int32()), table["key"], none(pa.binary()), none(pa.float32()), pa.array([seam] * n, pa.int32()), table["tree"], table["ord"], table["low"], table["n"]]
        return pa.Table.from_arrays(columns, names=["kind", "a", "b", "agreement", "seam", "tree", "ord", "low", "n"]).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        if front is None or front.num_rows < NEIGHBOURS:
            front = (pa.concat_tables([front, new]) if front is not None else new).slice(0, NEIGHBOURS)
        table = (pa.concat_tables([tail, new]) if tail is not None else new).combine_chunks()
        old = table.num_rows - new.num_rows
        tail = table.slice(max(0, table.num_rows - NEIGHBOURS))
        n = table.num_rows
        order = np.frombuffer(b"".join(table["ord"].to_pylist()), np.uint8).reshape(n, -1)
        top = np.ascontiguousarray(order[:, : 4 * MIN_DEPTH]).view(np.uint64)[:, 0]
        place = table["seam"].to_numpy() * TREES + table["tree"].to_numpy()
        low = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(n, HASHES // 2)
        size = table["n"].to_numpy()
        keys = table["key"].to_pylist()
        left, right, agree = [], [], []
        for back in range(1, NEIGHBOURS + 1):
            j = np.arange(max(old, back), n)
            i = j - back
            ok = (top[i] == top[j]) & (place[i] == place[j])
            if not ok.any():
                break
            i, j = i[ok], j[ok]
            a, b = size[i], size[j]
            ok = 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)
            i, j = i[ok], j[ok]
            same = (_ZEROS[low[i] ^ low[j]].sum(axis=1, dtype=np.int64) / HASHES - 1 / 16) * (16 / 15)
            ok = same >= AGREEMENT
            left.append(i[ok])
            right.append(j[ok])
            agree.append(same[ok])
        if not left:
            continue
        i, j, same = np.concatenate(left), np.concatenate(right), np.concatenate(agree)
        if len(j):
            order = np.lexsort((j - i, -same, j))
            i, j, same = i[order], j[order], same[order]
            head = np.concatenate([[True], j[1:] != j[:-1]])
            begin = np.maximum.accumulate(np.where(head, np.arange(len(j)), 0))
            ok = np.arange(len(j)) - begin < BEST
            i, j, same = i[ok], j[ok], same[ok]
        if len(j):
            pairs = [(min(keys[x], keys[y]), max(keys[x], keys[y])) for x, y in zip(i.tolist(), j.tolist())]
            m = len(pairs)
            none = lambda t: pa.nulls(m, t)
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary()), pa.array(same, pa.float32()), none(pa.int32()), none(pa.int32()), none(pa.binary()), none(pa.binary()), none(pa.int64())], names=["kind", "a", "b", "agreement", "seam", "tree", "ord", "low", "n"])
    if tail is not None and seams:
        yield ends(front, part - 1, 0)
        yield ends(tail, part, -1)


def _candidates(spark: SparkSession, forest: DataFrame, parts: int) -> DataFrame:
    """The walk over the forest: distinct pairs (a, b, agreement)."""
    order = ["tree", "ord", "key"]
    rows = ["seam", "tree", "ord", "low", "n", "key"]
    laid = forest.withColumn("seam", F.lit(0)).select(*rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    walked = materialise(spark, laid.mapInArrow(lambda b: _walk(b, True), WALKED), "walk")
    ends = walked.filter("kind = 1").withColumnRenamed("a", "key").select(*rows)
    over = ends.repartition(parts, "seam").sortWithinPartitions("seam", *order).mapInArrow(lambda b: _walk(b, False), WALKED)
    both = walked.filter("kind = 0").select("a", "b", "agreement").unionByName(over.select("a", "b", "agreement"))
    both = materialise(spark, both.groupBy("a", "b").agg(F.max("agreement").alias("agreement")), "pairs")
    discard(spark, walked)
    return both


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    joined = pairs.select("a", "b").join(sets.select(F.col("key").alias("a"), F.col("s").alias("s1")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("s2")), "b").select("a", "b", "s1", "s2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a binary, b binary")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by unit, one table for each unit."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, new]) if held is not None else new
        unit = table["unit"].to_numpy()
        at = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist()]
        for lo, hi in zip(at, at[1:]):
            yield table.slice(lo, hi - lo)
        held = table.slice(at[-1])
    if held is not None:
        yield held


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both sides of a unit (side 2 stands on both), and a number for each row's label."""
    side = table["side"].to_numpy()
    number: dict[bytes, int] = {}
    labels = np.array([number.setdefault(x, len(number)) for x in table["label"].to_pylist()])
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0), labels


def _shortlist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a unit that have a partner of another label, as far as sizes and sketches tell."""
    for table in _units(batches):
        left, right, label = _sides(table)
        size = table["n"].to_numpy()
        low = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(len(size), HASHES // 2)
        hit = np.zeros(len(size), bool)
        step = max(1, (1 << 16) // max(1, len(right)))
        for at in range(0, len(left), step):
            i = left[at : at + step, None]
            a, b = size[i], size[None, right]
            x, y = np.nonzero((100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)) & (label[i] != label[None, right]))
            x, y = i[x, 0], right[y]
            same = (_ZEROS[low[x] ^ low[y]].sum(axis=1, dtype=np.int64) / HASHES - 1 / 16) * (16 / 15)
            ok = same >= AGREEMENT
            hit[x[ok]] = hit[y[ok]] = True
        if hit.any():
            yield from table.filter(pa.array(hit)).select(["unit", "side", "key", "label"]).combine_chunks().to_batches()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) by which all similar rows of a unit come together: every pair of sides meets on full sets, unless it is joined already."""
    for table in _units(batches):
        left, right, root = _sides(table)
        if len(right) < len(left):
            left, right = right, left
        if not len(left):
            continue
        keys = table["key"].to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table["s"].to_pylist()]
        size = np.array([len(x) for x in sets])
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        codes = np.split(codes, np.cumsum(size)[:-1])
        others = np.concatenate([codes[j] for j in right])
        starts = np.cumsum(size[right]) - size[right]
        mark = np.zeros(len(values), bool)
        found = []
        for i in left.tolist():
            far = (root[right] != root[i]) & (100 * np.minimum(size[right], size[i]) >= PERCENT * np.maximum(size[right], size[i]))
            if not far.any():
                continue
            mark[codes[i]] = True
            both = np.add.reduceat(mark[others], starts, dtype=np.int64)
            mark[codes[i]] = False
            for j in right[far & (100 * both >= PERCENT * (size[i] + size[right] - both))].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    found.append((keys[i], keys[j]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])


def _placed(spark: SparkSession, classes: DataFrame, trees: Column) -> DataFrame:
    """unit, side, key and label of the rows of buckets over WINDOW rows in which labels differ.

    A bucket's rows are cut into blocks by hashes of their labels, those of a
    label with more than BLOCK rows by hashes of their keys. A unit is a pair of
    blocks, or one block with itself; blocks of one label make none.
    """
    rows = classes.select("key", F.coalesce("label", "key").alias("label"), trees).select("key", "label", F.xxhash64("t.tree", F.substring("t.ord", 1, 4 * MIN_DEPTH)).alias("bucket"))
    mixed = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter(f"m > {WINDOW} and lo <> hi").select("bucket")
    crowded = materialise(spark, rows.join(mixed, "bucket", "left_semi"), "crowded")
    counts = crowded.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"))
    heavy = materialise(spark, counts.filter(f"m > {BLOCK}").select("bucket", "label", F.ceil(F.col("m") / BLOCK).alias("own")), "heavy")
    light = materialise(spark, counts.filter(f"m <= {BLOCK}").groupBy("bucket").agg(F.ceil(F.sum("m") / BLOCK).alias("shared")), "light")
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("no")
    blocks = light.select("bucket", number("shared"), F.lit(None).cast("binary").alias("pure")).unionByName(heavy.select("bucket", number("own"), F.col("label").alias("pure")))
    name = lambda no, pure: F.xxhash64("bucket", no, F.coalesce(pure, F.lit("").cast("binary")))
    blocks = blocks.select("bucket", name(F.col("no"), F.col("pure")).alias("block"), "pure")
    x, y = (blocks.select("bucket", F.col("block").alias(f"b{i}"), F.col("pure").alias(f"p{i}")) for i in (0, 1))
    units = x.join(y, "bucket").filter("b0 <= b1 and not coalesce(p0 = p1, false)").withColumn("unit", F.xxhash64("b0", "b1"))
    sides = units.select("unit", F.explode(F.expr("if(b0 = b1, array(struct(b0 as block, 2 as side)), array(struct(b0 as block, 0 as side), struct(b1 as block, 1 as side)))")).alias("s")).select("unit", "s.block", "s.side")
    cut = crowded.join(heavy, ["bucket", "label"], "left").join(light, "bucket", "left")
    cut = cut.withColumn("no", F.expr("if(own is null, pmod(xxhash64(label), shared), pmod(xxhash64(key), own))")).select(name(F.col("no"), F.when(F.col("own").isNotNull(), F.col("label"))).alias("block"), "key", "label")
    return cut.join(sides, "block").select("unit", "side", "key", "label")


def _rest(spark: SparkSession, docs: DataFrame, classes: DataFrame, labels: DataFrame, trees: Column, members: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) between components, from exact comparison within crowded buckets."""
    placed = _placed(spark, classes.select("key", "orders").join(labels.withColumnRenamed("node", "key"), "key", "left"), trees)
    rows = placed.join(classes.select("key", "low", "n"), "key").repartition(parts, "unit").sortWithinPartitions("unit")
    short = materialise(spark, rows.mapInArrow(_shortlist, "unit long, side int, key binary, label binary"), "shortlist")
    sets = _sets(docs, short.select("key").distinct(), members)
    met = short.join(sets, "key").repartition(parts, "unit").sortWithinPartitions("unit")
    found = materialise(spark, met.mapInArrow(_compare, "a binary, b binary"), "links")
    discard(spark, short)
    return found


def _filter(ids: DataFrame) -> np.ndarray:
    """A one-hash filter over the hashes h: bits are set in tasks and joined by bit_or."""
    size = FILTER_BYTES[0]
    many = ids.count()
    while size < min(many, FILTER_BYTES[1]):
        size *= 2
    bit = F.pmod("h", F.lit(8 * size))
    found = ids.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(h, {8 * size}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size // 8, np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64)


def _sets(docs: DataFrame, keys: DataFrame, members: DataFrame) -> DataFrame:
    """key and full set s (sorted uint64 bytes) of each class in keys, from the text of a member."""
    h = F.xxhash64(F.coalesce(F.col("rep").cast("string"), F.lit("")))
    bits = docs.sparkSession.sparkContext.broadcast(_filter(keys.join(members, "key").select(h.alias("h"))))
    hashed = docs.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for whole in batches:
            at = whole.column(0).to_numpy() % (64 * len(words))
            hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            kept = whole.filter(pa.array(hit.astype(bool)))
            for at in range(0, kept.num_rows, 512):
                sets = [s for t in texts(kept.slice(at, 512)) if len(s := shingles(t))]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "s"])

    return hashed.mapInArrow(run, "key binary, s binary").join(keys, "key", "left_semi").groupBy("key").agg(F.first("s").alias("s"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as stars: every node with the least node it reaches here."""
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = sorted((root(x), root(y)))
            up[y] = x
    found = [(x, r) for x in list(up) if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([r for _, r in found], pa.binary())], names=["u", "v"])


def components(spark: SparkSession, links: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """node, label of all linked nodes: label is the least node of the component.

    links: columns a and b. Up to `local` links are joined by one task; more by
    alternating large and small stars, until nothing moves.
    """
    if links.count() <= local:
        found = links.select("a", "b").coalesce(1).mapInArrow(_stars, "u binary, v binary")
        roots = F.explode(F.array("u", "v")).alias("node")
        return found.select(roots, F.col("v").alias("label")).distinct()
    edges = materialise(spark, links.select("a", "b").mapInArrow(_stars, "u binary, v binary"), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(spark, large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = materialise(spark, moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, large)
        discard(spark, edges)
        edges = small
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(roots)


@tidy
def near_duplicates(df: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and kept.

    component_id is the least doc_id that can be reached over links; kept where
    it is the row's own.
    """
    spark = df.sparkSession
    docs = materialise(spark, sketches(df), "sketches")
    known = docs.filter("key is not null")
    classes = materialise(spark, known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("orders").alias("orders"), F.first("low").alias("low")), "classes")
    members = classes.select("key", "rep")
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("orders", 4 * DEPTH * t + 1, 4 * DEPTH).alias("ord")) for t in range(TREES)])).alias("t")
    links = labels = None
    rows = TREES * classes.count()
    parts = partitions(spark, rows, TASK_ROWS)
    pairs = _candidates(spark, classes.select("key", "low", "n", trees).select("key", "low", "n", "t.tree", "t.ord"), max(1, min(parts, rows // (4 * NEIGHBOURS))))
    if not pairs.isEmpty():
        ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        sets = materialise(spark, _sets(df, ends, members), "sets")
        # every class's best partner first; most other candidates are then within one component
        ranked = pairs.select(F.explode(F.array("a", "b")).alias("key"), "a", "b", "agreement")
        best = ranked.groupBy("key").agg(F.max(F.struct("agreement", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        best = materialise(spark, best, "best")
        links = materialise(spark, _confirm(best, sets), "links")
        labels = materialise(spark, components(spark, links), "labels")
        rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
        rest = rest.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        rest = rest.filter("not (coalesce(la, a) <=> coalesce(lb, b))").select("a", "b")
        more = materialise(spark, _confirm(rest, sets), "links")
        discard(spark, sets)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = materialise(spark, components(spark, links), "labels")
    named = labels if labels is not None else spark.createDataFrame([], "node binary, label binary")
    more = _rest(spark, df, classes, named, trees, members, parts)
    if not more.isEmpty():
        links = links.unionByName(more) if links is not None else more
        labels = materialise(spark, components(spark, links), "labels")
    found = classes.select("key", "rep", "copies")
    if labels is not None:
        found = found.join(labels.withColumnRenamed("node", "key"), "key", "left")
    else:
        found = found.withColumn("label", F.lit(None).cast("binary"))
    found = found.filter("copies > 1 or label is not null").withColumn("label", F.coalesce("label", "key"))
    least = found.groupBy("label").agg(F.min("rep").alias("component"))
    named = found.join(least, "label").select("key", "component")
    grouped = docs.filter("key is not null").join(named, "key", "left")
    apart = docs.filter("key is null").withColumn("component", F.lit(None).cast(df.schema["doc_id"].dataType))
    out = grouped.select("doc_id", "n_shingles", "component").unionByName(apart.select("doc_id", "n_shingles", "component"))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
