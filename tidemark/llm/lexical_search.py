"""Ranked lexical search by inverted treaps.

The index cuts documents into shards, each made by one task from the rows it reads,
so nothing is shuffled to build it. In a shard every term has a treap over the
documents that hold it: a binary search tree by place in doc_id order and a heap by
impact, with a fixed random order among equal impacts, so copies don't make it deep.
It is stored in preorder with the sizes of left subtrees, as one row a term.

A search walks the treaps of all terms of an item at once. A range of documents is
summed up by the highest node that each treap has in it; the sum of their impacts
bounds every score in the range, and ranges that cannot enter the top k are left.
Of the others the document with the greatest single impact is scored and splits
its range in two; ranges with few postings left are scored outright. Ranges of many
items are walked side by side in numpy.

Items come in blocks of at most BLOCK_TERMS different terms or one item; a block's
terms are what is sent to tasks. A few shards are searched first: the k-th best
score there is a lower bound for all others. Scores are 64-bit integers.

Odd tables: null texts hold no term; documents of equal or null ids are documents of
their own (null ids first where scores tie), items likewise; items without a term
that occurs, and empty tables, give no rows; texts of any length are indexed whole.
Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tidy
from .terms import Postings, byte_table, count, lengths, slices

TERMS = byte_table(digits=True)
TOP = 20
#: A shard ends with the batch that reaches so many documents or bytes of text.
SHARD_DOCS, SHARD_BYTES = 8192, 12 << 20
#: Different terms of a block of items, shards searched first, tasks' parts in which the best are found first.
BLOCK_TERMS, PILOT, SPREAD = 200_000, 8, 16
#: Postings up to which a range is scored outright, and entries of all treaps that one step of a walk holds.
LEAF, WIDTH = 192, 1 << 20
INDEX = "shard long, term string, doc array<int>, impact array<int>, smaller array<int>, ids array<long>"


# --- index --------------------------------------------------------------------------------------


@dataclass
class Index:
    """table: a row for each shard and term, and one with term "" and the shard's ids; the corpus has n documents with a term and size terms."""

    table: DataFrame
    n: int
    size: int


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = 0
        for batch in batches:
            for _, texts in slices(batch, "text"):
                found = lengths(texts, TERMS)
                n, size = n + int((found > 0).sum()), size + int(found.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "size": [size]})

    found = docs.select("text").mapInArrow(run, "n long, size long").agg(F.sum("n"), F.sum("size")).first()
    return found[0] or 0, found[1] or 0


def saturation(tf: np.ndarray, length: np.ndarray, n: int, size: int) -> np.ndarray:
    """Impact of tf occurrences in documents of a length."""
    m = 75 + 25 * length * n // max(size, 1)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def treaps(bounds: np.ndarray, priority: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(postings in preorder, sizes of left subtrees) of the treaps of lists bounds[i]:bounds[i + 1]; priorities of a list differ.

    All lists are built level by level at once: the highest priority of every open
    part is its root and splits it.
    """
    order, smaller = np.empty(len(priority), np.int64), np.zeros(len(priority), np.int32)
    full = bounds[1:] > bounds[:-1]
    begin, end, out = bounds[:-1][full], bounds[1:][full], bounds[:-1][full]
    while len(begin):
        size = end - begin
        single = size == 1
        order[out[single]] = begin[single]
        begin, end, out, size = (x[~single] for x in (begin, end, out, size))
        if not len(begin):
            break
        first = np.cumsum(size) - size
        at = np.repeat(begin - first, size) + np.arange(int(size.sum()))
        found = priority[at]
        root = at[found == np.repeat(np.maximum.reduceat(found, first), size)]
        order[out], smaller[out] = root, root - begin
        begin, end, out = np.concatenate([begin, root + 1]), np.concatenate([root, end]), np.concatenate([out + 1, out + 1 + root - begin])
        full = end > begin
        begin, end, out = begin[full], end[full], out[full]
    return order, smaller


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _shard_rows(number: int, ids: pa.Array, texts: pa.Array, n: int, size: int) -> pa.RecordBatch:
    order = pc.sort_indices(ids, null_placement="at_start")
    found: Postings = count(texts.take(order), TERMS)
    impact = saturation(found.n, found.lengths[found.doc], n, size)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(found.code)) + 1, [len(found.code)]]) if len(found.code) else np.zeros(1, np.int64)
    among = np.random.default_rng(len(ids)).permutation(len(ids))
    at, smaller = treaps(bounds, impact << 32 | among[found.doc])
    # the shard's ids come last, as one more row without postings
    offsets, k = np.concatenate([bounds, bounds[-1:]]), len(bounds)
    every = pa.ListArray.from_arrays(pa.array([0] * k + [len(ids)], pa.int32()), ids.take(order))
    every = pc.if_else(pa.array([False] * (k - 1) + [True]), every, pa.scalar(None, every.type))
    terms = pa.concat_arrays([found.terms.cast(pa.string()), pa.array([""], pa.string())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), terms, _lists(found.doc[at], offsets, pa.int32()), _lists(impact[at], offsets, pa.int32()), _lists(smaller, offsets, pa.int32()), every], names=["shard", "term", "doc", "impact", "smaller", "ids"])


def build(docs: DataFrame) -> Index:
    """The index of a table with doc_id and text."""
    n, size = totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, texts, docs_, bytes_ = [], [], 0, 0

        def made() -> pa.RecordBatch:
            return _shard_rows(number, pa.concat_arrays(ids), pa.concat_arrays(texts), n, size)

        for batch in batches:
            for part, found in slices(batch, "text", SHARD_BYTES):
                ids.append(part.column("doc_id").cast(pa.int64()))
                texts.append(found)
                docs_, bytes_ = docs_ + len(found), bytes_ + found.nbytes
                if docs_ >= SHARD_DOCS or bytes_ >= SHARD_BYTES:
                    yield made()
                    number += 1
                    ids, texts, docs_, bytes_ = [], [], 0, 0
        if ids:
            yield made()

    return Index(materialise(docs.sparkSession, docs.select("doc_id", "text").mapInArrow(run, INDEX), "treaps"), n, size)


# --- search -------------------------------------------------------------------------------------


@dataclass
class Block:
    """Items of a search: item k has the terms term[first[k]:first[k + 1]], as places in `terms`, `times` each."""

    items: list[int | None]
    terms: list[str]
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray


def blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[Block]:
    """Items cut into blocks, one partition of them at a time on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                found = count(texts, TERMS)
                order = np.argsort(found.doc, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(found.doc, minlength=len(part)))])
                terms = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), found.terms.take(pa.array(found.code[order])).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("item_id").cast(pa.int64()), terms, _lists(found.n[order], offsets, pa.int64())], names=["item_id", "terms", "times"])

    def made(rows: list) -> Block:
        place = {t: k for k, t in enumerate(dict.fromkeys(t for r in rows for t in r.terms))}
        sizes = np.array([len(r.terms) for r in rows])
        return Block([r.item_id for r in rows], list(place), np.concatenate([[0], np.cumsum(sizes)]), np.array([place[t] for r in rows for t in r.terms]), np.array([n for r in rows for n in r.times]))

    rows, seen = [], set()
    for row in items.select("item_id", "text").mapInArrow(run, "item_id long, terms array<string>, times array<long>").toLocalIterator():
        if row.terms and rows and len(seen.union(row.terms)) > most:
            yield made(rows)
            rows, seen = [], set()
        if row.terms:
            rows.append(row)
            seen.update(row.terms)
    if rows:
        yield made(rows)


class Shard:
    """The treaps of a shard's rows, one after the other, by place of the term in the block."""

    def __init__(self, table: pa.Table, place: dict[str, int]):
        own = table.filter(pc.not_equal(table["term"], "")).combine_chunks()
        flat = lambda name: np.concatenate([x.flatten().to_numpy() for x in own[name].chunks] or [np.zeros(0, np.int32)]).astype(np.int64)
        self.doc, self.impact, self.smaller = flat("doc"), flat("impact"), flat("smaller")
        size = pc.list_value_length(own["doc"]).to_numpy().astype(np.int64)
        at = np.array([place[t] for t in own["term"].to_pylist()], np.int64)
        self.begin, self.size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        self.begin[at], self.size[at] = np.cumsum(size) - size, size
        ids = table.filter(pc.equal(table["term"], ""))["ids"]
        self.ids = ids.combine_chunks().flatten() if len(ids) else pa.array([], pa.int64())


@dataclass
class _Ranges:
    """Ranges of documents under walk: item, from, to; and slots, the nodes of treaps in them, in order of ranges."""

    item: np.ndarray
    low: np.ndarray
    high: np.ndarray
    of: np.ndarray
    weight: np.ndarray
    node: np.ndarray
    size: np.ndarray

    def slots(self, keep: np.ndarray) -> _Ranges:
        return _Ranges(self.item, self.low, self.high, self.of[keep], self.weight[keep], self.node[keep], self.size[keep])

    def ranges(self, keep: np.ndarray) -> _Ranges:
        new, slot = np.cumsum(keep) - 1, keep[self.of]
        return _Ranges(self.item[keep], self.low[keep], self.high[keep], new[self.of[slot]], self.weight[slot], self.node[slot], self.size[slot])


class Walk:
    """The best documents of items in a shard."""

    def __init__(self, shard: Shard, top: int, floor: np.ndarray):
        self.shard, self.top = shard, top
        #: by item: the least score that counts, and where the list is full the place of its last document
        self.least, self.last = np.maximum(floor, 1), np.full(len(floor), len(shard.ids))
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.scored = 0

    def _descend(self, node: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Move nodes down, in place, until they stand between low and high; size 0 where there is none."""
        moving = np.flatnonzero(size)
        while len(moving):
            at = self.shard.doc[node[moving]]
            up, down = at < low[moving], at > high[moving]
            off = up | down
            moving, up = moving[off], up[off]
            left = self.shard.smaller[node[moving]]
            size[moving] = np.where(up, size[moving] - 1 - left, left)
            node[moving] += np.where(up, 1 + left, 1)
            moving = moving[size[moving] > 0]

    def _take(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        self.scored += len(item)
        good = score >= self.least[item]
        item, doc, score = (np.concatenate(x) for x in ((self.item, item[good]), (self.doc, doc[good]), (self.score, score[good])))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        best = rank < self.top
        self.item, self.doc, self.score = item[best], doc[best], score[best]
        full = np.flatnonzero(rank == self.top - 1)
        self.least[item[full]] = np.maximum(self.least[item[full]], score[full])
        self.last[item[full]] = doc[full]

    def _outright(self, r: _Ranges) -> None:
        """Score every document of the ranges."""
        first = np.cumsum(r.size) - r.size
        slot = np.repeat(np.arange(len(r.size)), r.size)
        at = np.arange(len(slot)) - first[slot] + r.node[slot]
        of, doc = r.of[slot], self.shard.doc[at]
        inside = (doc >= r.low[of]) & (doc <= r.high[of])
        of, doc, part = of[inside], doc[inside], (r.weight[slot] * self.shard.impact[at])[inside]
        key = of * len(self.shard.ids) + doc
        order = np.argsort(key, kind="stable")
        key = key[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self._take(r.item[of[order][begins]], doc[order][begins], np.add.reduceat(part[order], begins))

    def run(self, items: np.ndarray, first: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Walk the treaps of items; item k has the slots first[k]:first[k + 1]."""
        docs = len(self.shard.ids)
        of = np.repeat(np.arange(len(items)), np.diff(first))
        stack = [_Ranges(items, np.zeros(len(items), np.int64), np.full(len(items), docs - 1), of, weight, self.shard.begin[term], self.shard.size[term])]
        while stack:
            r = stack.pop()
            if len(r.of) > WIDTH and len(r.item) > 1:
                half = np.arange(len(r.item)) < len(r.item) // 2
                stack += [r.ranges(~half), r.ranges(half)]
                continue
            self._descend(r.node, r.size, r.low[r.of], r.high[r.of])
            r = r.slots(r.size > 0)
            if not len(r.of):
                continue
            r = r.ranges(np.bincount(r.of, minlength=len(r.item)) > 0)
            begins = np.flatnonzero(np.concatenate([[True], r.of[1:] != r.of[:-1]]))
            bound = np.add.reduceat(r.weight * self.shard.impact[r.node], begins)
            least = self.least[r.item]
            open_ = (bound > least) | ((bound == least) & (r.low <= self.last[r.item]))
            if not open_.any():
                continue
            r = r.ranges(open_)
            begins = np.flatnonzero(np.concatenate([[True], r.of[1:] != r.of[:-1]]))
            few = np.add.reduceat(r.size, begins) <= LEAF
            if few.any():
                self._outright(r.ranges(few))
                if few.all():
                    continue
                r = r.ranges(~few)
                begins = np.flatnonzero(np.concatenate([[True], r.of[1:] != r.of[:-1]]))
            part = r.weight * self.shard.impact[r.node]
            top = np.flatnonzero(part == np.maximum.reduceat(part, begins)[r.of])
            _, one = np.unique(r.of[top], return_index=True)
            doc = self.shard.doc[r.node[top[one]]]
            node, size = r.node.copy(), r.size.copy()
            self._descend(node, size, doc[r.of], doc[r.of])
            self._take(r.item, doc, np.add.reduceat(np.where(size > 0, r.weight * self.shard.impact[np.minimum(node, len(self.shard.doc) - 1)], 0), begins))
            left = _Ranges(r.item, r.low, doc - 1, r.of, r.weight, r.node.copy(), r.size.copy()).ranges(doc > r.low)
            right = _Ranges(r.item, doc + 1, r.high, r.of, r.weight, r.node, r.size).ranges(doc < r.high)
            stack.append(_Ranges(*(np.concatenate([getattr(left, n), getattr(right, n) + (len(left.item) if n == "of" else 0)]) for n in ("item", "low", "high", "of", "weight", "node", "size"))))


HITS = "item long, doc_id long, score long"


def _hits(rows: DataFrame, block: Block, weight: np.ndarray, floor: np.ndarray, top: int) -> DataFrame:
    """item (place in the block), doc_id and score of the best documents of every shard."""
    place = {t: k for k, t in enumerate(block.terms)}

    def run(table: pa.Table) -> pa.Table:
        shard = Shard(table, place)
        walk = Walk(shard, top, floor.copy())
        has = (shard.size[block.term] > 0) & (weight[block.term] > 0)
        item = np.repeat(np.arange(len(block.items)), np.diff(block.first))[has]
        slots = np.bincount(item, minlength=len(block.items))
        # so many items together that a step of the walk holds about WIDTH slots
        upto, group = np.cumsum(slots * max(1, len(shard.ids) // 8)), 0
        groups = upto // (4 * WIDTH)
        for group in np.unique(groups):
            own = np.flatnonzero((groups == group) & (slots > 0))
            if len(own):
                mine = np.isin(item, own)
                walk.run(own, np.concatenate([[0], np.cumsum(slots[own])]), block.term[has][mine], (block.times * weight[block.term])[has][mine])
        ids = shard.ids.take(pa.array(walk.doc))
        return pa.table({"item": walk.item, "doc_id": ids, "score": walk.score})

    return rows.groupBy("shard").applyInArrow(run, HITS)


def _best(hits: DataFrame, top: int) -> DataFrame:
    """The best hits of each item, with rank; first in parts, so that no item's hits all meet in one task."""
    order = [F.col("score").desc(), F.col("doc_id")]
    part = hits.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))
    near = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("part", "rank")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)


def search(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score: the best documents of every item of a table with item_id and text."""
    spark, out = index.table.sparkSession, None
    for block in blocks(items):
        terms = spark.createDataFrame(pa.table({"term": [*block.terms, ""]}))
        # a block's terms are at most BLOCK_TERMS, or those of one item
        rows = index.table.join(F.broadcast(terms), "term", "left_semi")
        df = {r.term: r.df for r in rows.filter("term <> ''").groupBy("term").agg(F.sum(F.size("doc")).cast("long").alias("df")).collect()}
        weight = np.array([math.floor(1000 * math.log((2 * index.n + 2) / (2 * df[t] + 1))) if t in df else 0 for t in block.terms])
        pilot = [r.shard for r in index.table.filter("term = ''").select("shard").orderBy("shard").limit(PILOT).collect()]
        first = materialise(spark, _hits(rows.filter(F.col("shard").isin(pilot)), block, weight, np.zeros(len(block.items), np.int64), top), "hits")
        floor = np.zeros(len(block.items), np.int64)
        for r in _best(first, top).filter(F.col("rank") == top).collect():
            floor[r.item] = r.score
        hits = first.unionByName(_hits(rows.filter(~F.col("shard").isin(pilot)), block, weight, floor, top)) if pilot else first
        named = spark.createDataFrame(list(enumerate(block.items)), "item long, item_id long")
        found = materialise(spark, _best(hits, top).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"), "found")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


@tidy
def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index docs and search the items in it; the index goes afterwards."""
    return search(build(docs), items, top)


ORACLE = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
tf AS MATERIALIZED (SELECT id, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS MATERIALIZED (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS size FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS MATERIALIZED (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT item, item_id, term, times * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN df USING (term), whole),
scores AS (SELECT item, item_id, id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // size)))) AS BIGINT) AS score FROM w JOIN tf USING (term) JOIN len USING (id), whole GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 20
"""
