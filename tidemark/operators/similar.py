"""Similar signatures: candidate pairs by rare positional grams, without losing any.

Signatures are normalised keys joined by bars, so they have 37 characters. Two of them
are similar where their edit distance is within a share of the longer length. Such a
pair shares a gram among the rarest grams of each: those of lowest frequency, taken
until destroying them all would need more edits than the pair may have. Lists of the
signatures that hold a gram are therefore enough to meet in.

Where most of a table's text is the same in all rows, its rare grams cannot outweigh
the edits allowed, and the lists together hold more pairs than there are. The sizes of
the lists tell so beforehand: then all signatures stand in one list. Either way no
pair is lost, and the pairs to be compared are counted and logged.

Lists are cut into tiles of bounded size. Within a tile pairs are compared side by side
in numpy: by length, by place of the gram, by bitmaps of their two-letter grams, by
their first letters, and those left by bit-parallel edit distance.

The one list of all is cut into few large parts, so that a signature goes to few tiles
and what moves grows with the signatures, not with their pairs. In its tiles a sum over
the two-letter pieces of one side, each looked up for all of the other side at once,
takes the place of the bitmaps (`promising`).
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, keep
from ..workers import ship

LOG = logging.getLogger(__name__)
ALPHABET = "|0123456789abcdefghijklmnopqrstuvwxyz"
_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: 64-bit words of a bitmap of two-letter grams.
WORDS, PAIR = 8, 2
#: Pairs that a task compares, rows of a tile that meet its other side at once, pairs whose distances are computed at once.
TASK_PAIRS, STEP, PAIRS = 4_000_000, 64, 8192
#: Letters after which pairs too far apart are dropped.
CUT = 8
#: Parts into which all signatures are cut, and rows of one at most: a signature moves once a part.
PARTS, PART_ROWS = 12, 131_072
#: Pairs of the one list that cost as much as one pair of a list of rare grams.
CHEAPER = 50
#: Rows of a block within a part, lengths apart in it at most, bytes of its table of pieces.
BLOCK, SPREAD, TABLE = 8192, 3, 32 << 20
#: Places of pieces are gathered where a value of theirs together has so many rows in a block; groups that are tried.
SHARED, NEARBY = 16, 16
#: Letters before and behind a signature: of its own side, of the other.
NONE, OUTSIDE = len(ALPHABET), len(ALPHABET) + 1
#: Longest gram. There are at most 37^3 of them, which is the size of what is sent to tasks.
LONGEST = 3


@dataclass(frozen=True)
class Budget:
    """Edits that pairs may have, and the grams that follow from it."""

    threshold: float

    def edits(self, longer: int) -> int:
        return math.floor((1 - self.threshold) * longer + 1e-9)

    def most(self, length: int) -> int:
        """Edits of a signature of a length with any partner."""
        return self.edits(math.floor(length / self.threshold + 1e-9))

    @property
    def q(self) -> int:
        """Length of grams; 0 where even single letters cannot outnumber the edits."""
        share = self.threshold / max(1 - self.threshold, 1e-9)
        return max(0, min(LONGEST, math.ceil(share - 1e-9) - 1))

    def short(self) -> int:
        """Length up to which a signature has too few grams for its edits; such ones meet all of like length."""
        return max((n for n in range(1, 1000) if self.most(n) and math.ceil((n - self.q + 1) / self.q) <= self.most(n)), default=0)


def _grams(text: str, q: int) -> np.ndarray:
    """Code of the gram at every place."""
    c = _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8) & 127]
    n = max(0, len(c) - q + 1)
    out = np.zeros(n, np.int64)
    for i in range(q):
        out = out * len(ALPHABET) + c[i : i + n]
    return out


def _destroyed(places: np.ndarray, q: int) -> int:
    """The least number of edits that touch every gram at these places."""
    edits, upto = 0, -1
    for p in np.sort(places).tolist():
        if p > upto:
            edits, upto = edits + 1, p + q - 1
    return edits


def rare_places(grams: np.ndarray, rank: np.ndarray, edits: int, q: int) -> np.ndarray:
    """Places of the rarest grams that cannot all be destroyed by so many edits."""
    order = np.lexsort((np.arange(len(grams)), rank[grams]))
    low, high = 0, len(grams)
    while low < high:
        mid = (low + high) // 2
        if _destroyed(order[:mid], q) > edits:
            high = mid
        else:
            low = mid + 1
    return order[:low]


def gram_ranks(signed: DataFrame, q: int) -> np.ndarray:
    """Rank of every gram, rarest first, by counts over all signatures."""
    size = len(ALPHABET) ** q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([_grams(t, q) for t in batch.column(0).to_pylist()] or [np.zeros(0, np.int64)])
            gram, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], names=["gram", "n"])

    counts = signed.select("sig").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(size, np.int64)
    n[counts["gram"].to_numpy()] = counts["n"].to_numpy()
    rank = np.empty(size, np.int64)
    rank[np.lexsort((np.arange(size), n))] = np.arange(size)
    return rank


def gram_lists(signed: DataFrame, budget: Budget, rank: np.ndarray) -> DataFrame:
    """id and the lists it stands in: gram and place; gram -1 for signatures of few grams and those they may match."""
    q, short = budget.q, math.floor(budget.short() / budget.threshold + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grams, places = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _grams(text, q)
                at = rare_places(found, rank, budget.most(len(text)), q)
                ids += [key] * len(at)
                grams += found[at].tolist()
                places += at.tolist()
                if len(text) <= short:
                    ids.append(key)
                    grams.append(-1)
                    places.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.int64()), pa.array(places, pa.int64())], names=["id", "gram", "place"])

    return signed.select("id", "sig").mapInArrow(run, "id long, gram long, place long")


def _gathered(pieces: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, dict[int, np.ndarray]]]:
    """Places gathered where they have few values together, those of few first.

    pieces: by place, its values and the number of each row's. A group has the number of its
    values, that of each row's, and by place the value of each of its own.
    """
    groups: list[tuple[int, np.ndarray, dict[int, np.ndarray]]] = []
    for place in sorted(range(len(pieces)), key=lambda p: len(pieces[p][0])):
        value, key = pieces[place]
        best = None
        for at in range(max(0, len(groups) - NEARBY), len(groups)):
            n, own, _ = groups[at]
            joint, first, inverse = np.unique(own * len(value) + key, return_index=True, return_inverse=True)
            if len(joint) <= max(len(key) // SHARED, n, len(value)) and (best is None or len(joint) < len(best[1])):
                best = at, first, inverse.ravel()
        if best is None:
            groups.append((len(value), key, {place: np.arange(len(value))}))
        else:
            at, first, inverse = best
            n, own, steps = groups[at]
            groups[at] = len(first), inverse, {p: s[own[first]] for p, s in steps.items()} | {place: key[first]}
    return sorted(groups, key=lambda g: g[0])


class Rows:
    """Signatures of a tile, ready to be compared."""

    def __init__(self, texts: list[str], budget: Budget, letters: int, mapped: bool = True):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.codes = np.zeros((len(texts), max(1, int(self.size.max(initial=0)))), np.uint8)
        bits = np.zeros((len(texts) if mapped else 0, 64 * WORDS), np.uint8)
        for k, t in enumerate(texts):
            self.codes[k, : len(t)] = _CODE[np.frombuffer(t.encode("ascii", "replace"), np.uint8) & 127]
            if mapped:
                bits[k, (_grams(t, PAIR) * 2_654_435_761 >> 12) % bits.shape[1]] = 1
        self.maps = np.packbits(bits, axis=1).view(np.uint64).T.copy()
        self.edits = np.array([budget.edits(n) for n in range(self.codes.shape[1] + 1)])[self.size]
        cells = [t.split("|") for t in texts]
        number: dict[str, int] = {}
        width = max(map(len, cells), default=1)
        #: by column, a number for the first letters of its value; 0 for an empty one
        self.prefix = np.array([[number.setdefault(c[:letters], len(number) + 1) if c else 0 for c in [*row, *[""] * (width - len(row))]] for row in cells], np.int64).reshape(len(texts), width)
        self.words = -(-self.codes.shape[1] // 64)
        self.masks = np.zeros((len(texts), len(ALPHABET), self.words), np.uint64)
        row, at = np.nonzero(np.arange(self.codes.shape[1]) < self.size[:, None])
        np.bitwise_or.at(self.masks, (row, self.codes[row, at], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))

    def near(self, left: np.ndarray, right: np.ndarray, place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that lengths, places and bitmaps do not rule out."""
        most = np.maximum(self.edits[left, None], self.edits[right])
        ok = np.abs(self.size[left, None] - self.size[right]) <= most
        if place is not None:
            ok &= np.abs(place[left, None] - place[right]) <= most
        for x, y in ((left[:, None], right), (right, left[:, None])):
            lacks = np.zeros(ok.shape, np.uint8)
            for m in self.maps:
                lacks += np.bitwise_count(m[x] & ~m[y])
            ok &= lacks <= PAIR * most
        i, j = np.nonzero(ok)
        return self.alike(left[i], right[j])

    def alike(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that share the first letters of a column."""
        ok = ((self.prefix[i] == self.prefix[j]) & (self.prefix[i] > 0)).any(axis=1)
        return i[ok], j[ok]

    def blocks(self, own: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Rows in blocks of like length."""
        own = own[np.argsort(self.size[own], kind="stable")]
        size, at = self.size[own], 0
        while at < len(own):
            end = int(np.searchsorted(size, size[at], side="right"))
            if end - at < most // 4:
                end = int(np.searchsorted(size, size[at] + SPREAD, side="right"))
            end = min(at + most, end)
            yield own[at:end]
            at = end

    def promising(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that the two-letter pieces of the left side do not rule out.

        Letters of a pair that are matched lie on diagonals k (place on the right less place
        on the left) with |k| + |k - d| edits at least, d being the difference of lengths. So a
        piece costs no edit where it stands within these diagonals, one at least where only
        a letter of it does, else two. Pieces do not overlap, nor do their edits: the costs of
        all pieces together are a lower bound. Rows in the order of their groups of pieces, those
        of few values first, share the sums they begin with.
        """
        span = int(self.size[left].max(initial=1))
        for own in self.blocks(left, max(16, min(BLOCK, TABLE // span))):
            size = self.size[own]
            span = int(size.max()) + int(size.max()) % 2
            letters = np.full((len(own), span), NONE, np.uint16)
            width = min(span, self.codes.shape[1])
            letters[:, :width] = np.where(np.arange(width) < size[:, None], self.codes[own, :width], NONE)
            pieces = [np.unique(letters[:, p] * 64 + letters[:, p + 1], return_inverse=True) for p in range(0, span, 2)]
            groups = _gathered([(v, k.ravel()) for v, k in pieces])
            keys = np.stack([k for _, k, _ in groups])
            order = np.lexsort(keys[::-1])
            own, size, keys = own[order], size[order], keys[:, order]
            begins = np.r_[0, (keys[:, 1:] != keys[:, :-1]).argmax(axis=0)].tolist()
            steps, edits = keys.T.tolist(), self.edits[own].tolist()
            kind = np.min_scalar_type(span)
            rows = max(16, min(BLOCK, TABLE // (kind.itemsize * sum(n for n, _, _ in groups))))
            for other in self.blocks(right, rows):
                most = int(max(self.edits[own].max(), self.edits[other].max()))
                least_d, most_d = int(self.size[other].min() - size.max()), int(self.size[other].max() - size.min())
                if least_d > most or most_d < -most:
                    continue
                tables = self._costs([v for v, _ in pieces], [p for _, _, p in groups], other, span, -((most - max(least_d, -most)) // 2), (most + min(most_d, most)) // 2, kind)
                upto = {e: np.maximum(self.edits[other], e).astype(kind) for e in set(edits)}
                sums = [np.zeros(len(other), kind) for _ in range(len(groups) + 1)]
                i, j, n = [], [], 0
                for k, (begin, step) in enumerate(zip(begins, steps)):
                    for d in range(begin, len(groups)):
                        np.add(sums[d], tables[d][step[d]], sums[d + 1])
                    hit = np.flatnonzero(sums[-1] <= upto[edits[k]])
                    if len(hit):
                        i.append(np.full(len(hit), own[k]))
                        j.append(other[hit])
                        n += len(hit)
                        if n >= PAIRS:
                            yield np.concatenate(i), np.concatenate(j)
                            i, j, n = [], [], 0
                if n:
                    yield np.concatenate(i), np.concatenate(j)

    def _costs(self, values: list[np.ndarray], groups: list[dict[int, np.ndarray]], other: np.ndarray, span: int, low: int, high: int, kind: np.dtype) -> list[list[np.ndarray]]:
        """By group of places, the least edits of all its values (rows) with each other row (columns), on diagonals low to high."""
        n, before, wide = len(other), max(0, -low), self.codes.shape[1]
        text = np.full((before + max(span + max(0, high) + 1, wide), n), OUTSIDE, np.int64)
        text[before : before + wide] = np.where(np.arange(wide) < self.size[other, None], self.codes[other], OUTSIDE).T
        column = np.arange(n)
        both, found, out = text[:-1] * 64 + text[1:], np.zeros(64 * 64, np.int64), []
        at = text * n + column
        for group in groups:
            total = None
            for place, step in group.items():
                value, p = values[place], 2 * place + before
                has = np.zeros((2, OUTSIDE + 1, n), bool)
                for k in (0, 1):
                    has[k].reshape(-1)[at[p + k + low : p + k + high + 1].reshape(-1)] = True
                has[:, NONE] = False
                a, b = value // 64, value % 64
                cost = np.empty((len(value) + 1, n), kind)
                np.subtract(((a < NONE).astype(kind) + (b < NONE))[:, None], has[0, a] | has[1, b], out=cost[:-1], casting="unsafe")
                found[:] = len(value)
                found[value] = np.arange(len(value))
                cost.reshape(-1)[(found[both[p + low : p + high + 1]] * n + column).reshape(-1)] = 0
                if total is None:
                    total = cost[step]
                else:
                    for row, own in zip(total, step.tolist()):
                        row += cost[own]
            out.append(list(total))
        return out

    def close(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Places of the pairs that their first 64 letters do not put further apart than `most` edits.

        The distance of the first t letters of both, less the difference of their lengths, is a
        lower bound: leaving the diagonal and coming back to its end costs what it may have
        saved. One word holds these rows, and pairs go as soon as their bound is too large.
        """
        at, one = np.arange(len(i)), np.uint64(1)
        least, most = np.minimum(self.size[i], self.size[j]), most + np.abs(self.size[i] - self.size[j])
        plus, minus = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64)
        for t in range(1, min(64, self.codes.shape[1]) + 1):
            equal = self.masks[i, self.codes[j, t - 1], 0]
            down = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            h_plus, h_minus = (minus | ~(across | plus)) << one | one, (plus & across) << one
            plus, minus = h_minus | ~(down | h_plus), h_plus & down
            if t % CUT == 0:
                upto = ~np.uint64(0) >> np.uint64(64 - t)
                bound = t + np.bitwise_count(plus & upto).astype(np.int64) - np.bitwise_count(minus & upto)
                # the first t letters of a shorter one are not there
                stays = np.flatnonzero((bound <= most) | (least < t))
                if len(stays) < len(at):
                    at, i, j, least, most, plus, minus = (x[stays] for x in (at, i, j, least, most, plus, minus))
        return at

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Edit distances of pairs, a column of all their matrices at a time, 64 rows in a word."""
        order = np.argsort(-self.size[j], kind="stable")
        i, j = i[order], j[order]
        size, last = self.size[j], (self.size[i] - 1) // 64
        at = ((self.size[i] - 1) % 64).astype(np.uint64)
        score = self.size[i].copy()
        plus = np.full((self.words, len(i)), ~np.uint64(0))
        minus = np.zeros((self.words, len(i)), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        live = len(i)
        for t in range(int(size[0]) if len(i) else 0):
            live = int(np.searchsorted(-size[:live], -t, side="left"))
            letter = self.codes[j[:live], t]
            in_plus, in_minus = np.ones(live, np.uint64), np.zeros(live, np.uint64)
            for w in range(self.words):
                p, m = plus[w, :live], minus[w, :live]
                equal = self.masks[i[:live], letter, w]
                down = equal | m
                equal |= in_minus
                across = (((equal & p) + p) ^ p) | equal
                h_plus, h_minus = m | ~(across | p), p & across
                ends = last[:live] == w
                step = ((h_plus >> at[:live]) & one).astype(np.int64) - ((h_minus >> at[:live]) & one).astype(np.int64)
                score[:live] += step * ends
                out_plus, out_minus = h_plus >> top, h_minus >> top
                h_plus, h_minus = h_plus << one | in_plus, h_minus << one | in_minus
                plus[w, :live], minus[w, :live] = h_minus | ~(down | h_plus), h_plus & down
                in_plus, in_minus = out_plus, out_minus
        out = np.empty(len(i), np.int64)
        out[order] = score
        return out


def compare_tiles(table: pa.Table, budget: Budget, letters: int) -> pa.Table:
    """a, b and score of the similar pairs of a group of tiles; side 2 of a tile meets itself, side 0 meets side 1."""
    ids, place, side = (table[c].to_numpy() for c in ("id", "place", "side"))
    rows = Rows(table["sig"].to_pylist(), budget, letters)
    tile = np.unique(np.stack([table[c].to_numpy() for c in ("gram", "x", "y")]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(tile, kind="stable")
    found = []
    for own in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
        both = side[own[0]] == 2
        left, right = (own, own) if both else (own[side[own] == 0], own[side[own] == 1])
        for at in range(0, len(left), STEP):
            i, j = rows.near(left[at : at + STEP], right, place)
            if both:
                i, j = i[ids[i] < ids[j]], j[ids[i] < ids[j]]
            for k in range(0, len(i), PAIRS):
                a, b = i[k : k + PAIRS], j[k : k + PAIRS]
                most = np.maximum(rows.edits[a], rows.edits[b])
                left_over = rows.close(a, b, most)
                a, b, most = a[left_over], b[left_over], most[left_over]
                edits = rows.distance(a, b)
                ok = edits <= most
                found.append((ids[a[ok]], ids[b[ok]], edits[ok], np.maximum(rows.size[a], rows.size[b])[ok]))
    return _scored(found, budget)


def parts_of(fresh: int, old: int, max_block: int) -> tuple[int, int]:
    """Parts of fresh signatures, and of all, where all stand in one list; each signature goes to that many tiles at most."""
    size = min(PART_ROWS, max(max_block, -(-(fresh + old) // PARTS)))
    return -(-fresh // size), -(-fresh // size) - (-old // size)


def compare_parts(table: pa.Table, budget: Budget, letters: int) -> pa.Table:
    """What compare_tiles gives, of one tile of the list of all signatures."""
    ids, side = table["id"].to_numpy(), table["side"].to_numpy()
    rows = Rows(table["sig"].to_pylist(), budget, letters, mapped=False)
    own = np.arange(len(ids))
    both = bool(len(side)) and side[0] == 2
    left, right = (own, own) if both else (own[side == 0], own[side == 1])
    # pieces of the lesser side are looked up in the greater
    if len(left) > len(right):
        left, right = right, left
    found, waiting, n = [], [], 0

    def judge() -> None:
        i, j = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            most = np.maximum(rows.edits[a], rows.edits[b])
            left_over = rows.close(a, b, most)
            a, b, most = a[left_over], b[left_over], most[left_over]
            edits = rows.distance(a, b)
            ok = edits <= most
            found.append((ids[a[ok]], ids[b[ok]], edits[ok], np.maximum(rows.size[a], rows.size[b])[ok]))

    for i, j in rows.promising(left, right):
        ok = np.abs(rows.size[i] - rows.size[j]) <= np.maximum(rows.edits[i], rows.edits[j])
        if both:
            ok &= ids[i] < ids[j]
        i, j = rows.alike(i[ok], j[ok])
        waiting.append((i, j))
        n += len(i)
        if n >= 4 * PAIRS:
            judge()
            n = 0
    if waiting:
        judge()
    return _scored(found, budget)


def _scored(found: list[tuple[np.ndarray, ...]], budget: Budget) -> pa.Table:
    """a, b and score of pairs from their ids, edits and longer lengths."""
    a, b, edits, longer = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
    score = 1 - edits / np.maximum(longer, 1)
    kept = score >= budget.threshold
    return pa.table({"a": np.minimum(a, b)[kept], "b": np.maximum(a, b)[kept], "score": score[kept]})


def similar_pairs(signed: DataFrame, threshold: float, letters: int, max_block: int, lists: DataFrame | None = None) -> DataFrame:
    """a, b (ids, a the lesser) and score of all pairs of different signatures that are similar and share a column's prefix.

    signed: id and sig, both unique, written. Lists of over max_block signatures are cut
    into parts that meet pair by pair, so no task holds a whole list; the one list of all
    into those of parts_of. With a column
    `fresh` in signed, only pairs with a fresh signature are compared and returned.
    lists: what gram_lists gives for signed, if it is known, by any ranks.
    """
    spark, budget = signed.sparkSession, Budget(threshold)
    ship(spark)
    whole = "fresh" not in signed.columns
    if whole:
        signed = signed.withColumn("fresh", F.lit(True))
    fresh, old = F.count_if("fresh").alias("fresh"), F.count_if(~F.col("fresh")).alias("old")
    n = signed.agg(fresh, old).first()
    every = n.fresh * (n.fresh - 1) // 2 + n.fresh * n.old
    made, pairs, sizes = None, None, None
    if budget.q:
        if lists is None:
            lists = made = keep(gram_lists(signed, budget, gram_ranks(signed, budget.q)), "grams")
        marked = lists.withColumn("fresh", F.lit(True)) if whole else lists.join(signed.select("id", "fresh"), "id")
        sizes = marked.groupBy("gram").agg(fresh, old).filter("fresh > 0 AND fresh + old > 1")
        met = F.expr("cast(fresh as decimal(20, 0)) * (fresh - 1) / 2 + cast(fresh as decimal(20, 0)) * old")
        pairs = int(sizes.agg(F.coalesce(F.sum(met), F.lit(0))).first()[0])
    by_gram = pairs is not None and pairs * CHEAPER < every
    LOG.info("fuzzy duplicates: %s signatures (%s fresh), %s pairs in lists of rare grams, %s in all; %s are compared", n.fresh + n.old, n.fresh, pairs, every, pairs if by_gram else every)
    if by_gram:
        parts = {"new": F.ceil(F.col("fresh") / max_block), "parts": F.ceil(F.col("fresh") / max_block) + F.ceil(F.col("old") / max_block)}
        rows = lists.join(sizes.select("gram", *[c.alias(k) for k, c in parts.items()]), "gram").join(signed, "id")
    else:
        new, parts = parts_of(n.fresh, n.old, max_block)
        one = {"gram": 0, "place": 0, "new": new, "parts": parts}
        rows = signed.select("id", "sig", "fresh", *[F.lit(v).cast("long").alias(k) for k, v in one.items()])
    # tasks by pairs, not by bytes: few bytes make many pairs
    tasks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(pairs or 0) // TASK_PAIRS))
    # the first parts of a list are its fresh signatures, the others its old ones, which meet fresh ones only
    rows = rows.withColumn("part", F.expr("CASE WHEN fresh THEN pmod(xxhash64(id), new) ELSE new + pmod(xxhash64(id), parts - new) END"))
    # tile (x, y) of a list: part x, on side 0, meets part y, on side 1; tile (x, x) meets itself
    tiles = "transform(sequence(0L, CASE WHEN fresh THEN parts ELSE new END - 1), o -> struct(least(part, o) AS x, greatest(part, o) AS y, CASE WHEN part = o THEN 2 WHEN part < o THEN 0 ELSE 1 END AS side))"
    rows = rows.filter("new > 0").withColumn("t", F.explode(F.expr(tiles))).select("gram", "t.x", "t.y", "t.side", "place", "id", "sig", "new", "parts")
    if by_gram:
        # short lists share groups
        unit = F.when((F.col("new") == 1) & (F.col("parts") <= 2), F.pmod(F.xxhash64("gram"), F.lit(16 * tasks))).otherwise(F.xxhash64("gram", "x", "y"))
        rows = rows.withColumn("unit", unit).drop("new", "parts").repartition(tasks, "unit")
        found = rows.groupBy("unit").applyInArrow(lambda t: compare_tiles(t, budget, letters), "a long, b long, score double")
    else:
        # a task a tile
        rows = rows.select((F.col("x") * F.col("parts") + F.col("y")).alias("unit"), "side", "id", "sig")
        count = max(1, new * (new + 1) // 2 + new * (parts - new))
        found = rows.repartitionByRange(count, "unit").groupBy("unit").applyInArrow(lambda t: compare_parts(t, budget, letters), "a long, b long, score double")
    found = keep(found.dropDuplicates(["a", "b"]) if by_gram else found, "similar")
    if made is not None:
        discard(made)
    return found
