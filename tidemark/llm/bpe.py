"""Byte-pair encoding with a SentencePiece model, in vectorised merge rounds.

A text is normalised (spaces become U+2581, one is put in front) and cut where
no piece of the vocabulary can reach across: before every run of U+2581 and
around line feeds. Those chunks are encoded independently and remembered.

Chunks are merged many at a time over flat numpy arrays: each round finds every
chunk's smallest pair rank, merges all its non-overlapping leftmost
occurrences, and compacts the arrays, until no pair is left. Merging several
occurrences at once equals merging them one by one unless a fresh pair ranks at
or below the pair just merged; chunks where that happens, and very long ones,
are redone by a heap, one merge at a time.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np

SPACE = "▁"
NONE = np.int32(2**30)
UNKNOWN = 1 << 21
LONG = 2048
#: Symbols merged together: the arrays of a round stay in a core's cache.
BLOCK = 1 << 16
_UNITS = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*")


class PieceModel:
    """Vocabulary, pair ranks and byte tables of one .model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        is_byte = [sp.is_byte(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(self.pieces) if not special[i] and not is_byte[i]}
        if any(a != SPACE and b == SPACE for p in normal for a, b in zip(p, p[1:])) or any("\n" in p and len(p) > 1 for p in normal):
            raise ValueError("this model has pieces that reach across words; chunks cannot be encoded apart")
        self.byte_ids = np.full(256, sp.unk_id(), np.int64)
        for i in range(n):
            if is_byte[i]:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        # characters that occur only inside longer pieces get symbols of their own
        symbol = dict(normal)
        for p in normal:
            for c in p:
                symbol.setdefault(c, UNKNOWN + ord(c))
        self.char_ids = np.arange(UNKNOWN, UNKNOWN + 0x110000, dtype=np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char_ids[ord(c)] = i
        scores = {i: sp.get_score(i) for i in normal.values()}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 22) | b] = (rank_of[scores[i]], i)
        self.pairs = pairs
        # open addressing with linear probing, at most a quarter full
        self.bits = max(4, (4 * len(pairs)).bit_length())
        slots = 1 << self.bits
        self.keys, self.ranks, self.merged = np.full(slots + 64, -1, np.int64), np.full(slots + 64, NONE, np.int32), np.full(slots + 64, -1, np.int32)
        all_keys = np.fromiter(pairs, np.int64, len(pairs))
        for k, at in zip(all_keys.tolist(), self._slot(all_keys).tolist()):
            while self.keys[at] != -1:
                at += 1
            self.keys[at], (self.ranks[at], self.merged[at]) = k, pairs[k]
        surface = [b"" if special[i] and not sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if is_byte[i] else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.spaced = np.array([i in scores and p.startswith(SPACE) for i, p in enumerate(self.pieces)])
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.concatenate([[0], np.cumsum(self.surface_len)[:-1]])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a.astype(np.int64) << 22) | b
        at = self._slot(key)
        there = self.keys[at]
        missed = np.flatnonzero((there != key) & (there != -1))
        while len(missed):
            at[missed] += 1
            there = self.keys[at[missed]]
            missed = missed[(there != key[missed]) & (there != -1)]
        return self.ranks[at], self.merged[at]

    def _one_by_one(self, chars: np.ndarray) -> list[int]:
        """The same merges by a heap of (rank, position)."""
        sym = self.char_ids[chars].tolist()
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (found := self.pairs.get((sym[i] << 22) | sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = made, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [s for s, ok in zip(sym, alive) if ok]

    def _merge(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and the chunk of each, in order."""
        out_sym, out_word, redo = [], [], []
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        sym = self.char_ids[chars]
        if (lengths > LONG).any():
            redo.append(np.flatnonzero(lengths > LONG))
            keep = ~np.isin(word, redo[0])
            sym, word = sym[keep], word[keep]
        rank = np.full(len(sym), NONE, np.int32)
        made = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self._rank(sym[:-1], sym[1:])
            rank[:-1][word[:-1] != word[1:]] = NONE
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            if (over := least == NONE).any():
                gone = np.repeat(over, size)
                out_sym.append(sym[gone])
                out_word.append(word[gone])
                stay = ~gone
                sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
                least, size = least[~over], size[~over]
                if not len(sym):
                    break
            limit = np.repeat(least, size)
            pick = rank == limit
            # of consecutive candidates every second one, from the left
            at = np.flatnonzero(pick)
            new_run = np.concatenate([[True], (at[1:] != at[:-1] + 1)])
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            # the pair with the right neighbour as it is before that is merged itself
            right = np.minimum(at + 2, len(sym) - 1)
            between, _ = self._rank(made[at], sym[right])
            bad = (between <= rank[at]) & (word[right] == word[at]) & (right == at + 2)
            wrong = word[at[bad]]
            merged_rank = rank[at]
            sym[at] = made[at]
            drop = np.ones(len(sym), bool)
            drop[at + 1] = False
            where = np.cumsum(drop) - 1
            sym, word, rank, made = sym[drop], word[drop], rank[drop], made[drop]
            now = where[at]
            for near in (now, now - 1):
                ok = (near >= 0) & (near < len(sym) - 1)
                i = near[ok]
                r, m = self._rank(sym[i], sym[i + 1])
                r[word[i] != word[i + 1]] = NONE
                rank[i], made[i] = r, m
                low = r <= merged_rank[ok]
                wrong = np.concatenate([wrong, word[i[low]]])
            tail = now[now == len(sym) - 1]
            rank[tail] = NONE
            if len(wrong):
                wrong = np.unique(wrong)
                redo.append(wrong)
                keep = ~np.isin(word, wrong)
                sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
        if redo:
            ends = np.cumsum(lengths)
            for w in np.concatenate(redo).tolist():
                got = self._one_by_one(chars[ends[w] - lengths[w] : ends[w]])
                out_sym.append(np.array(got, np.int32))
                out_word.append(np.full(len(got), w, np.int32))
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each normalised chunk as little-endian 32-bit; none may be empty."""
        out: list[bytes] = []
        if not units:
            return out
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        block = (np.cumsum(lengths) - lengths) // BLOCK
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(units)]
        for lo, hi in zip(edges, edges[1:]):
            out += self._encode_block(units[lo:hi], lengths[lo:hi])
        return out

    def _encode_block(self, units: list[str], lengths: np.ndarray) -> list[bytes]:
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        sym, word = self._merge(chars, lengths)
        if (raw := sym >= UNKNOWN).any():
            n = np.ones(len(sym), np.int64)
            code = sym - UNKNOWN
            n[raw] = 1 + (code[raw] > 0x7F) + (code[raw] > 0x7FF) + (code[raw] > 0xFFFF).astype(np.int64)
            flat, word = np.repeat(sym, n), np.repeat(word, n)
            flat[np.repeat(raw, n)] = self.byte_ids[np.frombuffer("".join(map(chr, code[raw].tolist())).encode(), np.uint8)]
            sym = flat
        cuts = (4 * np.searchsorted(word, np.arange(len(units) + 1))).tolist()
        flat = sym.astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, through one table of their distinct chunks."""
        split = [chunks(t) for t in texts]
        known = list(set().union(*split)) if split else []
        ids = dict(zip(known, self.encode_units([unit(k) for k in known])))
        return [np.frombuffer(b"".join([ids[k] for k in keys]), "<i4") for keys in split]

    def decode_bytes(self, ids: np.ndarray, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of many id lists laid end to end; starts: where each begins.

        The space that the encoder put in front of a text goes again. Returns the
        bytes and the offset at which each text begins.
        """
        ids = np.asarray(ids, np.int64)
        size = self.surface_len[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ids) else 0
        index = np.repeat(self.surface_at[ids] - (ends - size), size) + np.arange(total)
        flat = self.surface[index]
        begin = np.concatenate([[0], ends])[starts] if len(ids) else np.zeros(len(starts), np.int64)
        stop = np.append(begin[1:], total)
        has = stop > begin
        lead = has.copy()
        lead[has] = self.spaced[ids[np.asarray(starts)[has]]]
        cut = np.ones(total, bool)
        cut[begin[lead]] = False
        moved = np.concatenate([[0], np.cumsum(cut)])
        return flat[cut].tobytes(), moved[np.append(begin, total)]

    def decode(self, ids: list[int]) -> str:
        raw, _ = self.decode_bytes(np.array(ids, np.int64), np.array([0]))
        return raw.decode("utf-8", errors="replace")


def chunks(text: str) -> list[str]:
    """Keys of a text's independent chunks, in order; see unit()."""
    if not text:
        return []
    if SPACE not in text and text[0] != " ":
        spread = text.replace("\n", " \n")
        if "  " not in spread:
            return spread.split(" ")
    found = _UNITS.findall(SPACE + text.replace(" ", SPACE))
    return [u if u[0] == "\n" else u[1:] for u in found]


def unit(key: str) -> str:
    """The normalised chunk of a key: U+2581 in front, unless a line feed leads."""
    return key if key[:1] == "\n" else SPACE + key


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    return PieceModel(path)
