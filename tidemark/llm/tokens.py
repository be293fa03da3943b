"""Token counts by rank-synchronous array merging.

The vocabulary file is read as data (pieces and scores); the library itself is not called. A text becomes
symbols: spaces are U+2581, one such mark goes in front, and each character is a symbol. No piece holds a
mark after another character, so marks start pre-tokens that merge on their own; counts of pre-tokens add up.

The distinct pre-tokens of a batch (told apart by 64-bit names summed from their symbols) that were not met
before are held as one ragged numpy array. In each round
every sequence finds the lowest rank among its neighbouring pairs, the leftmost if several share it, and all
sequences apply their pair at once; finished sequences leave the array. The surviving symbols count: 1 for a
piece, and the UTF-8 bytes of a character that no piece stands for. Sequences of more than ``LONG`` symbols
merge by a heap with the same order, as one round for each merge would take quadratic time there.

Defined cases: a null text counts as empty, an empty text has no tokens; marker strings such as ``<s>``
inside a text are ordinary characters; repeated rows are counted one by one; columns of the input that clash
with the added ones are replaced.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches, texts_of, without

MARK = "▁"
LONG = 512
#: Pre-tokens whose counts a worker remembers; beyond that it starts anew from those of the last batch.
REMEMBERED = 1_500_000
#: No pair has this rank.
WORST = np.int64(1 << 30)
NORMAL = 1


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Merger:
    """Pair ranks of one vocabulary and the merging of batches of pre-tokens."""

    def __init__(self, model: bytes):
        pieces: dict[str, float] = {}
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                if own.get(3, NORMAL) == NORMAL:
                    pieces[own[1].decode()] = float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
        assert not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces), "pre-tokens would not be independent"
        ranks = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.n_pieces = len(pieces)
        for p in pieces:
            for c in p:
                self.ids.setdefault(c, len(self.ids))
        self.width = len(self.ids) + 8  # beyond: characters of no piece, by their number of bytes
        pairs: dict[int, tuple[int, int]] = {}
        for p, score in pieces.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (ranks[score], self.ids[p])
        keys = np.array(sorted(pairs), np.int64)
        self.keys = keys
        self.values = np.array([pairs[k] for k in keys.tolist()], np.int64).reshape(-1, 2)
        self.pairs = pairs
        self.cost = np.ones(self.width, np.int64)
        for c, i in self.ids.items():
            if i >= self.n_pieces:
                self.cost[i] = len(c.encode("utf-8", "surrogatepass"))
        for n in range(1, 5):
            self.cost[len(self.ids) + n] = n
        self.of_point = np.zeros(0x110000, np.int32)
        for n, first in enumerate((0, 0x80, 0x800, 0x10000), 1):
            self.of_point[first:] = len(self.ids) + n
        for c, i in self.ids.items():
            if len(c) == 1:
                self.of_point[ord(c)] = i
        self.of_point[ord(" ")] = self.ids[MARK]
        self.mix = np.random.default_rng(5).integers(0, 1 << 63, LONG + 2, np.uint64) * np.uint64(2) + np.uint64(1)
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; WORST where there is none."""
        key = a.astype(np.int64) * self.width + b
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[place] == key
        return np.where(found, self.values[place, 0], WORST), self.values[place, 1]

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each sequence; ``flat`` holds the symbols of all, one after another."""
        out = np.zeros(len(lengths), np.int64)
        owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        rank, made = np.full(len(flat), WORST), np.zeros(len(flat), np.int64)
        if len(flat) > 1:
            rank[:-1], made[:-1] = self._look_up(flat[:-1], flat[1:])
            rank[:-1][owner[1:] != owner[:-1]] = WORST
        while len(flat):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sized = np.diff(np.r_[starts, len(flat)])
            # of each sequence, the first place of its lowest rank
            best = np.minimum.reduceat((rank << 32) + np.arange(len(flat)), starts)
            open_ = (best >> 32) < WORST
            left = best[open_] & 0xFFFFFFFF
            gone = ~np.repeat(open_, sized)
            if not open_.all():
                own = owner[gone]
                out += np.bincount(own, self.cost[flat[gone]], len(out)).astype(np.int64)
            flat[left] = made[left]
            gone[left + 1] = True
            stay = ~gone
            now = np.cumsum(stay)[left] - 1
            flat, owner, rank, made = flat[stay], owner[stay], rank[stay], made[stay]
            # only pairs beside a merge have changed
            for i in (now, now[now > 0] - 1):
                j = np.minimum(i + 1, len(flat) - 1)
                r, m = self._look_up(flat[i], flat[j])
                rank[i], made[i] = np.where((i < j) & (owner[i] == owner[j]), r, WORST), m
        return out

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; pre-tokens that were not met before are merged together."""
        out = np.zeros(len(texts), np.int64)
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return out
        points = np.frombuffer("".join([MARK + texts[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum([0, *(len(texts[i]) + 1 for i in some[:-1])])
        symbols = self.of_point[points]
        mark = symbols == self.ids[MARK]
        start = mark.copy()
        start[1:] &= ~mark[:-1]
        start[begin] = True
        starts = np.flatnonzero(start)
        lengths = np.diff(np.r_[starts, len(symbols)])
        place = np.minimum(np.arange(len(symbols)) - np.repeat(starts, lengths), LONG)
        names = np.add.reduceat((symbols.astype(np.uint64) + np.uint64(1)) * self.mix[place], starts) + lengths.astype(np.uint64) * self.mix[-1]
        distinct, first, back = np.unique(names, return_index=True, return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        if len(self.known[0]):
            at = np.minimum(np.searchsorted(self.known[0], distinct), len(self.known[0]) - 1)
            fresh = self.known[0][at] != distinct
            counts[~fresh] = self.known[1][at[~fresh]]
        else:
            fresh = np.ones(len(distinct), bool)
        fresh &= lengths[first] <= LONG
        if fresh.any():
            sized = lengths[first[fresh]]
            shift = np.cumsum(sized) - sized
            taken = np.arange(sized.sum()) + np.repeat(starts[first[fresh]] - shift, sized)
            counts[fresh] = self.merge(symbols[taken].astype(np.int64), sized)
            if len(self.known[0]) + fresh.sum() > REMEMBERED:
                self.known = distinct, counts
            else:
                both = np.r_[self.known[0], distinct[fresh]]
                order = np.argsort(both, kind="stable")
                self.known = both[order], np.r_[self.known[1], counts[fresh]][order]
        each = counts[back]
        for i in np.flatnonzero(lengths > LONG):
            each[i] = self._one_long(symbols[starts[i] : starts[i] + lengths[i]].tolist())
        of_text = np.searchsorted(begin, starts, "right") - 1
        out[some] = np.bincount(of_text, each, len(some)).astype(np.int64)
        return out

    def _one_long(self, row: list[int]) -> int:
        after, before, alive = list(range(1, len(row) + 1)), list(range(-1, len(row) - 1)), [True] * len(row)
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(row):
                pair = self.pairs.get(row[i] * self.width + row[after[i]])
                if pair:
                    heapq.heappush(heap, (pair[0], i, row[i], row[after[i]]))

        for i in range(len(row)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= len(row) or row[i] != a or row[j] != b:
                continue
            row[i] = self.pairs[a * self.width + b][1]
            alive[j] = False
            after[i] = after[j]
            if after[i] < len(row):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return sum(int(self.cost[s]) for s, live in zip(row, alive, strict=True) if live)


_mergers: dict[bytes, Merger] = {}


def count_tokens(docs: DataFrame, model: bytes, *, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    ``model`` is the content of a sentencepiece BPE model file with the identity normaliser; vocabularies have
    tens of thousands of entries, so it is sent with the tasks.
    """

    def make():
        if model not in _mergers:
            _mergers[model] = Merger(model)
        merger = _mergers[model]

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            sizes, counts, held, size = [], [np.zeros(0, np.int64)], [], 0
            for t in texts_of(batch, text):
                t = t or ""
                sizes.append(len(t.encode("utf-8", "surrogatepass")))
                held.append(t)
                size += len(t)
                if size > 3_000_000:
                    counts.append(merger.count_texts(held))
                    held, size = [], 0
            counts.append(merger.count_texts(held))
            return [pa.array(sizes, pa.int64()), pa.array(np.concatenate(counts), pa.int64())]

        return work

    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    out = map_batches(without(docs, "n_bytes", "n_tokens", "over_limit"), make, added)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
