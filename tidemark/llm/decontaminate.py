"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items.

Every text and item is normalised alike: A-Z become a-z, words are runs of ASCII digits, a-z and characters beyond
ASCII. The words of the items are numbered, and texts become sequences of those numbers. A window is ``window``
consecutive item words; a shorter item is one window.

1. Each item is cut into pieces of half a window. Any window of the item holds one of them as a whole, so the pieces
   are the patterns of the automaton: a node for each item word at most, where whole windows would make ten. A shorter
   item is one pattern by its first half window.
2. Each text is scanned once. Where a piece is found, the windows of the text that may hold it are looked up among the
   hashes of all windows of the items and confirmed word by word.
3. Hits are word ranges; they are mapped back to code point offsets in the original text.

What is broadcast is bounded: the items are split by hash into as many blocks as keep each block's text under
``MAX_BLOCK_BYTES``, for which a worker needs about 15 bytes a byte. The texts pass through one automaton for each block,
and what is found is written between blocks, so that no two automata stand in memory. Test sets fit one block.

Defined cases: null or wordless texts have 0 words and no hit; very long texts are scanned whole; null or wordless items
are ignored; items with a null id count under the id ``null``; repeated items count once by id; repeated documents and
those with a null doc_id are judged one by one; columns of the input that clash with the added ones are replaced; empty
tables give no rows (no items: nothing is hit).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, map_batches, materialize, without
from tidemark.llm.sketch import mixed

MAX_BLOCK_BYTES = 8 << 20
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes to bytes: upper to lower case, everything ASCII but digits and letters to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_U = np.uint64


def folded_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class Items:
    """The items of a block: their ids, their words as numbers one item after another, where each begins, the words."""

    ids: list[str]
    words: np.ndarray
    begins: np.ndarray
    vocabulary: list[bytes]

    @classmethod
    def of(cls, rows) -> Items:
        numbers: dict[bytes, int] = {}
        ids, parts = [], []
        for item_id, text in rows:
            if words := folded_words(text):
                ids.append(item_id)
                parts.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int32))
        sizes = np.array([len(p) for p in parts], np.int64)
        return cls(ids, np.concatenate(parts) if parts else np.zeros(0, np.int32), np.r_[0, np.cumsum(sizes)], list(numbers))


def _names(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """64-bit names of the ``size`` words from each start."""
    out = np.full(len(starts), _U(size), _U)
    for k in range(size):
        out = mixed(out * _U(31) + words[starts + k].astype(_U))
    return out


class Index:
    """The automaton of a block and the windows of its items, by size: sorted names, their places, their items."""

    def __init__(self, items: Items, window: int):
        self.items, self.window, self.half = items, window, max(1, window // 2)
        self.number = {w: k for k, w in enumerate(items.vocabulary, 1)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        sizes = np.diff(items.begins)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(items.words))
        left = items.begins[owner + 1] - place if len(owner) else place  # words of the item from here on
        for size in sorted({min(int(n), window) for n in sizes}):
            starts = place[left >= window] if size == window else items.begins[:-1][sizes == size]
            names = _names(items.words, starts, size)
            order = np.argsort(names, kind="stable")
            self.windows[size] = names[order], starts[order], owner[starts[order]]
        for begin, n in zip(items.begins[:-1].tolist(), sizes.tolist(), strict=True):
            for at in range(0, n - self.half + 1, self.half) if n >= window else [0]:
                piece = tuple(items.words[begin + at : begin + min(at + self.half, n)].tolist())
                self.automaton.add_word(piece, len(piece))
        if len(sizes):
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Starts and ends of windows of items in a text, and the ids of those items."""
        numbers = tuple(map(self.number.get, words, [0] * len(words)))
        starts: dict[int, set[int]] = {}
        for end, size in self.automaton.iter(numbers) if len(self.automaton) else ():
            first = end - size + 1
            for n in self.windows:
                if n == self.window:
                    if size == self.half:
                        starts.setdefault(n, set()).update(range(max(0, end + 1 - n), min(first, len(numbers) - n) + 1))
                elif first + n <= len(numbers):
                    starts.setdefault(n, set()).add(first)
        begins, ends, found = [], [], set()
        if starts:
            text = np.array(numbers, np.int32)
        for n, some in starts.items():
            at = np.array(sorted(some), np.int64)
            names, places, owners = self.windows[n]
            of_text = _names(text, at, n)
            low, high = np.searchsorted(names, of_text, "left"), np.searchsorted(names, of_text, "right")
            for a, i, j in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                same = (self.items.words[places[i:j, None] + np.arange(n)] == text[a : a + n]).all(axis=1)
                if same.any():
                    begins.append(a)
                    ends.append(a + n)
                    found.update(self.items.ids[k] for k in owners[i:j][same])
        return begins, ends, found


_built: dict[str, Index] = {}


def _index(broadcast, key: str, window: int) -> Index:
    """Built once in each Python worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Index(broadcast.value, window)
    return _built[key]


def _merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Union of word ranges."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], b))
        else:
            runs.append((a, b))
    return runs


ADDED = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPAN), T.StructField("items_sha256", T.StringType()), T.StructField("__runs", SPAN)]


def _scan(df: DataFrame, broadcast, text: str, window: int) -> DataFrame:
    """One block's hits, merged into those of earlier blocks."""
    key = uuid.uuid4().hex
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    pairs = lambda runs: [{"start": a, "end": b} for a, b in runs]

    def make():
        index = _index(broadcast, key, window)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            counts, hits, items, spans, hashes, ranges = [], [], [], [], [], []
            get = lambda c: batch.column(k) if (k := batch.schema.get_field_index(c)) >= 0 else None
            column, old_runs, old_items = get(text), get("__runs"), get("items")
            for i in range(len(column)):
                own = column[i].as_py()
                words = folded_words(own)
                starts, ends, found = index.find(words) if words else ([], [], set())
                if old_runs is not None:
                    before = old_runs[i].as_py()
                    starts, ends = starts + [r["start"] for r in before], ends + [r["end"] for r in before]
                    found.update(old_items[i].as_py())
                runs = _merged(starts, ends)
                places = [m.span() for m in ITEM_WORD.finditer(own.translate(LOWER))] if runs else []
                counts.append(len(words))
                hits.append(sum(b - a for a, b in runs))
                items.append(sorted(found))
                spans.append(pairs((places[a][0], places[b - 1][1]) for a, b in runs))
                hashes.append(hashlib.sha256(",".join(items[-1]).encode()).hexdigest())
                ranges.append(pairs(runs))
            return [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span), pa.array(hashes, pa.string()), pa.array(ranges, span)]

        return work

    names = {f.name for f in ADDED}
    return map_batches(df, make, ADDED, [c for c in df.columns if c not in names])


def find_contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (ids as sorted strings), spans (code points in the
    original text, end exclusive), items_sha256 and contaminated."""
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // max_block_bytes))
    out = without(docs, *[f.name for f in ADDED], "n_items", "contaminated")
    rest, written = out.columns, None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block)
        out = _scan(out, spark.sparkContext.broadcast(Items.of((r["id"], r["t"]) for r in part.toLocalIterator())), text, window)
        if block < blocks - 1:
            out, before = materialize(out), written
            written = out
            if before is not None:
                discard(before)
    return out.select(*[F.col(f"`{c}`") for c in rest], "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


#: A-Z to a-z by code point; lengths do not change.
LOWER = {c: c + 32 for c in range(65, 91)}
