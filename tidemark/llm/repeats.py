"""Suffix-array dedup: bytes of ``length``-byte strings that an earlier document holds are removed.

The suffixes that matter are those of repeated strings, and their order is found by merging Burrows-Wheeler
transforms of shards, never by sorting all suffixes together:

1. Texts are packed into shards of about 160 kB, written once as a table. A longer text is cut into shards that overlap
   by ``length`` - 1 bytes, and put together again at the end.
2. In every ``length``-byte window the ``GRAM``-byte string with the least hash is its anchor (the rightmost, if
   several are equal). The windows of one anchor follow each other and make a segment. An anchor is chosen by the
   content of a window alone, so equal windows have equal anchors. Anchors are dealt by hash into buckets, with a
   name of their segment and the doc_id.
3. In a bucket, equal segments are told from others. All windows of a segment that an earlier document holds as a whole are repeated;
   an anchor with one document only has no repeats; what is left are the first copies of different segments of one
   anchor that agree with another in the bytes before or after it.
   Equal segments of a shard go there once. An anchor with more than ``hot`` different segments (a passage that very
   many documents surround differently) is cut into its windows, each dealt by its own content.
4. Those come together in buckets with their bytes. The segments of neighbouring shards, about 64 kB, are a piece; each
   piece's transform is made, and the transforms are merged by refining their interleave: where the rows stand in order of their first h
   bytes, a stable distribution by the five bytes before, which are a letter, gives the order by h + 5 bytes. A row
   boundary that appears then has a common prefix of h to h + 4 bytes, so at ``length`` bytes the rows between boundaries are the
   intervals of repeated strings. A window is repeated if the least doc_id of its interval is less than its own.
5. Marks go back to the shards, which cover and cut the texts.

Every table that is broadcast is counted first and joined by a shuffle beyond ``BROADCAST_BYTES``.

Defined cases: null texts count as empty; texts shorter than ``length`` keep all; very long texts take the memory of
their bytes a few times, and only where the result is put together; a null doc_id comes after all others; rows with
equal doc_id are one document, so they do not repeat each other; further columns are ignored, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Steps, materialize, workers
from tidemark.llm.sketch import mixed

GRAM = 16
SHARD_BYTES = 160 << 10
#: Most bytes of an Arrow batch while the operator runs.
BATCH_BYTES = 2 << 20
ANCHORS_PER_BUCKET = 500_000
#: Bytes of strings that come together, and of one of the pieces whose transforms are merged.
BUCKET_BYTES, PIECE_BYTES = 1 << 21, 1 << 16
#: Parts of a bucket that are ordered one by one, so that their rows stay in the processor's cache.
PARTS = 8
#: Bytes of a letter of the transforms.
LETTER = 5
BROADCAST_BYTES = 64 << 20
#: Tasks that a shuffle by buckets has at most, unless the session asks for more.
TASKS = 2000
LAST = np.int64((1 << 63) - 1)
_U = np.uint64
_LETTERS = mixed(np.arange(1, 257, dtype=_U))
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_known_powers: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers 0..n-1, kept in the worker between shards of usual size."""
    have = _known_powers.get(int(base))
    if have is None or len(have) < n:
        have = np.cumprod(np.r_[_U(1), np.full(max(0, n - 1), base, _U)], dtype=_U)
        if n <= 4 * SHARD_BYTES:
            _known_powers[int(base)] = have
    return have[:n]


class Segments:
    """Anchors and segments of a shard: ``data`` holds the texts one after another, ``lengths`` their bytes."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, length: int):
        n = len(data) - length + 1
        self.first = self.count = self.doc = self.place = np.zeros(0, np.int64)
        self.anchor = self.name = self.beside = np.zeros(0, _U)
        if n <= 0:
            return
        # hashes of all GRAM-byte strings by doubling
        h, step = _LETTERS[data], 1
        while step < GRAM:
            h = h[:-step] * _U((int(_STEP) * (2 * step + 1)) % (1 << 64)) + h[step:]
            step *= 2
        h = mixed(h)
        # the least (hash, later place first) of each window
        least = (h & _U(0xFFFFFFFF00000000)) | (_U(0xFFFFFFFF) - np.arange(len(h), dtype=_U))
        span, have = length - GRAM + 1, 1
        while have < span:
            more = min(have, span - have)
            least = np.minimum(least[:-more], least[more:])
            have += more
        place = (_U(0xFFFFFFFF) - (least & _U(0xFFFFFFFF))).astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        inside = owner[:n] == owner[length - 1 :]
        change = np.r_[True, (place[1:] != place[:-1]) | (owner[1:n] != owner[: n - 1]) | (inside[1:] != inside[:-1])]
        starts = np.flatnonzero(change)
        counts = np.diff(np.r_[starts, n])
        real = inside[starts]
        self.first, self.count = starts[real], counts[real]
        self.doc = owner[self.first]
        self.anchor = h[place[self.first]]
        self.place = place[self.first]
        self.sums = np.r_[_U(0), np.cumsum(_LETTERS[data] * _powers(_STEP, len(data)), dtype=_U)]
        self.back = _powers(_BACK, len(data))
        self.name = self.name_of(self.first, self.count + length - 1)

        # 32 bits each for the bytes before and after the anchor; a place that stands for itself where they are too few
        half = (length - GRAM) // 2
        own = mixed(self.first.astype(_U) + self.name) >> _U(32)
        before, behind = self.place - self.first >= half, self.first + self.count + length - 1 - self.place - GRAM >= half
        size = np.full(len(self.place), half)
        left = np.where(before, self.name_of(np.where(before, self.place - half, 0), size) >> _U(32), own)
        right = np.where(behind, self.name_of(np.where(behind, self.place + GRAM, 0), size) >> _U(32), own)
        self.beside = (left << _U(32)) | right

    def name_of(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """64-bit names of strings by their place and size."""
        return mixed((self.sums[first + size] - self.sums[first]) * self.back[first] + size.astype(_U))


#: Stands after each string of a piece; UTF-8 has no such byte.
END = 255


def joined(strings: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The strings that follow each other in ``strings``, with END after each."""
    text = np.full(len(strings) + len(sizes), END, np.uint8)
    inside = np.ones(len(text), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    text[inside] = strings
    return text


def transform(text: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order (by the first ``depth`` bytes at least) and transform of one piece, by prefix doubling. A letter of
    the transform is the LETTER bytes before a suffix, named by its place in the piece's sorted alphabet, the third result.

    ``text`` holds strings of ``sizes`` bytes with END after each; a string is followed by itself.
    """
    n = len(text)
    size = np.repeat(sizes + 1, sizes + 1)
    into = np.arange(n) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    begin = np.arange(n) - into
    shortest = int(sizes.min()) + 1

    def turned(k: int) -> np.ndarray:
        """The places ``k`` bytes on, or back."""
        at = into + k
        if 0 <= k <= shortest:
            at -= size * (at >= size)
        else:
            at %= size
        return at + begin

    letter = text.astype(np.int64)
    pairs = letter << 8 | letter[turned(1)]
    alphabet, code = np.unique((pairs << 16 | pairs[turned(2)]) << 8 | letter[turned(4)], return_inverse=True)
    m = len(alphabet)
    key, have = code * m + code[turned(LETTER)], 2 * LETTER
    if m < 1 << 21:  # three names fill 63 bits
        key, have = key * m + code[turned(have)], have + LETTER
    while True:
        order = np.argsort(key)
        ordered = key[order]
        if have >= depth:
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        key = rank * n + rank[turned(have)]
        have *= 2
    return order, code[turned(-LETTER)][order].astype(np.int32), alphabet


def _by(letters: np.ndarray, size: int) -> np.ndarray:
    """Stable order by letters below ``size``, 16 bits at a time."""
    if size <= 1 << 16:
        return np.argsort(letters.astype(np.uint16), kind="stable")
    order = np.argsort((letters & 0xFFFF).astype(np.uint16), kind="stable")
    return order[_by((letters >> 16)[order], (size >> 16) + 1)]


def merge(transforms: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the transforms' rows, as rows of all transforms after one another, and the interval (equal
    first ``depth`` bytes) of each row. A transform comes as its letters and their alphabet."""
    kind = np.uint8 if len(transforms) <= 256 else np.uint16 if len(transforms) <= 65536 else np.int64
    piece = np.repeat(np.arange(len(transforms), dtype=kind), [len(t) for t, _ in transforms])
    alphabet = np.unique(np.concatenate([own for _, own in transforms]))
    letters_of = np.concatenate([np.searchsorted(alphabet, own).astype(np.int32)[t] for t, own in transforms])
    rows = np.arange(len(piece), dtype=np.int32)  # what stands where in the present interleave
    straight = rows.copy()
    interval = np.zeros(len(piece), np.int32)
    new = np.empty(len(piece), bool)
    rounds = [(letters_of, len(alphabet))] * (depth // LETTER)
    if depth % LETTER:  # the first round takes the bytes left over, the last ones of a letter
        few, name = np.unique(alphabet & ((1 << 8 * (depth % LETTER)) - 1), return_inverse=True)
        rounds.insert(0, (name.astype(np.int32)[letters_of], len(few)))
    for named, size in rounds:
        letters = named[rows]
        order = _by(letters, size)
        letters, came, piece = letters[order], interval[order], piece[order]
        new[0] = False
        np.not_equal(letters[1:], letters[:-1], out=new[1:])
        new[1:] |= came[1:] != came[:-1]
        before, interval = interval[-1], np.cumsum(new, dtype=np.int32)
        # rows of a piece keep their order, so the interleave alone tells which row stands where
        rows[np.argsort(piece, kind="stable")] = straight
        if interval[-1] == before and before:
            break  # strings that are equal now are equal for good
    return rows, interval


def repeated_windows(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """Of each piece (doc_ids and sizes of its strings, and the strings one after another), which windows of its
    strings an earlier document has.

    Equal strings of one window, of which a passage that most shards hold gives one for each shard, are ordered once, for their
    least doc_id: so memory grows with the contents, not with the shards.
    """
    ids, sizes = (np.concatenate([p[k] for p in pieces]) for k in (0, 1))
    first, strings = np.cumsum(sizes) - sizes, np.concatenate([p[2] for p in pieces])
    single = np.flatnonzero(sizes == length)
    kept = np.ones(len(sizes), bool)
    if len(single):
        content = np.lib.stride_tricks.sliding_window_view(strings, length)[first[single]].view(np.dtype((np.void, length))).ravel()
        least, of = firsts(ids[single], np.unique(content, return_inverse=True)[1])
        kept[single] = False
        kept[single[least]] = True
    del strings
    ends = np.cumsum([0, *(len(p[1]) for p in pieces)])
    left = [kept[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    found = iter(_ordered([(i[k], n[k], s[np.repeat(k, n)]) for (i, n, s), k in zip(pieces, left, strict=True) if k.any()], length))
    out = []
    for (_, n, _), k in zip(pieces, left, strict=True):
        count = n - length + 1
        flags = np.zeros(int(count.sum()), bool)
        if k.any():
            flags[np.repeat(k, count)] = next(found)
        out.append(flags)
    if not kept.all():
        at = np.cumsum(np.concatenate([n - length + 1 for _, n, _ in pieces])) - 1  # a string's last window, its only one here
        every = np.concatenate(out)
        every[at[single]] = every[at[single[least]]][of] | (ids[single] > ids[single[least]][of])
        out = np.split(every, np.cumsum([len(flags) for flags in out])[:-1])
    return out


def _ordered(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """``repeated_windows`` by the order of all strings."""
    made, docs, whole, wheres = [], [], [], []
    for ids, sizes, strings in pieces:
        order, letters, alphabet = transform(joined(strings, sizes), sizes, length)
        rest = (np.repeat(np.cumsum(sizes + 1), sizes + 1) - np.arange(len(letters)))[order]  # bytes up to END, with it
        made.append((letters, alphabet))
        docs.append(np.repeat(ids, sizes + 1)[order])
        whole.append(rest > length)
        wheres.append(order)
    rows, interval = merge(made, length)
    all_docs, all_whole = np.concatenate(docs)[rows], np.concatenate(whole)[rows]
    starts = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
    least = np.minimum.reduceat(np.where(all_whole, all_docs, LAST), starts)[interval]
    hit = np.empty(len(rows), bool)
    hit[rows] = all_whole & (least < all_docs)
    out, at = [], 0
    for order, own in zip(wheres, whole, strict=True):
        flat, window = np.empty(len(order), bool), np.empty(len(order), bool)
        flat[order], window[order] = hit[at : at + len(order)], own
        out.append(flat[window])
        at += len(order)
    return out


def _gathered(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the strings' bytes, string after string."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _shards(docs: DataFrame, text: str, doc_id: str, shard_bytes: int, length: int) -> DataFrame:
    """(shard, ids, known, lengths, data, long, at): a row for about ``shard_bytes`` bytes of texts.

    A text of more bytes is cut into rows of its own: ``long`` names it, ``at`` is the place of the row's first byte, and
    ``length`` - 1 bytes of the next row stand at the end of each, so that every window is in one row.
    """
    kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
    names = ["shard", "ids", "known", "lengths", "data", "long", "at"]

    def row(ids: list, parts: list[bytes], long: bytes | None = None, at: int = 0) -> pa.RecordBatch:
        lengths, data = [len(p) for p in parts], b"".join(parts)
        numbers = [i if i is not None else int(LAST) for i in ids]
        shard = hashlib.blake2b(repr((numbers, lengths, long, at)).encode() + data, digest_size=16).digest()
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((shard, numbers, [i is not None for i in ids], lengths, data, long, at), kinds, strict=True)], names=names)

    def run(batches):
        ids, parts, size = [], [], 0
        for batch in batches:
            own, texts = batch.column(0), batch.column(1)
            for at in range(0, len(own), 256):
                for i, t in zip(own.slice(at, 256).to_pylist(), texts.slice(at, 256).to_pylist(), strict=True):
                    data = (t or "").encode("utf-8", "surrogatepass")
                    if len(data) > shard_bytes:
                        long = hashlib.blake2b(repr(i).encode() + data, digest_size=16).digest()
                        for k in range(0, len(data), shard_bytes):
                            yield row([i], [data[k : k + shard_bytes + length - 1]], long, k)
                        continue
                    ids.append(i)
                    parts.append(data)
                    size += len(data)
                    if size >= shard_bytes:
                        yield row(ids, parts)
                        ids, parts, size = [], [], 0
        if ids:
            yield row(ids, parts)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    return workers(rows).mapInArrow(run, "shard binary, ids array<bigint>, known array<boolean>, lengths array<bigint>, data binary, long binary, at bigint")


def _open(batch: pa.RecordBatch, i: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Segments]:
    get = lambda c: batch.column(batch.schema.get_field_index(c))[i]
    data = np.frombuffer(get("data").as_py(), np.uint8)
    lengths, ids = (np.array(get(c).as_py(), np.int64) for c in ("lengths", "ids"))
    return data, lengths, ids, Segments(data, lengths, length)


def _deal(key: np.ndarray, buckets: int, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of bucket and of part in it, the buckets that have rows, and in a line for each of these the first row of each
    part, with the end."""
    part = (mixed(key) % _U(buckets * parts)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if buckets * parts < 65536 else part, kind="stable")
    names = np.unique(part // parts)
    return order, names, np.searchsorted(part[order], names[:, None] * parts + np.arange(parts + 1))


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for the elements of ``data`` between each two of ``ends``."""
    offsets = (ends * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a binary column, one after another, and how many each has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)), np.diff(ends)


def _packed(values: np.ndarray, counts: np.ndarray, bits: int) -> pa.Array:
    """A binary value for each of ``counts``, with so many of ``values`` at ``bits`` bits each."""
    many = 8 // bits
    ends = np.r_[0, np.cumsum(-(-counts // many))]
    flat = np.zeros(ends[-1] * many, np.uint8)
    flat[_gathered(ends[:-1] * many, counts)] = values
    out = np.zeros(ends[-1], np.uint8)
    for k in range(many):
        out |= flat[k::many] << (bits * k)
    return _binary(out, ends)


def _unpacked(data: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """The values that ``_packed`` made the bytes ``data`` of."""
    many = 8 // bits
    ends = np.cumsum(-(-counts // many))
    if len(data) != (ends[-1] if len(ends) else 0):
        raise ValueError("the marks of a shard are not those of its rows")
    flat = ((data[:, None] >> (np.arange(many, dtype=np.uint8) * bits)) & ((1 << bits) - 1)).ravel()
    return flat[_gathered((ends + counts // -many) * many, counts)]


def _tasks(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` dealt to a task for each bucket, up to TASKS tasks or, if these are more, the session's shuffle
    partitions. A task takes its buckets one by one."""
    return rows.repartition(min(buckets, max(TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "bucket")


def _beside(shards: DataFrame, marks: DataFrame, step: Steps) -> DataFrame:
    """``shards`` with the array ``marks`` of (bucket, blob); broadcast only if its bytes are few."""
    grouped = step(marks.groupBy("shard").agg(F.collect_list(F.struct("bucket", "blob")).alias("marks")))
    size = grouped.agg(F.sum(F.aggregate("marks", F.lit(0).cast("long"), lambda a, m: a + F.length(m["blob"]) + 64))).first()[0] or 0
    return shards.join(F.broadcast(grouped) if size <= BROADCAST_BYTES else grouped, "shard", "left")


def firsts(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal keys, one with the least doc: their places, and for each row which of them is its."""
    order = np.argsort(key, kind="stable")
    sorted_key, sorted_doc = key[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    group = np.cumsum(new) - 1
    own = np.empty(len(order), np.int64)
    own[order] = group
    if not len(order):
        return order, own
    at = np.flatnonzero(sorted_doc == np.minimum.reduceat(sorted_doc, np.flatnonzero(new))[group])
    return order[at[np.r_[True, group[at][1:] != group[at][:-1]]]], own


def _marks_of(batch: pa.RecordBatch, i: int, name: str) -> np.ndarray:
    """The bytes of a shard's marks in order of their buckets. Equal shards share a name and have equal marks, of which one set is read."""
    got = batch.column(batch.schema.get_field_index(name))[i].values
    if got is None:
        return np.zeros(0, np.uint8)
    bucket, blob = got.flatten()
    return _bytes(blob.take(pa.array(np.unique(bucket.to_numpy(zero_copy_only=False), return_index=True)[1])))[0]


NONE, REPEATED, DIFFERS, HOT = 0, 1, 2, 3


def judge_anchors(anchor: np.ndarray, name: np.ndarray, doc: np.ndarray, beside: np.ndarray, hot: int, collapse: bool = True) -> np.ndarray:
    """Of each segment in a bucket: NONE of its windows repeat, all are REPEATED, or it DIFFERS from others (HOT if
    more than ``hot`` segments differ at one anchor). Without ``collapse`` no segment is called REPEATED: copies of one
    content are left to be ordered like segments that differ.

    A window that holds an anchor of GRAM bytes holds half of the other bytes before or after it, so segments of one
    anchor can share a window only if they agree in one of the two.
    """
    out = np.zeros(len(anchor), np.uint8)
    by_anchor = np.argsort(anchor, kind="stable")
    same = anchor[by_anchor][1:] == anchor[by_anchor][:-1]
    shared = by_anchor[np.r_[False, same] | np.r_[same, False]]  # anchors that are alone have no repeats
    if not len(shared):
        return out
    order = shared[np.lexsort((doc[shared], name[shared], anchor[shared]))]
    a, s, d = anchor[order], name[order], doc[order]
    new_s = np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])]
    first_s = d[np.flatnonzero(new_s)][np.cumsum(new_s) - 1]
    if collapse:
        out[order] = np.where(d > first_s, REPEATED, NONE)
    one = order[new_s] if collapse else order  # the first copy of each segment
    differs = np.zeros(len(one), bool)
    for side in (beside[one] >> _U(32), beside[one] & _U(0xFFFFFFFF)):
        by = np.lexsort((side, anchor[one]))
        new = np.r_[True, (anchor[one][by][1:] != anchor[one][by][:-1]) | (side[by][1:] != side[by][:-1])]
        starts, group, docs = np.flatnonzero(new), np.cumsum(new) - 1, doc[one][by]
        differs[by] |= (np.minimum.reduceat(docs, starts) < np.maximum.reduceat(docs, starts))[group]
    left = one[differs]  # in order of their anchors
    if len(left):
        new = np.r_[True, anchor[left][1:] != anchor[left][:-1]]
        content = new | np.r_[True, name[left][1:] != name[left][:-1]]
        many = np.add.reduceat(content, np.flatnonzero(new), dtype=np.int64)[np.cumsum(new) - 1]
        equal = np.where(many > hot, HOT, DIFFERS).astype(np.uint8)
        verdict = np.zeros(len(anchor), np.uint8)
        verdict[left] = equal
        if not collapse:
            return verdict
        # copies in the same document as the first fare like it
        of_first = verdict[one][np.cumsum(new_s) - 1]
        out[order] = np.where(d > first_s, REPEATED, of_first)
    return out


def _digest(doc_id: int | None, data: np.ndarray, covered: np.ndarray, keep: bool) -> tuple:
    left = data[~covered].tobytes()
    spans = int((np.diff(np.r_[False, covered].astype(np.int8)) == 1).sum())
    return doc_id, len(data), int(covered.sum()), spans, hashlib.sha256(left).hexdigest(), left if keep else None


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
RESULT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
RESULT_NAMES = [f.split()[0] for f in RESULT.split(", ")]


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = 50, hot: int = 5000, keep: bool = True, shard_bytes: int = SHARD_BYTES, collapse: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``, and what is left as ``kept`` (binary) if
    ``keep``. Without ``collapse`` the transforms settle equal segments too, one copy of a content in each shard. The
    result is a table in the shared folder."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name, None)
    conf.set(name, BATCH_BYTES)  # a row of a shard has about 160 kB, and batches of rows stand in memory several times
    step = Steps()
    try:
        out = materialize(_removed(docs, text, doc_id, length, hot, keep, shard_bytes, collapse, step))
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    step.clear()
    return out if keep else out.drop("kept")


def _removed(docs: DataFrame, text: str, doc_id: str, length: int, hot: int, keep: bool, shard_bytes: int, collapse: bool, step: Steps) -> DataFrame:
    shards = step(_shards(docs, text, doc_id, shard_bytes, length))
    total, longs = shards.agg(F.sum(F.length("data")), F.count("long")).first()
    buckets = max(1, math.ceil((total or 0) / ((length - GRAM + 2) / 2) / ANCHORS_PER_BUCKET))

    def anchors(batches):
        for batch in batches:
            for i in range(len(batch)):
                _, _, ids, own = _open(batch, i, length)
                kept, _ = firsts(ids[own.doc], own.name)
                order, rows, cuts = _deal(own.anchor[kept], buckets)
                shard = batch.column(batch.schema.get_field_index("shard"))[i].as_py()
                kept = kept[order]
                both = np.stack([own.anchor[kept], own.name[kept], ids[own.doc[kept]].view(_U), own.beside[kept]], 1)
                blobs = _binary(both.ravel(), 4 * np.r_[cuts[:, 0], len(kept)])
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.binary()), pa.array(rows, pa.int64()), blobs], names=["shard", "bucket", "blob"])

    def decide(group: pa.Table) -> pa.Table:
        data, sizes = _bytes(group.column("blob"))
        both, counts = data.view(_U).reshape(-1, 4), sizes // 32
        verdict = judge_anchors(both[:, 0].copy(), both[:, 1].copy(), both[:, 2].copy().view(np.int64), both[:, 3].copy(), hot, collapse)
        starts = np.cumsum(counts) - counts
        differ = np.add.reduceat(np.array([0, 0, 1, length])[verdict], starts)
        return pa.table([group.column("shard"), group.column("bucket"), _packed(verdict, counts, 2), pa.array(differ, pa.int64())], names=["shard", "bucket", "blob", "differ"])

    dealt = shards.select("shard", "ids", "lengths", "data").mapInArrow(anchors, "shard binary, bucket bigint, blob binary")
    verdicts = step(_tasks(dealt, buckets).groupBy("bucket").applyInArrow(decide, "shard binary, bucket bigint, blob binary, differ bigint"))
    differ = verdicts.agg(F.sum("differ")).first()[0] or 0
    pieces = max(1, math.ceil(differ * (length + GRAM) / BUCKET_BYTES))
    marked = _beside(shards, verdicts.select("shard", "bucket", "blob"), step)

    def units(batch, i, column, data, ids, own):
        """The verdicts and what is to be ordered: segments that differ and, of hot anchors, single windows, each
        dealt by its own content and one for each content."""
        kept, which = firsts(ids[own.doc], own.name)
        order, _, cuts = _deal(own.anchor[kept], buckets)
        verdict = np.zeros(len(kept), np.uint8)
        verdict[order] = _unpacked(_marks_of(batch, i, column), cuts[:, 1] - cuts[:, 0], 2)
        doc = ids[own.doc]
        later = doc > doc[kept][which] if len(kept) else np.zeros(0, bool)
        verdict = np.where(later, REPEATED, verdict[which]) if len(kept) else verdict
        at, hots = np.flatnonzero(verdict == DIFFERS), np.flatnonzero(verdict == HOT)
        starts = _gathered(own.first[hots], own.count[hots])
        of_doc = np.repeat(doc[hots], own.count[hots])
        keys = own.name_of(starts, np.full(len(starts), length)) if len(starts) else np.zeros(0, _U)
        single, of_single = firsts(of_doc, keys)
        unit = np.r_[own.first[at], starts[single]], np.r_[own.count[at], np.ones(len(single), np.int64)], np.r_[own.anchor[at], keys[single]], np.r_[doc[at], of_doc[single]]
        behind = of_doc > of_doc[single][of_single] if len(single) else np.zeros(0, bool)
        return verdict, unit, (starts, of_single + len(at), behind)

    def bring(batches):
        for batch in batches:
            for i in range(len(batch)):
                data, _, ids, own = _open(batch, i, length)
                _, (first, count, key, doc), _ = units(batch, i, "marks", data, ids, own)
                order, rows, cuts = _deal(key, pieces, PARTS)
                shard = batch.column(batch.schema.get_field_index("shard"))[i].as_py()
                sizes, ends = count[order] + length - 1, np.r_[cuts[:, 0], len(order)]
                blobs = [_binary(np.diff(cuts).ravel(), np.arange(len(rows) + 1) * PARTS), _binary(doc[order], ends), _binary(sizes, ends)]
                blobs.append(_binary(data[_gathered(first[order], sizes)], np.r_[0, np.cumsum(sizes)][ends]))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.binary()), pa.array(rows, pa.int64()), *blobs], names=["shard", "bucket", "parts", "docs", "sizes", "strings"])

    def order_windows(group: pa.Table) -> pa.Table:
        """Part by part, strings in the order of their shards' names are joined to pieces of about PIECE_BYTES."""
        shard = group.column("shard").to_pylist()
        rank = np.empty(len(shard), np.int64)
        rank[sorted(range(len(shard)), key=shard.__getitem__)] = np.arange(len(shard))
        parts, docs, sizes, strings = (_bytes(group.column(name))[0].view(kind) for name, kind in (("parts", np.int64), ("docs", np.int64), ("sizes", np.int64), ("strings", np.uint8)))
        part = np.repeat(np.arange(len(parts)) % PARTS, parts)
        row = np.repeat(np.arange(len(parts)) // PARTS, parts)
        order = np.lexsort((rank[row], part))
        ends = np.searchsorted(part[order], np.arange(PARTS + 1))
        count, first = sizes - length + 1, np.cumsum(sizes) - sizes
        place = np.cumsum(count) - count
        flags = np.zeros(int(count.sum()), np.uint8)
        for own in (order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True) if a < b):
            piece = (np.cumsum(sizes[own]) - sizes[own]) // PIECE_BYTES
            pieces = np.split(own, np.flatnonzero(np.diff(piece)) + 1)
            found = repeated_windows([(docs[k], sizes[k], strings[_gathered(first[k], sizes[k])]) for k in pieces], length)
            for k, hits in zip(pieces, found, strict=True):
                flags[_gathered(place[k], count[k])] = hits
        counts = np.bincount(row, count, len(shard)).astype(np.int64)
        return pa.table([group.column("shard"), group.column("bucket"), _packed(flags, counts, 1)], names=["shard", "bucket", "blob"])

    brought = marked.select("shard", "ids", "lengths", "data", "marks").mapInArrow(bring, "shard binary, bucket bigint, parts binary, docs binary, sizes binary, strings binary")
    windows = _tasks(brought, pieces).groupBy("bucket").applyInArrow(order_windows, "shard binary, bucket bigint, blob binary")
    final = _beside(marked.withColumnRenamed("marks", "verdicts"), step(windows), step)

    def cut_texts(batches):
        for batch in batches:
            for i in range(len(batch)):
                get = lambda c: batch.column(batch.schema.get_field_index(c))[i].as_py()  # noqa: B023, E731
                data, lengths, ids, own = _open(batch, i, length)
                verdict, (first, count, key, _), (starts, of_unit, behind) = units(batch, i, "verdicts", data, ids, own)
                diff = np.zeros(len(data) + 1, np.int32)
                whole = verdict == REPEATED
                np.add.at(diff, own.first[whole], 1)
                np.add.at(diff, own.first[whole] + own.count[whole] + length - 1, -1)
                order, _, cuts = _deal(key, pieces, PARTS)
                place = np.cumsum(count) - count
                hit = np.zeros(int(count.sum()), bool)  # a flag for each window of each unit
                dealt = np.diff(np.r_[0, np.cumsum(count[order])][np.r_[cuts[:, 0], len(order)]])
                hit[_gathered(place[order], count[order])] = _unpacked(_marks_of(batch, i, "marks"), dealt, 1)
                windows = np.repeat(first - place, count) + np.arange(len(hit))
                found = np.r_[windows[hit], starts[behind | hit[place[of_unit]]]] if len(starts) else windows[hit]
                np.add.at(diff, found, 1)
                np.add.at(diff, found + length, -1)
                covered = np.cumsum(diff[:-1]) > 0
                known, long = get("known"), get("long")
                if long is not None:
                    rows = [(int(ids[0]) if known[0] else None, len(data), 0, 0, None, data.tobytes())]
                    more = [long], [get("at")], [np.packbits(covered).tobytes()]
                else:
                    ends = np.cumsum(lengths)
                    rows = [_digest(int(ids[k]) if known[k] else None, data[e - n : e], covered[e - n : e], keep) for k, (e, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True))]
                    more = ([None] * len(rows),) * 3
                columns = [pa.array(c, k) for c, k in zip([*zip(*rows, strict=True), *more], [*RESULT_KINDS, pa.binary(), pa.int64(), pa.binary()], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*RESULT_NAMES, "long", "at", "covered"])

    def join_long(group: pa.Table) -> pa.Table:
        """The rows of a long text, put together. Rows of equal texts with one doc_id are as many results."""
        rows = sorted(group.select(["at", "doc_id", "kept", "covered"]).to_pylist(), key=lambda r: r["at"])
        copies = sum(r["at"] == 0 for r in rows)
        rows = rows[::copies]
        data = np.zeros(rows[-1]["at"] + len(rows[-1]["kept"]), np.uint8)
        covered = np.zeros(len(data), bool)
        for r in rows:
            n = len(r["kept"])
            data[r["at"] : r["at"] + n] = np.frombuffer(r["kept"], np.uint8)
            covered[r["at"] : r["at"] + n] |= np.unpackbits(np.frombuffer(r["covered"], np.uint8))[:n].astype(bool)
        row = _digest(rows[0]["doc_id"], data, covered, keep)
        return pa.table([pa.array([x] * copies, k) for x, k in zip(row, RESULT_KINDS, strict=True)], names=RESULT_NAMES)

    out = final.mapInArrow(cut_texts, f"{RESULT}, long binary, at bigint, covered binary")
    if not longs:
        return out.drop("long", "at", "covered")
    out = step(out)
    whole = out.where("long is null").select(*RESULT_NAMES)
    return whole.unionByName(out.where("long is not null").groupBy("long").applyInArrow(join_long, RESULT))
